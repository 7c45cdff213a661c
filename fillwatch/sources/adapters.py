"""Views of the supplied star-schema tables as sensor logs and service records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the service: what a report can be about, why an item is rejected, the order of report states.
CATEGORIES = ["Overflowing public bin", "Illegal dumping or litter", "Missed collection", "Damaged, missing or inaccessible bin", "Contaminated recycling", "Hazardous waste", "Discarded sharps", "Return station fault", "Other waste issue"]
REASONS = ["Barcode could not be read", "Deposit mark not found", "Container is crushed", "Unsupported item"]
STATUSES = ["Submitted", "Reviewed", "Assigned", "Resolved"]
WASTE = ["general", "plastic", "metal", "glass"]
VAL_FROM, TEST_FROM = "2024-01-21", "2024-01-26"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index):  # noqa: ANN001, ANN201
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: a saw-tooth level per user, 0 to 105."""
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("bin_id").orderBy("ts", "event_id")  # by the operators' key, so that they need no exchange of their own
    return e.withColumn("bin_id", F.format_string("BIN-%03d", "user_id")).select(
        "bin_id", "ts", F.col("event_id").alias("seq"), ((F.sum(F.round(F.col("value") * 100).cast("long")).over(w) % 10500) / 100.0).alias("fill_pct"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("confidence_flag"), pick(WASTE, F.col("user_id") % 4).alias("waste_type"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") * 37 % 7200 * 1_000_000).alias("received_at"),
    )


READINGS_SQL = f"""readings AS (SELECT 'BIN-' || format('{{:03d}}', user_id) AS bin_id, ts, epoch_us(ts) AS us, event_id AS seq,
 CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 10500 AS DOUBLE) / 100.0 AS fill_pct,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS confidence_flag, {WASTE!r}[user_id % 4 + 1] AS waste_type, epoch_us(ts) + event_id * 37 % 7200 * 1000000 AS rec_us FROM events)"""


def readings_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, every tenth of them sent twice with another level."""
    sent = F.struct("seq", "fill_pct")
    again = F.struct((F.col("seq") + 1_000_000_000).alias("seq"), ((F.col("fill_pct") + 7.25) % 105.0).alias("fill_pct"))
    r = readings(spark, sf_dir)
    names = r.columns
    r = r.withColumn("_sent", F.explode(F.when(F.col("seq") % 10 == 0, F.array(sent, again)).otherwise(F.array(sent))))
    return r.withColumns({"seq": F.col("_sent.seq"), "fill_pct": F.col("_sent.fill_pct")}).select(*names)


READINGS_DUP_SQL = READINGS_SQL + """, readings_dup AS (SELECT * FROM readings UNION ALL
 SELECT * REPLACE (seq + 1000000000 AS seq, (fill_pct + 7.25) % 105.0 AS fill_pct) FROM readings WHERE seq % 10 = 0)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "awaiting-payout").otherwise("paid")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("resident"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"))


SESSIONS_SQL = "sessions AS (SELECT o_orderkey AS session_id, o_custkey AS resident, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'awaiting-payout' ELSE 'paid' END AS status, epoch_us(o_orderdate) AS created_us FROM orders)"


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspected items; the key (session, line) isn't unique, so ties need all columns."""
    li = _table(spark, sf_dir, "lineitem")
    ok = F.col("l_returnflag") != "R"
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linestatus") == "O", "Can").otherwise("Bottle").alias("type"), F.when(ok, "accepted").otherwise("rejected").alias("result"),
        F.when(~ok, pick(REASONS, F.col("l_partkey") % 4)).alias("reason"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("created_us"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("line"),
    )


ITEMS_SQL = f"""item_events AS (SELECT l_orderkey AS session_id, CASE WHEN l_linestatus = 'O' THEN 'Can' ELSE 'Bottle' END AS type, CASE WHEN l_returnflag <> 'R' THEN 'accepted' ELSE 'rejected' END AS result,
 CASE WHEN l_returnflag = 'R' THEN {REASONS!r}[l_partkey % 4 + 1] END AS reason, epoch_us(l_shipdate) AS created_us, l_partkey AS item_id, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"""


def payout_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved methods a resident: a bank account (the default where the balance isn't negative) and a wallet."""
    c = _table(spark, sf_dir, "customer")
    kinds = F.explode(F.array(F.struct(F.lit("bank").alias("type"), F.lit("Bank Transfer").alias("label"), F.lit(0).alias("position")), F.struct(F.lit("wallet").alias("type"), F.lit("E-Wallet").alias("label"), F.lit(1).alias("position"))))
    c = c.select(F.col("c_custkey").alias("resident"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("raw"), kinds.alias("k")).select("resident", "balance", "raw", "k.*")
    return c.select((F.col("resident") * 2 + F.col("position")).alias("method_id"), "resident", "type", "label", "raw", ((F.col("type") == "bank") & (F.col("balance") >= 0)).alias("is_default"), F.col("position").cast("long").alias("position"))


METHODS_SQL = "payout_methods AS (SELECT c_custkey * 2 + position AS method_id, c_custkey AS resident, type, label, c_name AS raw, type = 'bank' AND c_acctbal >= 0 AS is_default, CAST(position AS BIGINT) AS position FROM customer, (VALUES ('bank', 'Bank Transfer', 0), ('wallet', 'E-Wallet', 1)) AS k(type, label, position))"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    d = d.join(lab.select(F.col("doc_id").alias("lab_id"), "toxic"), F.col("doc_id") == F.col("lab_id"), "left")
    return d.select(F.col("doc_id").alias("report_id"), pick(CATEGORIES, F.col("doc_id") % 9).alias("category"), F.col("source").alias("location"), F.col("text").alias("description"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("hazardous"), pick(STATUSES, F.col("doc_id") % 4).alias("status"), (F.col("doc_id") % 50).alias("resident"), (F.col("doc_id") * 3_600_000_000).alias("created_us"))


REPORTS_SQL = f"reports AS (SELECT d.doc_id AS report_id, {CATEGORIES!r}[d.doc_id % 9 + 1] AS category, source AS location, text AS description, coalesce(toxic = 1, false) AS hazardous, {STATUSES!r}[d.doc_id % 4 + 1] AS status, d.doc_id % 50 AS resident, d.doc_id * 3600000000 AS created_us FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "advance").when(F.col("event_type") == "error", "reopen").when(F.col("event_type") == "purchase", "rate")
    return e.select(F.col("user_id").alias("report_id"), action.alias("action"), (1 + F.col("event_id") % 5).alias("rating"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq")).where("action IS NOT NULL")


ACTIONS_SQL = "report_actions AS (SELECT * FROM (SELECT user_id AS report_id, CASE event_type WHEN 'click' THEN 'advance' WHEN 'error' THEN 'reopen' WHEN 'purchase' THEN 'rate' END AS action, 1 + event_id % 5 AS rating, epoch_us(ts) AS us, event_id AS seq FROM events) WHERE action IS NOT NULL)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
