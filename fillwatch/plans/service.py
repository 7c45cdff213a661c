"""Registered queries over service records, model bundles and documents, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.operators import audit, kpi, models
from fillwatch.operators import records as R
from fillwatch.operators.labels import chronological_split
from fillwatch.plans import telemetry
from fillwatch.plans.telemetry import labeled
from fillwatch.session import shared_dir
from fillwatch.sources import readers as I
from fillwatch.sources.adapters import ACTIONS_SQL, ITEMS_SQL, METHODS_SQL, REASONS, REPORTS_SQL, SESSIONS_SQL, STATUSES, TEST_FROM, VAL_FROM, item_events, messages, payout_methods, report_actions, reports, sessions

#: Keyword rules over the supplied part names and messages; the first that matches wins.
PART_RULES = [("fasteners", ["bolt", "screw", "nut"]), ("rings", ["ring", "gasket"]), ("widgets", ["widget", "gadget"]), ("bright", ["red", "green", "blue"])]
REPLY_RULES = [("returns", ["container", "return", "the th"]), ("collection", ["collection", "pickup", "tion"]), ("payout", ["payout", "money", "ent"])]
REPLY_ELSE = "fallback"
US_2000 = 946684800000000


def _rules_large(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents as a keyword, the longest first; which is the first that a message contains?"""
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("k")).where("length(k) >= 2").distinct()
    rules = words.select((-F.length("k")).alias("rule_order"), F.col("k").alias("rule_id"), F.array("k").alias("keywords"))
    return R.rules_join(messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "text"), "message", "text", rules)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")


def _rules_sql(text: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {w!r})' for w in ws)} THEN '{n}'" for n, ws in rules)
    return f"CASE WHEN length(trim({text}, ' ')) < 2 THEN {otherwise} {cases} ELSE {otherwise} END"


def _payments(spark: SparkSession, d: str) -> DataFrame:
    """Two payment attempts for each order that isn't open: the first fails for every fourth, the second for every tenth."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'O'").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return o.select(F.col("o_orderkey").alias("session_id"), (F.col("t") + F.col("k") * 60_000_000).alias("us"), F.when(F.col("k") == 1, F.col("o_orderkey") % 4 != 0).otherwise(F.col("o_orderkey") % 10 != 0).alias("ok"), (F.col("o_custkey") * 2 + F.col("k") % 2).alias("method_id"))


PAYMENTS_SQL = "payments AS (SELECT o_orderkey AS session_id, epoch_us(o_orderdate) + k * 60000000 AS us, CASE WHEN k = 1 THEN o_orderkey % 4 <> 0 ELSE o_orderkey % 10 <> 0 END AS ok, o_custkey * 2 + k % 2 AS method_id FROM orders, (VALUES (1), (2)) AS v(k) WHERE o_orderstatus <> 'O')"


def _state(spark: SparkSession, d: str) -> DataFrame:
    pay = _payments(spark, d)
    return R.session_state(sessions(spark, d), item_events(spark, d), pay.select("session_id"), pay)


STATE_SQL = f"""{SESSIONS_SQL}, {ITEMS_SQL}, {PAYMENTS_SQL}, ac AS (SELECT session_id, count(*) AS n FROM item_events WHERE result = 'accepted' GROUP BY session_id),
fp AS (SELECT * FROM payments WHERE ok QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY us, method_id) = 1), tries AS (SELECT session_id, count(*) AS attempts, count(*) FILTER (WHERE NOT ok) AS failed FROM payments GROUP BY session_id),
ss AS (SELECT s.session_id, CASE WHEN tries.session_id IS NULL OR ac.n IS NULL THEN 'active' WHEN fp.us IS NOT NULL THEN 'paid' ELSE 'awaiting-payout' END AS status, fp.us, fp.method_id, coalesce(attempts, 0) AS attempts, coalesce(failed, 0) AS failed
 FROM sessions s LEFT JOIN ac USING (session_id) LEFT JOIN fp USING (session_id) LEFT JOIN tries USING (session_id))"""
TOTALS = f"{SESSIONS_SQL}, {ITEMS_SQL}, tt AS (SELECT s.session_id, any_value(s.resident) AS resident, any_value(s.status) AS status, any_value(s.created_us) AS created_us, CAST(count(*) FILTER (WHERE i.result = 'accepted') * 20 AS BIGINT) AS total_cents, count(i.session_id) AS n_items FROM sessions s LEFT JOIN item_events i USING (session_id) GROUP BY s.session_id)"
RECEIPTS = f"{TOTALS}, {METHODS_SQL}, dm AS (SELECT resident, arg_min(label, (NOT is_default, position)) AS label FROM payout_methods GROUP BY resident), rc AS (SELECT tt.*, coalesce(label, 'Saved payout method') AS method FROM tt LEFT JOIN dm USING (resident) WHERE status = 'paid')"
MONEY = "'RM' || format('{:.2f}', total_cents / 100)"


def _faq(spark: SparkSession, d: str) -> DataFrame:
    """Reports as entries: the category, where as the question, what as the answer."""
    return reports(spark, d).select("report_id", "category", F.col("location").alias("question"), F.col("description").alias("answer"))


def _payouts(spark: SparkSession, d: str) -> DataFrame:
    return R.payout_notifications(_state(spark, d), R.session_totals(sessions(spark, d), item_events(spark, d)), payout_methods(spark, d))


def _bundles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One bundle a part, sound or broken in one of eight ways by its number."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", (F.col("p_partkey") % 8).alias("k"))
    features = F.array(F.lit("a"), F.lit("b"))
    m = F.struct(
        F.when(F.col("k") != 1, F.sha2("p_name", 256)).otherwise(F.repeat(F.lit("0"), F.lit(64))).alias("sha256_checksum"), F.when(F.col("k") != 2, "GBTRegressor").otherwise("Pickle").alias("estimator_class"), features.alias("feature_columns"),
        F.when(F.col("k") != 3, "1.0").alias("model_version"), F.when(F.col("k") == 4, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("lib"), F.when(F.col("k") == 5, "one").otherwise("1.2.3"))).alias("dependencies"),
    )
    b = p.select(F.col("p_partkey").cast("string").alias("bundle"), F.when(F.col("k") != 6, F.to_json(m)).alias("manifest"), F.when(F.col("k") == 7, F.array(F.lit("b"))).otherwise(features).alias("feature_list"))
    return b, p.select(F.col("p_partkey").cast("string").alias("bundle"), F.sha2("p_name", 256).alias("sha256"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """One application document a customer, versions 1 to 4."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    report = F.array(F.struct(F.col("c_name").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).alias("attachments")))
    doc = F.struct((1 + F.col("c_custkey") % 4).cast("int").alias("version"), F.struct(F.col("c_name").alias("userId")).alias("auth"), report.alias("reports"), F.struct(F.when(F.col("c_custkey") % 3 == 0, F.lit(False)).alias("reminders"), F.when(F.col("c_custkey") % 5 == 0, F.lit("Bottle")).alias("nextItemType"), F.col("c_nationkey").alias("radius")).alias("settings"), F.array(F.struct(F.col("c_custkey").alias("id"))).alias("returns"))
    return c.select(F.col("c_custkey").alias("key"), F.to_json(doc).alias("doc"))


def _migrate(spark: SparkSession, d: str) -> DataFrame:
    good, bad = audit.migrate_documents(_documents(spark, d))
    a = good.select("key", "version", "from_version", "user_id", F.size("reports").alias("n_reports"), F.aggregate("reports", F.lit(0), lambda s, r: s + F.size(r["attachments"])).alias("n_attachments"), "nearby_bin_alerts", "next_item_type", F.get_json_object("doc", "$.returns[0].id").alias("return_id"), F.get_json_object("doc", "$.settings.radius").alias("radius"), F.get_json_object("doc", "$.settings.nextItemType").alias("new_type"), F.get_json_object("doc", "$.reports[0].attachments").alias("new_attachments"), F.get_json_object("doc", "$.version").alias("new_version"), F.lit(False).alias("quarantined"))
    b = bad.select("key", "version", F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(None).cast("boolean"), *[F.lit(None).cast("string")] * 6, F.lit(True))
    return a.union(b)


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    """Nations as runs: value of open and closed orders as the two modes; the setups of every seventh differ."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    mode = F.when(F.col("o_orderstatus") == "O", "baseline").otherwise("priority")
    x = o.join(c, "o_custkey").groupBy(F.col("c_nationkey").alias("run"), mode.alias("mode")).agg((F.sum("cents") / 100.0).alias("value"))
    return x.select("run", F.lit("value").alias("metric"), "mode", "value", F.when((F.col("run") % 7 == 0) & (F.col("mode") == "baseline"), "other").otherwise("same").alias("setup"))


KPIS_SQL = "kp AS (SELECT c_nationkey AS run, CASE WHEN o_orderstatus = 'O' THEN 'baseline' ELSE 'priority' END AS mode, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), pv AS (SELECT run, max(value) FILTER (WHERE mode = 'baseline') AS b, max(value) FILTER (WHERE mode = 'priority') AS p FROM kp GROUP BY run)"


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three fitted models at small sizes and the naive forecast, on purged validation and untouched test rows."""
    small = {"linear": {}, "forest": {"numTrees": 20, "maxDepth": 5}, "boosted": {"rounds": 10, "depth": 4, "rate": 0.3}}
    x = chronological_split(labeled(spark, d), VAL_FROM, TEST_FROM)
    return models.train_and_compare(x, VAL_FROM, TEST_FROM, small)[0]


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    x = chronological_split(labeled(spark, d), VAL_FROM, TEST_FROM)
    return models.manifest(x, telemetry.QUERIES["eval_metrics"](spark, d), "naive", VAL_FROM, TEST_FROM).select("model_version", "estimator", "val_from", "test_from", "threshold", "counts", F.size("feature_columns").alias("n_features"))


def _linear(spark: SparkSession, d: str) -> DataFrame:
    """The line of hours on the level, fitted on the training split."""
    x = chronological_split(labeled(spark, d), VAL_FROM, TEST_FROM).where("split = 'train'")
    m = models.fit(x, "linear", features=["fill_pct"]).stages[-1]
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))], "slope double, intercept double")


#: Edges of the two features that the registered stumps split on.
STUMP_EDGES = {"fill_pct": [10.0 * k for k in range(1, 10)], "time_since_reset_hours": [12.0 * k for k in range(1, 15)]}


def _stumps(spark: SparkSession, d: str) -> DataFrame:
    """Two boosted stumps on all training rows, and what they predict for every bin's newest reading."""
    x = labeled(spark, d)
    m = models.fit(x, "boosted", features=list(STUMP_EDGES), rounds=2, depth=1, rate=0.5, rows=1.0, columns=1.0, edges=list(STUMP_EDGES.values()))
    return m.transform(telemetry.X.latest_per_bin(telemetry.feats(spark, d))).select("bin_id", F.round("predicted_hours", 6).alias("predicted_hours"))


def _stump_sql(n: int, of: str) -> str:
    """The n-th stump: the gain of each feature and edge from sums over the rows, and the rows with what is left."""
    edges = ", ".join(f"('{f}', {e})" for f, es in STUMP_EDGES.items() for e in es)
    value = "CASE f WHEN 'fill_pct' THEN fill_pct ELSE time_since_reset_hours END"
    return f""", g{n} AS (SELECT f, e, sum(r) FILTER (WHERE {value} <= e) AS gl, sum(r) FILTER (WHERE {value} > e) AS gr, count(*) FILTER (WHERE {value} <= e) AS nl, count(*) FILTER (WHERE {value} > e) AS nr FROM {of}, (VALUES {edges}) AS v(f, e) WHERE kind = 'train' GROUP BY f, e),
b{n} AS (SELECT *, -0.5 * gl / (nl + 1) AS vl, -0.5 * gr / (nr + 1) AS vr FROM g{n} WHERE nl >= 1 AND nr >= 1 ORDER BY gl * gl / (nl + 1) + gr * gr / (nr + 1) DESC LIMIT 1),
r{n} AS (SELECT x.* REPLACE (r + CASE WHEN {value} <= e THEN vl ELSE vr END AS r, p + CASE WHEN {value} <= e THEN vl ELSE vr END AS p) FROM {of} AS x, b{n})"""


def _importance(spark: SparkSession, d: str) -> DataFrame:
    x = chronological_split(labeled(spark, d), VAL_FROM, TEST_FROM).where("split = 'train'")
    return models.feature_importance(models.fit(x, "forest", numTrees=20, maxDepth=5), spark)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers as identifiers of three kinds."""
    place = (F.col("p_partkey") % 3 + 1).cast("int")
    kind = F.element_at(F.array(F.lit("report"), F.lit("return"), F.lit("bin")), place)
    text = F.concat(F.element_at(F.array(F.lit("WR-"), F.lit("BS-"), F.lit("BIN-")), place), F.col("p_partkey").cast("string"))
    return _parts(spark, d).select("p_partkey", kpi.id_ok(kind, text).alias("ok"))


def _files(rows: DataFrame, brand: str, text: str) -> str:
    """One text file a brand, with one line; returns where."""
    at = f"{shared_dir(rows.sparkSession)}/files-{uuid.uuid4().hex}"
    rows.select(F.col(brand).alias("brand"), F.col(text).alias("value")).repartition("brand").write.partitionBy("brand").text(at)
    return f"{at}/*/*.txt"


def _brands(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("p_type")).alias("types"))
    return p.withColumn("manifest", F.to_json(F.struct(F.col("p_brand").alias("model_version"), F.col("n").alias("rows")))).withColumn("features", F.to_json("types"))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    m = I.read_manifests(spark, _files(_brands(spark, d), "p_brand", "manifest"))
    return m.select(F.from_json("manifest", "model_version string, rows long").alias("m")).select("m.*")


def _feature_lists(spark: SparkSession, d: str) -> DataFrame:
    b = I.read_feature_lists(spark, _files(_brands(spark, d), "p_brand", "features"))
    return b.select(F.size("features").cast("long").alias("n"), F.array_join("features", ",").alias("features")).groupBy("n", "features").agg(F.count(F.lit(1)).alias("files"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    return I.scan_artifacts(spark, _files(_brands(spark, d), "p_brand", "manifest")).select("length", "sha256")


def _retries(spark: SparkSession, d: str) -> DataFrame:
    """Every session whose last item's barcode couldn't be read tries it once more, a minute later."""
    items = item_events(spark, d)
    w = items.groupBy("session_id").agg(F.max("created_us").alias("t"))
    again = R.recoverable_sessions(items).where("recoverable").join(w, "session_id").select("session_id", "type", (F.col("t") + 60_000_000).alias("created_us"))
    x = R.append_retries(items, again)
    return x.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "accepted").alias("accepted"), F.sum("value_cents").alias("cents"))


def _add(spark: SparkSession, d: str) -> DataFrame:
    """A wallet for every third customer, half of whom have no method yet."""
    m = payout_methods(spark, d).where("resident % 6 <> 0")
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 = 0")
    new = c.select((F.col("c_custkey") + 10_000_000_000).alias("method_id"), F.col("c_custkey").alias("resident"), F.lit("wallet").alias("type"), F.col("c_name").alias("raw"))
    return R.add_methods(m, new).select("method_id", "resident", "label", "is_default", "position")


def _create(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as new reports beside those of the documents."""
    new = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") + 10_000_000_000).alias("report_id"), F.when(F.col("item_id") % 2 == 0, "Hazardous waste").otherwise("Missed collection").alias("category"), F.col("text").alias("description"), F.lit(False).alias("hazardous"), F.lit(0).cast("long").alias("created_us"))
    every, told = R.create_reports(reports(spark, d), new)
    n = told.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("hazardous").alias("n_hazardous")).unionByName(n.select(F.col("title").alias("status"), "n", F.lit(0).cast("long").alias("n_hazardous")))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Pages as reports with new attachments, older file names, both or none, by their url's length."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("url", (F.length("url") % 4).alias("k"))
    p = p.withColumn("attachments", F.when(F.col("k") % 2 == 1, F.array(F.struct(F.concat("url", F.lit(".png")).alias("name"))))).withColumn("image_names", F.when(F.col("k") >= 2, F.array(F.lit("old.jpg"))))
    return R.attachment_names(p).select("url", F.array_join("names", ",").alias("names"))


def _read_documents(spark: SparkSession, d: str) -> DataFrame:
    _documents(spark, d).select("doc").write.text(at := f"{shared_dir(spark)}/docs-{uuid.uuid4().hex}")
    x = I.read_documents(spark, at).select(F.from_json("doc", "version int, auth struct<userId:string>").alias("d"))
    return x.select("d.version", F.col("d.auth.userId").alias("user_id"))


QUERIES = {
    "read_manifests": _manifests,
    "read_feature_lists": _feature_lists,
    "scan_artifacts": _artifacts,
    "read_documents": _read_documents,
    "price_items": lambda s, d: R.price_items(item_events(s, d)).groupBy("session_id", "result").agg(F.sum("value_cents").alias("cents"), F.count("reason").alias("with_reason")),
    "session_totals": lambda s, d: R.session_totals(sessions(s, d), item_events(s, d)),
    "session_counts": lambda s, d: R.session_counts(sessions(s, d), item_events(s, d)),
    "event_log": lambda s, d: R.event_log(item_events(s, d)).groupBy("session_id", "number").agg(F.max("created_us").alias("created_us"), F.max("item_id").alias("item_id")),
    "recoverable_sessions": lambda s, d: R.recoverable_sessions(item_events(s, d)),
    "retried_items": lambda s, d: R.retried_items(item_events(s, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("retries")),
    "session_state": lambda s, d: _state(s, d).select("session_id", "status", "transaction_id"),
    "payout_attempts": lambda s, d: _state(s, d).select("session_id", "paid_us", "method_id", "attempts", "failed"),
    "linear_fit": _linear,
    "boosted_stumps": _stumps,
    "model_manifest": _manifest,
    "append_retries": _retries,
    "set_default": lambda s, d: R.set_default(payout_methods(s, d), payout_methods(s, d).where("resident % 3 = 0 AND position = 1").select("resident", "method_id")).select("method_id", "resident", "is_default"),
    "add_methods": _add,
    "newest_return": lambda s, d: R.newest_return(sessions(s, d)),
    "payment_receipts": lambda s, d: R.payment_receipts(sessions(s, d), item_events(s, d), payout_methods(s, d), _state(s, d)),
    "create_reports": _create,
    "attachment_names": _names,
    "receipts": lambda s, d: R.receipts(sessions(s, d), item_events(s, d), payout_methods(s, d)),
    "payout_by_method": lambda s, d: R.payout_by_method(sessions(s, d), item_events(s, d), payout_methods(s, d)),
    "mask_identifier": lambda s, d: payout_methods(s, d).select("method_id", R.mask_identifier(F.col("raw"), F.col("type")).alias("masked")),
    "default_method": lambda s, d: R.default_method(payout_methods(s, d)),
    "remove_method": lambda s, d: R.remove_method(payout_methods(s, d), payout_methods(s, d).where("method_id % 6 = 0").select("method_id")).select("method_id", "resident", "is_default"),
    "recent_returns": lambda s, d: R.recent_returns(sessions(s, d)),
    "payout_notifications": lambda s, d: R.unread_count(R.mark_read(_payouts(s, d), sessions(s, d).where("session_id % 3 = 0").select("session_id"), "session_id")),
    "payout_details": lambda s, d: _payouts(s, d).select("session_id", "title", "detail", "created_us"),
    "report_notifications": lambda s, d: R.mark_read(R.report_notifications(reports(s, d)), reports(s, d).where("report_id % 4 = 1").select("report_id"), "report_id").select("report_id", "title", "detail", "read"),
    "reports_by_status": lambda s, d: R.by_status(reports(s, d), STATUSES[1]).select("report_id", "category", "created_us"),
    "report_validation": lambda s, d: R.validate_reports(R.flag_hazards(reports(s, d))).select("report_id", F.array_join("reasons", ";").alias("reasons"), "hazardous"),
    "report_state": lambda s, d: R.report_state(report_actions(s, d)),
    "status_track": lambda s, d: R.status_track(reports(s, d)),
    "open_report": lambda s, d: R.open_report(reports(s, d)),
    "activity_feed": lambda s, d: R.activity_feed(sessions(s, d), reports(s, d)),
    "classify_items": lambda s, d: R.first_rule(_parts(s, d), "p_name", PART_RULES).select("p_partkey", "rule"),
    "rules_join_large": _rules_large,
    "rules_join": lambda s, d: R.rules_join(_parts(s, d), "p_partkey", "p_name", s.createDataFrame([(i, n, ws) for i, (n, ws) in enumerate(PART_RULES)], "rule_order int, rule_id string, keywords array<string>")),
    "reply_intent": lambda s, d: R.first_rule(messages(s, d), "text", REPLY_RULES, REPLY_ELSE, 0, "intent").select("conv_id", "turn", "intent"),
    "faq_search": lambda s, d: R.faq_search(_faq(s, d), "License", "Missed collection").select("report_id"),
    "faq_categories": lambda s, d: R.faq_categories(_faq(s, d), "report_id"),
    "locations_sorted": lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("name"), F.abs("s_acctbal").alias("distance")).orderBy("distance", "name"),
    "registry_audit": lambda s, d: audit.registry_audit(*_bundles(s, d)),
    "migrate_documents": _migrate,
    "kpi_contamination": lambda s, d: kpi.contamination(item_events(s, d), "type").select("type", "rejected", "inspected", F.round("contamination", 9).alias("contamination")),
    "kpi_compare": lambda s, d: kpi.compare(_kpis(s, d)).select("run", "valid", "complete", F.round("change", 2).alias("change"), F.round("change_pct", 6).alias("change_pct")),
    "paired_runs": lambda s, d: kpi.paired_runs(_kpis(s, d).withColumnRenamed("run", "seed")).select("n", F.round("mean_diff", 2).alias("mean_diff"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high")),
    "route_sums": lambda s, d: kpi.route_sums(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("route"), F.col("l_quantity").alias("leg_km")), 0.4, 2.68).select("route", "km", F.round("litres", 6).alias("litres"), F.round("kg_co2", 6).alias("kg_co2")),
    "id_patterns": _ids,
    "recycler_score": lambda s, d: kpi.recycler_score(sessions(s, d), item_events(s, d), US_2000 - 15_552_000_000_000, US_2000).select("resident", "visits", "accepted", "inspected", "clean", F.round("score", 6).alias("score")),
    "duplicate_scans": lambda s, d: kpi.duplicate_scans(item_events(s, d)),
    "model_comparison": _comparison,
    "feature_importance": _importance,
}

ORDER = "created_us, line, item_id, type, result"
ORACLES = {
    "read_manifests": "SELECT p_brand AS model_version, count(*) AS rows FROM part GROUP BY p_brand",
    "read_feature_lists": "SELECT n, features, count(*) AS files FROM (SELECT count(DISTINCT p_type) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS features FROM part GROUP BY p_brand) GROUP BY ALL",
    "scan_artifacts": """SELECT length(t) AS length, sha256(t) AS sha256 FROM (SELECT '{"model_version":"' || p_brand || '","rows":' || count(*) || '}' || chr(10) AS t FROM part GROUP BY p_brand)""",
    "read_documents": "SELECT CAST(1 + c_custkey % 4 AS INTEGER) AS version, c_name AS user_id FROM customer",
    "price_items": f"WITH {ITEMS_SQL} SELECT session_id, result, CAST(CASE WHEN result = 'accepted' THEN 20 * count(*) ELSE 0 END AS BIGINT) AS cents, count(reason) AS with_reason FROM item_events GROUP BY session_id, result",
    "session_totals": f"WITH {TOTALS} SELECT session_id, total_cents, {MONEY} AS total_text FROM tt",
    "session_counts": f"WITH {SESSIONS_SQL}, {ITEMS_SQL}, x AS (SELECT s.session_id, count(*) FILTER (WHERE result = 'accepted') AS accepted, count(*) FILTER (WHERE result = 'rejected') AS rejected, count(*) FILTER (WHERE result = 'accepted' AND type = 'Can') AS cans, count(*) FILTER (WHERE result = 'accepted' AND type = 'Bottle') AS bottles, count(i.session_id) AS n_events FROM sessions s LEFT JOIN item_events i USING (session_id) GROUP BY s.session_id) SELECT *, least(100, accepted * 10) AS progress_pct FROM x",
    "event_log": f"WITH {ITEMS_SQL} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY {ORDER}) AS number, created_us, item_id FROM item_events",
    "recoverable_sessions": f"WITH {ITEMS_SQL} SELECT session_id, type, result, reason, result = 'rejected' AND reason = '{REASONS[0]}' AS recoverable FROM item_events QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_us DESC, line DESC, item_id DESC, type DESC, result DESC) = 1",
    "retried_items": f"WITH {ITEMS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {ORDER}) AS k FROM item_events) SELECT a.session_id, count(*) AS retries FROM n a JOIN n b ON a.session_id = b.session_id AND b.k = a.k + 1 AND a.type = b.type WHERE a.reason = '{REASONS[0]}' AND b.result = 'accepted' GROUP BY a.session_id",
    "session_state": f"WITH {STATE_SQL} SELECT session_id, status, CASE WHEN status = 'paid' THEN 'TXN-' || session_id END AS transaction_id FROM ss",
    "payout_attempts": f"WITH {STATE_SQL} SELECT session_id, CASE WHEN status = 'paid' THEN us END AS paid_us, CASE WHEN status = 'paid' THEN method_id END AS method_id, attempts, failed FROM ss",
    "linear_fit": f"WITH {telemetry.LABELS} SELECT round(regr_slope(hours, fill_pct), 6) AS slope, round(regr_intercept(hours, fill_pct), 6) AS intercept FROM lab WHERE split = 'train'",
    "boosted_stumps": f"""WITH {telemetry.LABELS}, r0 AS (SELECT 'train' AS kind, bin_id, us, fill_pct, time_since_reset_hours, avg(hours) OVER () - hours AS r, avg(hours) OVER () AS p FROM lab
 UNION ALL SELECT 'last', bin_id, us, fill_pct, time_since_reset_hours, 0, (SELECT avg(hours) FROM lab) FROM (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY us DESC) = 1)){_stump_sql(1, "r0")}{_stump_sql(2, "r1")} SELECT bin_id, round(p, 6) AS predicted_hours FROM r2 WHERE kind = 'last'""",
    "model_manifest": f"""WITH {telemetry.LABELS}, c AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE {telemetry.LEAK}) AS p FROM lab GROUP BY split) SELECT '1' AS model_version, 'naive' AS estimator, '{VAL_FROM}' AS val_from, '{TEST_FROM}' AS test_from, 90.0::DOUBLE AS threshold, '[' || string_agg('{{"split":"' || split || '","n_raw":' || n || ',"n_purged":' || p || '}}', ',' ORDER BY split) || ']' AS counts, 10 AS n_features FROM c""",
    "append_retries": f"WITH {ITEMS_SQL}, la AS (SELECT session_id, result = 'rejected' AND reason = '{REASONS[0]}' AS again FROM item_events QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_us DESC, line DESC, item_id DESC, type DESC, result DESC) = 1) SELECT i.session_id, count(*) + any_value(again::INT) AS n, count(*) FILTER (WHERE result = 'accepted') + any_value(again::INT) AS accepted, CAST(20 * (count(*) FILTER (WHERE result = 'accepted') + any_value(again::INT)) AS BIGINT) AS cents FROM item_events i JOIN la USING (session_id) GROUP BY i.session_id",
    "set_default": f"WITH {METHODS_SQL} SELECT method_id, resident, CASE WHEN resident % 3 = 0 THEN position = 1 ELSE is_default END AS is_default FROM payout_methods",
    "add_methods": f"WITH {METHODS_SQL} SELECT method_id, resident, label, is_default, position FROM payout_methods WHERE resident % 6 <> 0 UNION ALL SELECT c_custkey + 10000000000, c_custkey, 'E-Wallet', c_custkey % 6 = 0, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 2 END FROM customer WHERE c_custkey % 3 = 0",
    "newest_return": f"WITH {SESSIONS_SQL} SELECT resident, session_id, status FROM sessions QUALIFY row_number() OVER (PARTITION BY resident ORDER BY created_us DESC, session_id DESC) = 1",
    "payment_receipts": f"WITH {STATE_SQL}, {METHODS_SQL}, g AS (SELECT method_id, type, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM payout_methods) SELECT ss.session_id, s.resident, CAST(coalesce(ac.n, 0) * 20 AS BIGINT) AS total_cents, 'RM' || format('{{:.2f}}', coalesce(ac.n, 0) * 20 / 100) AS total_text, coalesce(ac.n, 0) AS n_items, CASE WHEN length(g) >= 4 THEN CASE WHEN type = 'bank' THEN 'Bank account' ELSE 'E-Wallet' END || ' •••• ' || right(g, 4) ELSE 'Saved payout method' END AS method, 'TXN-' || ss.session_id AS transaction_id, strftime(make_timestamp(ss.us), '%-d %b %Y, %H:%M') AS paid_text FROM ss JOIN sessions s USING (session_id) LEFT JOIN ac USING (session_id) LEFT JOIN g USING (method_id) WHERE ss.status = 'paid'",
    "create_reports": f"WITH {REPORTS_SQL} SELECT status, count(*) AS n, count(*) FILTER (WHERE hazardous) AS n_hazardous FROM (SELECT status, hazardous FROM reports UNION ALL SELECT 'Submitted', item_id % 2 = 0 FROM benchmark) GROUP BY status UNION ALL SELECT 'Report submitted', count(*), 0 FROM benchmark",
    "attachment_names": "SELECT url, CASE WHEN length(url) % 2 = 1 THEN url || '.png' WHEN length(url) % 4 = 2 THEN 'old.jpg' ELSE '' END AS names FROM pages",
    "receipts": f"WITH {RECEIPTS} SELECT session_id, resident, total_cents, {MONEY} AS total_text, n_items, method, strftime(make_timestamp(created_us), '%-d %b %Y, %H:%M') AS paid_text FROM rc",
    "payout_by_method": f"WITH {RECEIPTS} SELECT method, count(*) AS n_sessions, CAST(sum(total_cents) AS BIGINT) AS total_cents, count(DISTINCT resident) AS n_residents FROM rc GROUP BY method",
    "mask_identifier": f"WITH {METHODS_SQL}, x AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM payout_methods) SELECT method_id, CASE WHEN length(g) >= 4 THEN CASE WHEN type = 'bank' THEN 'Bank account' ELSE 'E-Wallet' END || ' •••• ' || right(g, 4) END AS masked FROM x",
    "default_method": f"WITH {METHODS_SQL} SELECT resident, method_id, n_methods FROM (SELECT resident, method_id, count(*) OVER (PARTITION BY resident) AS n_methods, row_number() OVER (PARTITION BY resident ORDER BY is_default DESC, position) AS k FROM payout_methods) WHERE k = 1",
    "remove_method": f"WITH {METHODS_SQL}, l AS (SELECT *, bool_or(is_default) OVER (PARTITION BY resident) AS has, row_number() OVER (PARTITION BY resident ORDER BY position) AS k FROM payout_methods WHERE method_id % 6 <> 0) SELECT method_id, resident, CASE WHEN has THEN is_default ELSE k = 1 END AS is_default FROM l",
    "recent_returns": f"WITH {SESSIONS_SQL}, x AS (SELECT resident, CASE WHEN status = 'paid' THEN 'paid' ELSE 'open' END AS kind, session_id, created_us FROM sessions) SELECT resident, kind, row_number() OVER w AS place, session_id FROM x WINDOW w AS (PARTITION BY resident, kind ORDER BY created_us DESC, session_id DESC) QUALIFY row_number() OVER w <= CASE WHEN kind = 'paid' THEN 3 ELSE 1 END",
    "payout_notifications": f"WITH {STATE_SQL} SELECT 'payout' AS kind, count(*) FILTER (WHERE session_id % 3 <> 0) AS unread, count(*) AS n FROM ss WHERE status = 'paid'",
    "payout_details": f"WITH {STATE_SQL}, {METHODS_SQL}, g AS (SELECT method_id, type, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM payout_methods) SELECT session_id, 'RM' || format('{{:.2f}}', coalesce(ac.n, 0) * 20 / 100) || ' sent' AS title, 'Return ' || session_id || ' was paid to ' || CASE WHEN length(g) >= 4 THEN CASE WHEN type = 'bank' THEN 'Bank account' ELSE 'E-Wallet' END || ' •••• ' || right(g, 4) ELSE 'the selected method' END || '.' AS detail, ss.us AS created_us FROM ss LEFT JOIN ac USING (session_id) LEFT JOIN g USING (method_id) WHERE status = 'paid'",
    "report_notifications": f"WITH {REPORTS_SQL} SELECT report_id, 'Report submitted' AS title, report_id || ' has been recorded for review.' AS detail, report_id % 4 = 1 AS read FROM reports",
    "reports_by_status": f"WITH {REPORTS_SQL} SELECT report_id, category, created_us FROM reports WHERE status = 'Reviewed'",
    "report_validation": f"WITH {REPORTS_SQL} SELECT report_id, concat_ws(';', CASE WHEN length(trim(location, ' ')) < 5 THEN 'location' END, CASE WHEN length(trim(description, ' ')) < 20 THEN 'description too short' END, CASE WHEN length(trim(description, ' ')) > 500 THEN 'description too long' END) AS reasons, hazardous OR category IN ('Hazardous waste', 'Discarded sharps') AS hazardous FROM reports",
    "report_state": f"WITH {ACTIONS_SQL}, r AS (SELECT report_id, max((us, seq)) FILTER (WHERE action = 'reopen') AS re, count(*) AS n_actions FROM report_actions GROUP BY report_id), f AS (SELECT a.*, r.re FROM report_actions a JOIN r USING (report_id) WHERE r.re IS NULL OR (a.us, a.seq) > r.re) SELECT r.report_id, {STATUSES!r}[1 + least(3, CASE WHEN r.re IS NULL THEN 0 ELSE 1 END + (SELECT count(*) FROM f WHERE f.report_id = r.report_id AND action = 'advance'))] AS status, (SELECT arg_max(rating, (us, seq)) FROM f WHERE f.report_id = r.report_id AND action = 'rate') AS rating, n_actions FROM r",
    "status_track": f"WITH {REPORTS_SQL} SELECT report_id, CAST(i AS BIGINT) AS step, {STATUSES!r}[i + 1] AS name, i < list_position({STATUSES!r}, status) AS done FROM reports, range(4) AS t(i)",
    "open_report": f"WITH {REPORTS_SQL} SELECT resident, report_id, status, category FROM reports WHERE status <> 'Resolved' QUALIFY row_number() OVER (PARTITION BY resident ORDER BY created_us DESC, report_id DESC) = 1",
    "activity_feed": f"WITH {SESSIONS_SQL}, {REPORTS_SQL}, u AS (SELECT resident, 'return' AS kind, session_id AS ref_id, created_us FROM sessions UNION ALL SELECT resident, 'report', report_id, created_us FROM reports) SELECT *, row_number() OVER (PARTITION BY resident ORDER BY created_us DESC, kind, ref_id) AS place FROM u",
    "classify_items": f"SELECT p_partkey, {_rules_sql('p_name', PART_RULES, 'NULL')} AS rule FROM part",
    "rules_join_large": """WITH w AS (SELECT DISTINCT w AS k FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 2), t AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, arg_min(k, {'n': -length(k), 'k': k}) AS rule FROM t JOIN w ON contains(t, k) GROUP BY conv_id, turn) SELECT t.conv_id * 1000 + t.turn AS message, rule FROM t LEFT JOIN h USING (conv_id, turn)""",
    "rules_join": f"SELECT p_partkey, {_rules_sql('p_name', PART_RULES, 'NULL')} AS rule FROM part",
    "reply_intent": f"SELECT conv_id, turn, {_rules_sql('text', REPLY_RULES, repr(REPLY_ELSE)).replace('< 2', '< 0')} AS intent FROM conversations WHERE role = 'user'",
    "faq_search": f"WITH {REPORTS_SQL} SELECT report_id FROM reports WHERE category = 'Missed collection' AND contains(lower(location || ' ' || description), 'license')",
    "faq_categories": f"WITH {REPORTS_SQL} SELECT category, min(report_id) AS first_at FROM reports GROUP BY category UNION ALL SELECT 'All', -1",
    "locations_sorted": "SELECT s_suppkey AS location_id, s_name AS name, abs(s_acctbal) AS distance FROM supplier ORDER BY distance, name",
    "registry_audit": "WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS bundle, p_partkey % 8 AS k FROM part) SELECT bundle, unnest(CASE k WHEN 1 THEN ['checksum differs'] WHEN 2 THEN ['estimator not allowed'] WHEN 3 THEN ['fields missing: model_version'] WHEN 4 THEN ['dependencies empty'] WHEN 5 THEN ['dependency version malformed'] WHEN 6 THEN ['manifest missing', 'estimator not allowed', 'feature list differs', 'dependencies empty', 'checksum differs'] WHEN 7 THEN ['feature list differs'] ELSE [] END) AS failure FROM b",
    "migrate_documents": """SELECT c_custkey AS key, CAST(CASE WHEN c_custkey % 4 = 3 THEN 4 ELSE 3 END AS INTEGER) AS version, CAST(CASE WHEN c_custkey % 4 < 3 THEN 1 + c_custkey % 4 END AS INTEGER) AS from_version, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS user_id, CAST(CASE WHEN c_custkey % 4 < 3 THEN 1 ELSE 0 END AS INTEGER) AS n_reports, CAST(CASE WHEN c_custkey % 4 < 3 AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_attachments, CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 3 <> 0 END AS nearby_bin_alerts, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Bottle' ELSE 'Can' END END AS next_item_type, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey AS VARCHAR) END AS return_id, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_nationkey AS VARCHAR) END AS radius, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Bottle' ELSE 'Can' END END AS new_type, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 2 = 0 THEN '["' || c_mktsegment || '"]' ELSE '[]' END END AS new_attachments, CASE WHEN c_custkey % 4 < 3 THEN '3' END AS new_version, c_custkey % 4 = 3 AS quarantined FROM customer""",
    "kpi_contamination": f"WITH {ITEMS_SQL} SELECT type, count(*) FILTER (WHERE result = 'rejected') AS rejected, count(*) AS inspected, round(count(*) FILTER (WHERE result = 'rejected') / count(*), 9) AS contamination FROM item_events GROUP BY type",
    "kpi_compare": f"WITH {KPIS_SQL} SELECT run, b IS NOT NULL AND p IS NOT NULL AND run % 7 <> 0 AS valid, b IS NOT NULL AND p IS NOT NULL AS complete, CASE WHEN run % 7 <> 0 THEN round(p - b, 2) END AS change, CASE WHEN run % 7 <> 0 THEN round((p - b) * 100 / nullif(abs(b), 0), 6) END AS change_pct FROM pv",
    "paired_runs": f"WITH {KPIS_SQL}, x AS (SELECT p - b AS v FROM pv WHERE p - b IS NOT NULL), y AS (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) * 1.959964 AS h FROM x) SELECT n, round(m, 2) AS mean_diff, round(m - h, 2) AS low, round(m + h, 2) AS high FROM y",
    "route_sums": "SELECT l_suppkey AS route, sum(l_quantity) AS km, round(sum(l_quantity) * 0.4, 6) AS litres, round(sum(l_quantity) * 0.4 * 2.68, 6) AS kg_co2 FROM lineitem GROUP BY l_suppkey",
    "id_patterns": "SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) = CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 4 END AS ok FROM part",
    "recycler_score": f"WITH {SESSIONS_SQL}, {ITEMS_SQL}, n AS (SELECT session_id, count(*) FILTER (WHERE result = 'accepted') AS a, count(*) AS n FROM item_events GROUP BY session_id), x AS (SELECT resident, count(*) AS visits, CAST(coalesce(sum(a), 0) AS BIGINT) AS accepted, CAST(coalesce(sum(n), 0) AS BIGINT) AS inspected, count(*) FILTER (WHERE a = n) AS clean FROM sessions LEFT JOIN n USING (session_id) WHERE created_us BETWEEN {US_2000 - 15_552_000_000_000} AND {US_2000} GROUP BY resident) SELECT *, round((least(1.0, visits / 12) * 0.4 + coalesce(accepted / nullif(inspected, 0), 0) * 0.4 + clean / visits * 0.2) * 100, 6) AS score FROM x",
    "duplicate_scans": f"WITH {ITEMS_SQL} SELECT session_id, item_id, count(*) AS scans FROM item_events GROUP BY ALL HAVING count(*) > 1",
}
