"""Service records: container returns, payouts, issue reports, notifications, keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.session import TASK_ROWS, fitting, spread, stored
from fillwatch.sources.adapters import CATEGORIES, REASONS, STATUSES

VALUE_CENTS = 20
HAZARDS = ("Hazardous waste", "Discarded sharps")
MIME_TYPES = ("image/jpeg", "image/png", "image/webp")


def price_items(items: DataFrame, value_cents: int = VALUE_CENTS) -> DataFrame:
    """value_cents for accepted items, 0 for rejected ones, which alone keep a reason."""
    ok = F.col("result") == "accepted"
    return items.withColumn("value_cents", F.when(ok, value_cents).otherwise(0).cast("long")).withColumn("reason", F.when(~ok, F.col("reason")))


def money(cents: Column) -> Column:
    return F.format_string("RM%.2f", cents / 100.0)


def date_text(micros: Column) -> Column:
    """A fixed pattern, not the reader's locale."""
    return F.date_format(F.timestamp_micros(micros), "d MMM yyyy, HH:mm")


def session_totals(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Cents and their text for every session; 0 without items. Items are summed before the join."""
    sums = price_items(items).groupBy("session_id").agg(F.sum("value_cents").alias("total_cents"))
    out = sessions.select("session_id").join(sums, "session_id", "left").select("session_id", F.coalesce("total_cents", F.lit(0)).cast("long").alias("total_cents"))
    return out.withColumn("total_text", money(F.col("total_cents")))


def session_counts(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Accepted, rejected, cans, bottles, all, and the progress bar of ten accepted items."""
    ok = F.col("result") == "accepted"
    n = items.groupBy("session_id").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & (F.col("type") == "Can")).alias("cans"), F.count_if(ok & (F.col("type") == "Bottle")).alias("bottles"), F.count(F.lit(1)).alias("n_events"))
    cols = ["accepted", "rejected", "cans", "bottles", "n_events"]
    out = sessions.select("session_id").join(n, "session_id", "left").fillna(0, cols)
    return out.withColumn("progress_pct", F.least(F.lit(100), F.col("accepted") * 10).cast("long"))


ITEM_ORDER = ["created_us", "line", "item_id", "type", "result"]


def event_log(items: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Items of each session, newest first, with their running number (the oldest is 1). A task sorts about task_rows at most."""
    w = Window.partitionBy("session_id").orderBy(*ITEM_ORDER)
    return spread(items, "session_id", rows=task_rows).withColumn("number", F.row_number().over(w).cast("long"))


def recoverable_sessions(items: DataFrame) -> DataFrame:
    """The latest item of each session, and whether it may be scanned again (an unreadable barcode)."""
    last = items.groupBy("session_id").agg(F.max_by(F.struct("type", "result", "reason"), F.struct(*ITEM_ORDER)).alias("x")).select("session_id", "x.*")
    return last.withColumn("recoverable", F.coalesce((F.col("result") == "rejected") & (F.col("reason") == REASONS[0]), F.lit(False)))


def retried_items(items: DataFrame) -> DataFrame:
    """Rejected items that an accepted one of the same type follows directly; both stay in the log."""
    w = Window.partitionBy("session_id").orderBy(*ITEM_ORDER)
    x = spread(items, "session_id").withColumn("next_result", F.lead("result").over(w)).withColumn("next_type", F.lead("type").over(w))
    return x.where((F.col("result") == "rejected") & (F.col("reason") == REASONS[0]) & (F.col("next_result") == "accepted") & (F.col("next_type") == F.col("type"))).drop("next_result", "next_type")


def append_retries(items: DataFrame, retries: DataFrame) -> DataFrame:
    """The log with an accepted, priced item for each retry (session_id, type, created_us); the rejected ones stay."""
    again = retries.select("session_id", "type", "created_us").withColumn("result", F.lit("accepted")).withColumn("reason", F.lit(None).cast("string"))
    return price_items(items.unionByName(again, allowMissingColumns=True))


def session_state(sessions: DataFrame, items: DataFrame, finished: DataFrame, payments: DataFrame) -> DataFrame:
    """active, awaiting-payout once finished with an accepted item, paid after the first successful payment.

    finished (session_id); payments (session_id, us, ok, method_id): failed attempts change nothing, of the successful
    ones the first gives paid_at, method and transaction.
    """
    n = items.groupBy("session_id").agg(F.count_if(F.col("result") == "accepted").alias("accepted"))
    paid = payments.where("ok").groupBy("session_id").agg(F.min_by(F.struct("us", "method_id"), F.struct("us", "method_id")).alias("p"))
    tries = payments.groupBy("session_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("failed"))
    done = finished.select("session_id").distinct().withColumn("done", F.lit(True))
    x = sessions.select("session_id").join(n, "session_id", "left").join(done, "session_id", "left").join(paid, "session_id", "left").join(tries, "session_id", "left")
    waiting = F.coalesce("done", F.lit(False)) & (F.coalesce("accepted", F.lit(0)) >= 1)
    state = F.when(waiting & F.col("p").isNotNull(), "paid").when(waiting, "awaiting-payout").otherwise("active")
    x = x.withColumn("status", state)
    when_paid = lambda c: F.when(F.col("status") == "paid", c)
    return x.select("session_id", "status", when_paid(F.col("p.us")).alias("paid_us"), when_paid(F.col("p.method_id")).alias("method_id"), when_paid(F.concat(F.lit("TXN-"), F.col("session_id").cast("string"))).alias("transaction_id"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("failed", F.lit(0)).alias("failed"))


def mask_identifier(raw: Column, kind: Column) -> Column:
    """Digits only, at least four of them, of which the last four show."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    name = F.when(kind == "bank", "Bank account").otherwise("E-Wallet")
    return F.when(F.length(digits) >= 4, F.concat(name, F.lit(" •••• "), F.right(digits, F.lit(4))))


def default_method(methods: DataFrame) -> DataFrame:
    """Each resident's default payout method: the marked one, else the first by position."""
    m = methods.groupBy("resident").agg(F.min_by("method_id", F.when(F.col("is_default"), F.struct("position", "method_id"))).alias("marked"), F.min_by("method_id", F.struct("position", "method_id")).alias("first"), F.count(F.lit(1)).alias("n_methods"))
    return m.select("resident", F.coalesce("marked", "first").alias("method_id"), "n_methods")


def remove_method(methods: DataFrame, removed: DataFrame) -> DataFrame:
    """Methods without the removed ids; where the default went, the first that remains becomes it."""
    left = methods.join(removed.select("method_id").distinct(), "method_id", "left_anti")
    whole = Window.partitionBy("resident")
    first = F.row_number().over(whole.orderBy("position", "method_id")) == 1
    return left.withColumn("is_default", F.when(F.max("is_default").over(whole), F.col("is_default")).otherwise(first))


def set_default(methods: DataFrame, chosen: DataFrame) -> DataFrame:
    """Methods after each resident of chosen (resident, method_id) has set a default: that one alone is it."""
    c = chosen.groupBy("resident").agg(F.max("method_id").alias("_chosen"))
    x = methods.hint("merge").join(c, "resident", "left")
    return x.withColumn("is_default", F.when(F.col("_chosen").isNull(), F.col("is_default")).otherwise(F.col("method_id") == F.col("_chosen"))).select(*methods.columns)


def add_methods(methods: DataFrame, added: DataFrame) -> DataFrame:
    """Methods with those added behind them, in the order of their ids; a resident's first one becomes the default."""
    end = methods.groupBy("resident").agg((F.max("position") + 1).alias("_end"))
    k = F.row_number().over(Window.partitionBy("resident").orderBy("method_id")) - 1
    new = added.hint("merge").join(end, "resident", "left").withColumn("position", (F.coalesce("_end", F.lit(0)) + k).cast("long"))
    new = new.withColumn("is_default", F.col("position") == 0).withColumn("label", F.when(F.col("type") == "bank", "Bank Transfer").otherwise("E-Wallet"))
    return methods.unionByName(new.drop("_end"), allowMissingColumns=True)


def newest_return(sessions: DataFrame) -> DataFrame:
    """Each resident's newest return, whatever its status."""
    return sessions.groupBy("resident").agg(F.max_by(F.struct("session_id", "status"), F.struct("created_us", "session_id")).alias("s")).select("resident", "s.*")


def payment_receipts(sessions: DataFrame, items: DataFrame, methods: DataFrame, state: DataFrame) -> DataFrame:
    """One row for each session paid by its state: total, accepted items, the masked method it was paid to, transaction and time of payment.

    A method that is gone reads "Saved payout method", a missing transaction "TXN-DEMO"; without a time of payment the creation counts.
    """
    tot = price_items(items).groupBy("session_id").agg(F.sum("value_cents").alias("c"), F.count_if(F.col("result") == "accepted").alias("n"))
    to = methods.select("method_id", mask_identifier(F.col("raw"), F.col("type")).alias("to"))
    paid = state.where("status = 'paid'").select("session_id", "paid_us", "method_id", "transaction_id")
    x = sessions.select("session_id", "resident", "created_us").hint("merge").join(paid, "session_id").join(tot, "session_id", "left").hint("merge").join(to, "method_id", "left")
    return x.select(
        "session_id", "resident", F.coalesce("c", F.lit(0)).cast("long").alias("total_cents"), money(F.coalesce("c", F.lit(0))).alias("total_text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("to", F.lit("Saved payout method")).alias("method"), F.coalesce("transaction_id", F.lit("TXN-DEMO")).alias("transaction_id"), date_text(F.coalesce("paid_us", "created_us")).alias("paid_text"),
    )


def create_reports(reports: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports with the new ones, which start as the first status and hazardous where their category is, and their notifications."""
    entered = flag_hazards(new.withColumn("status", F.lit(STATUSES[0])))
    return reports.unionByName(entered, allowMissingColumns=True), report_notifications(entered)


def attachment_names(reports: DataFrame) -> DataFrame:
    """names: those of the attachments, or where there are none the file names of older reports; none if both are null or empty."""
    empty = F.array().cast("array<string>")
    names = F.coalesce(F.transform("attachments", lambda a: a["name"]), empty)
    return reports.withColumn("names", F.when(F.size(names) > 0, names).otherwise(F.coalesce("image_names", empty)))


def receipts(sessions: DataFrame, items: DataFrame, methods: DataFrame) -> DataFrame:
    """Paid sessions with total, item count, method text (or "Saved payout method"), and paid_at or else creation time."""
    tot = price_items(items).groupBy("session_id").agg(F.sum("value_cents").alias("c"), F.count(F.lit(1)).alias("n"))
    chosen = default_method(methods).join(methods.select("method_id", "label"), "method_id", "left").select("resident", "label")
    x = sessions.where("status = 'paid'").join(tot, "session_id", "left").join(chosen, "resident", "left")
    return x.select("session_id", "resident", F.coalesce("c", F.lit(0)).cast("long").alias("total_cents"), money(F.coalesce("c", F.lit(0))).alias("total_text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("label", F.lit("Saved payout method")).alias("method"), date_text(F.col("created_us")).alias("paid_text"))


def payout_by_method(sessions: DataFrame, items: DataFrame, methods: DataFrame) -> DataFrame:
    r = receipts(sessions, items, methods)
    return r.groupBy("method").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("total_cents").alias("total_cents"), F.count_distinct("resident").alias("n_residents"))


def recent_returns(sessions: DataFrame, n: int = 3) -> DataFrame:
    """The last n paid sessions of each resident, and the newest one that isn't paid (kind open)."""
    w = Window.partitionBy("resident", "kind").orderBy(F.desc("created_us"), F.desc("session_id"))
    x = sessions.withColumn("kind", F.when(F.col("status") == "paid", "paid").otherwise("open")).withColumn("place", F.row_number().over(w).cast("long"))
    return x.where(F.col("place") <= F.when(F.col("kind") == "paid", n).otherwise(1)).select("resident", "kind", "place", "session_id")


def open_report(reports: DataFrame) -> DataFrame:
    """Each resident's newest report that isn't resolved."""
    r = reports.where(F.col("status") != STATUSES[-1]).groupBy("resident").agg(F.max_by(F.struct("report_id", "status", "category"), F.struct("created_us", "report_id")).alias("r"))
    return r.select("resident", "r.*")


def activity_feed(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Returns and reports as one feed, newest first within a resident."""
    a = sessions.select("resident", F.lit("return").alias("kind"), F.col("session_id").alias("ref_id"), "created_us")
    both = a.unionByName(reports.select("resident", F.lit("report").alias("kind"), F.col("report_id").alias("ref_id"), "created_us"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("resident").orderBy(F.desc("created_us"), "kind", "ref_id")).cast("long"))


def by_status(reports: DataFrame, status: str) -> DataFrame:
    """Reports of a status; "All" is any."""
    return reports if status == "All" else reports.where(F.col("status") == status)


def flag_hazards(reports: DataFrame) -> DataFrame:
    return reports.withColumn("hazardous", F.col("hazardous") | F.col("category").isin(*HAZARDS))


def validate_reports(reports: DataFrame) -> DataFrame:
    """reasons: why a report can't be sent; empty for valid ones. Attachments are checked where the column exists."""
    place, text = F.length(F.trim(F.coalesce("location", F.lit("")))), F.length(F.trim(F.coalesce("description", F.lit(""))))
    rules = [F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category"), F.when(place < 5, "location"), F.when(text < 20, "description too short"), F.when(text > 500, "description too long")]
    if "attachments" in reports.columns:
        a = F.coalesce("attachments", F.array().cast(reports.schema["attachments"].dataType))
        rules += [F.when(F.size(a) > 3, "too many attachments"), F.when(F.exists(a, lambda x: F.length(x["dataUrl"]) > 900_000), "attachment too large"), F.when(F.exists(a, lambda x: ~x["mimeType"].isin(*MIME_TYPES)), "attachment type")]
    return reports.withColumn("reasons", F.filter(F.array(*rules), lambda x: x.isNotNull()))


def report_state(actions: DataFrame) -> DataFrame:
    """Status and rating of each report after all its actions, in closed form.

    advance moves one step up to the last; reopen goes back to the second and clears the rating; of the ratings after
    that the latest counts. One window for the last reopening, then one aggregate.
    """
    w = Window.partitionBy("report_id")
    last = F.max(F.when(F.col("action") == "reopen", F.struct("us", "seq"))).over(w)
    x = actions.withColumn("_re", last)
    after = F.col("_re").isNull() | (F.struct("us", "seq") > F.col("_re"))
    n = x.groupBy("report_id").agg(F.count_if(after & (F.col("action") == "advance")).alias("ups"), F.max(F.col("_re").isNotNull()).alias("reopened"), F.max_by("rating", F.when(after & (F.col("action") == "rate"), F.struct("us", "seq"))).alias("rating"), F.count(F.lit(1)).alias("n_actions"))
    step = F.least(F.lit(len(STATUSES) - 1), F.col("reopened").cast("int") + F.col("ups")).cast("int")
    return n.select("report_id", F.element_at(F.array(*map(F.lit, STATUSES)), step + 1).alias("status"), F.col("rating").cast("long").alias("rating"), "n_actions")


def status_track(reports: DataFrame) -> DataFrame:
    """Each step of a report's way and whether it is done."""
    steps = F.array(*map(F.lit, STATUSES))
    x = reports.select("report_id", F.array_position(steps, F.col("status")).alias("at"), F.posexplode(steps).alias("step", "name"))
    return x.select("report_id", F.col("step").cast("long").alias("step"), "name", (F.col("step") < F.col("at")).alias("done"))


def payout_notifications(paid: DataFrame, totals: DataFrame, methods: DataFrame) -> DataFrame:
    """Unread payout notifications of paid sessions (session_state and session_totals), with the masked method paid to, or "the selected method" where it is gone."""
    to = methods.select("method_id", mask_identifier(F.col("raw"), F.col("type")).alias("to"))
    x = paid.where("status = 'paid'").hint("merge").join(totals.select("session_id", "total_text"), "session_id").hint("merge").join(to, "method_id", "left")
    detail = F.concat(F.lit("Return "), F.col("session_id").cast("string"), F.lit(" was paid to "), F.coalesce("to", F.lit("the selected method")), F.lit("."))
    return x.select("session_id", F.concat("total_text", F.lit(" sent")).alias("title"), detail.alias("detail"), F.col("paid_us").alias("created_us"), F.lit(False).alias("read"), F.lit("payout").alias("kind"))


def report_notifications(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", F.lit("Report submitted").alias("title"), F.concat(F.col("report_id").cast("string"), F.lit(" has been recorded for review.")).alias("detail"), "created_us", F.lit(False).alias("read"), F.lit("report").alias("kind"))


def mark_read(notifications: DataFrame, read: DataFrame | None, key: str) -> DataFrame:
    """All notifications, those of `read` (or all, for None) as read."""
    if read is None:
        return notifications.withColumn("read", F.lit(True))
    r = read.select(F.col(key).alias("_k")).distinct()
    return notifications.join(r, F.col(key) == F.col("_k"), "left").withColumn("read", F.col("read") | F.col("_k").isNotNull()).drop("_k")


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("kind").agg(F.count_if(~F.col("read")).alias("unread"), F.count(F.lit(1)).alias("n"))


def first_rule(texts: DataFrame, text_col: str, rules: list[tuple[str, list[str]]], otherwise: str | None = None, min_length: int = 2, out: str = "rule") -> DataFrame:
    """The first rule any of whose keywords stands in the lower-cased text; texts below min_length match none.

    The table of rules is part of the expression: no join, each text is looked at once.
    """
    t, chosen = F.lower(F.trim(F.col(text_col))), F.lit(otherwise).cast("string")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        chosen = F.when(hit, name).otherwise(chosen)
    return texts.withColumn(out, F.when(F.length(t) >= min_length, chosen).otherwise(F.lit(otherwise).cast("string")))


def _outside(words: DataFrame) -> str:
    """A pattern for the characters that no keyword has; as many characters come to the driver as keywords differ in."""
    chars = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.substring("k", i, 1))).alias("c")).distinct()
    return "[^" + "".join(f"\\x{{{ord(r.c):x}}}" for r in chars.orderBy("c").collect()) + "]+"


def _substrings(pieces: DataFrame, words: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, k): the substrings of pieces (id, p) that may be keywords (words.k, of these lengths).

    Of lengths from b to 2b - 1, b a power of two, only those whose first b characters begin a keyword: a semi-join, which
    makes no rows. So their number is at most that of the pieces' substrings of these lengths, however many keywords
    share a part.
    """
    found = None
    for b in sorted({1 << n.bit_length() - 1 for n in lengths}):
        of = [n for n in lengths if b <= n < 2 * b]
        starts = F.transform(F.sequence(F.lit(1), F.length("p") - of[0] + 1), lambda i: F.substring("p", i, F.lit(of[-1])))  # noqa: B023
        x = pieces.where(F.length("p") >= of[0]).select("id", F.explode(F.array_distinct(starts)).alias("s"))
        begins = words.where(F.length("k").between(b, 2 * b - 1)).select(F.left("k", F.lit(b)).alias("g")).distinct()
        x = x.withColumn("g", F.left("s", F.lit(b))).join(fitting(stored(begins, "begins")), "g", "left_semi")
        x = x.select("id", F.explode(F.array(*[F.when(F.length("s") >= n, F.left("s", F.lit(n))) for n in of])).alias("k")).where("k IS NOT NULL")
        found = x if found is None else found.unionByName(x)
    return found


def rules_join(texts: DataFrame, key: str, text_col: str, rules: DataFrame, min_length: int = 2) -> DataFrame:
    """(key, rule) of every text: first_rule() with the rules as a table (rule_order, rule_id, keywords) of any size.

    A keyword is one row with its first rule. Texts are parted where they have characters that no keyword has; a piece is
    searched once, however many texts have it. Its substrings meet keywords by equality alone, so a row meets one keyword
    at most and work grows with the pieces' lengths, not with texts times keywords. Keywords are broadcast if they are few
    by count. Null texts match nothing; rows repeated with a key and text have the same rule.
    """
    text = F.lower(F.trim(F.col(text_col)))
    t = texts.select(F.col(key).alias("key"), text.alias("t")).withColumn("h", F.xxhash64("t"))
    words = stored(rules.select(F.struct("rule_order", "rule_id").alias("r"), F.explode("keywords").alias("k")).where("k <> ''").groupBy("k").agg(F.min("r").alias("r")), "keywords")
    lengths = sorted(r.n for r in words.select(F.length("k").alias("n")).distinct().collect())
    if not lengths:
        return t.select(F.col("key").alias(key), F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule"))
    every = t.where(F.length("t") >= min_length).distinct()
    has = stored(every.select("key", "h", F.explode(F.array_distinct(F.split("t", _outside(words)))).alias("p")).where(F.length("p") >= lengths[0]), "has")
    pieces = stored(has.select("p").distinct().withColumn("id", F.monotonically_increasing_id()), "pieces")
    hits = _substrings(pieces, words, lengths).join(fitting(words), "k").groupBy("id").agg(F.min("r").alias("r"))
    first = stored(hits.hint("merge").join(pieces, "id").select("p", "r"), "first")
    best = has.hint("merge").join(first, "p").groupBy("key", "h").agg(F.min("r").alias("r")).select(F.col("key").alias("_k"), F.col("h").alias("_h"), F.col("r.rule_id").alias("rule"))
    best = stored(best, "best")
    return t.hint("merge").join(best, t.key.eqNullSafe(best._k) & t.h.eqNullSafe(best._h), "left").select(F.col("key").alias(key), "rule")


def faq_search(items: DataFrame, query: str, category: str = "All") -> DataFrame:
    """Entries of a category ("All": any) whose question and answer contain the query, whatever the case."""
    text = F.lower(F.concat_ws(" ", "question", "answer"))
    out = items.where(text.contains(query.lower()))
    return out if category == "All" else out.where(F.col("category") == category)


def faq_categories(items: DataFrame, position: str) -> DataFrame:
    """Categories in the order in which they first appear, after "All"."""
    c = items.groupBy("category").agg(F.min(position).alias("first_at"))
    return c.unionByName(items.sparkSession.createDataFrame([("All", -1)], "category string, first_at long"))
