"""Literal cases of records, rules, audit and migration."""

import json

from pyspark.sql import functions as F

from fillwatch.operators import audit, kpi
from fillwatch.operators import records as R

#: Fixed keyword lists of the disposal guide, as far as these cases need them.
DISPOSAL = [("recycling", ["paper", "cardboard", "glass bottle", "glass jar"]), ("electronics", ["phone", "mobile", "laptop"]), ("hazardous", ["battery", "bulb", "paint"])]


def test_session_total(spark):
    s = spark.createDataFrame([(1,), (2,)], "session_id long")
    i = spark.createDataFrame([(1, "Can", "accepted", None), (1, "Can", "rejected", "Unsupported item"), (1, "Bottle", "accepted", "x")], "session_id long, type string, result string, reason string")
    got = {r.session_id: (r.total_cents, r.total_text) for r in R.session_totals(s, i).collect()}
    assert got == {1: (40, "RM0.40"), 2: (0, "RM0.00")}
    assert [r.reason for r in R.price_items(i).where("result = 'accepted'").collect()] == [None, None]


def test_classification(spark):
    t = spark.createDataFrame([("a broken mobile phone",), ("an old household BATTERY",), ("glass bottle",), ("mystery composite object",), (" x ",), (None,)], "t string")
    assert [r.rule for r in R.first_rule(t, "t", DISPOSAL).collect()] == ["electronics", "hazardous", "recycling", None, None, None]


def test_report_fold(spark):
    acts = [(1, "advance"), (1, "advance"), (1, "advance"), (1, "advance"), (1, "rate"), (2, "advance"), (2, "rate"), (2, "reopen"), (2, "advance"), (3, "rate")]
    df = spark.createDataFrame([(r, a, i % 5 + 1, i, i) for i, (r, a) in enumerate(acts)], "report_id long, action string, rating long, us long, seq long")
    got = {r.report_id: (r.status, r.rating) for r in R.report_state(df).collect()}
    assert got == {1: ("Resolved", 5), 2: ("Assigned", None), 3: ("Submitted", 5)}


def test_validation_limits(spark):
    rows = [("Other waste issue", "12345", "d" * 20), ("Other waste issue", " 1234 ", "d" * 501), ("none", None, None)]
    df = spark.createDataFrame([(*r, [("x", "image/png", "y")]) for r in rows], "category string, location string, description string, attachments array<struct<name:string,mimeType:string,dataUrl:string>>")
    assert [r.reasons for r in R.validate_reports(df).collect()] == [[], ["location", "description too long"], ["category", "location", "description too short"]]
    bad = df.withColumn("attachments", F.array_repeat(F.struct(F.lit("x").alias("name"), F.lit("text/html").alias("mimeType"), F.lit("y").alias("dataUrl")), 4)).limit(1)
    assert R.validate_reports(bad).first().reasons == ["too many attachments", "attachment type"]


def test_masking(spark):
    df = spark.createDataFrame([("12-34 56", "bank"), ("a1b2c3", "wallet"), (None, "bank")], "raw string, kind string")
    assert [r[0] for r in df.select(R.mask_identifier(F.col("raw"), F.col("kind"))).collect()] == ["Bank account •••• 3456", None, None]


def test_audit_never_fails_open(spark):
    good = {"sha256_checksum": "aa", "estimator_class": "GBTRegressor", "feature_columns": ["a"], "model_version": "1", "dependencies": {"x": "1.2"}}
    cases = {"good": good, "zero": good | {"sha256_checksum": "0"}, "dep": good | {"dependencies": {"x": ">=1"}}, "nodeps": good | {"dependencies": {}}, "none": None, "broken": "{", "null": good | {"sha256_checksum": None, "model_version": None}}
    b = spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v), ["a"]) for k, v in cases.items()], "bundle string, manifest string, feature_list array<string>")
    a = spark.createDataFrame([(k, "aa") for k in cases], "bundle string, sha256 string")
    bad = {r.bundle for r in audit.registry_audit(b, a).collect()}
    assert bad == set(cases) - {"good"}
    assert audit.registry_audit(b, a.where("false")).where("failure = 'artifact missing'").count() == len(cases)


def test_migration(spark):
    v2 = json.dumps({"version": 2, "auth": {"userId": "u"}, "reports": [{"id": "r1"}, {"id": "r2", "attachments": ["x"]}], "settings": {"reminders": False}})
    df = spark.createDataFrame([(1, v2), (2, json.dumps({"version": 99})), (3, "not json"), (4, None)], "key long, doc string")
    good, bad = audit.migrate_documents(df)
    (m,) = good.collect()
    assert (m.version, m.user_id, [r.attachments for r in m.reports], m.nearby_bin_alerts, m.next_item_type, m.original) == (3, "u", [[], ["x"]], False, "Can", v2)
    assert {r.key: r.reason for r in bad.collect()} == {2: "future-version", 3: "read-failed", 4: "read-failed"}
    odd = ['{"version": 1, "reports": [], "settings": null}', '{"version": 2, "settings": {}}', '{"version": 3, "reports": {}, "settings": {}}', "[1]", '{"version": 0, "reports": 5}', '{"reports": [], "settings": {}}']
    good, bad = audit.migrate_documents(spark.createDataFrame(list(enumerate(odd)), "key long, doc string"))
    assert good.collect() == [] and [r.reason for r in bad.orderBy("key").collect()] == ["read-failed"] * 4 + ["future-version"] * 2
    (m,) = audit.migrate_documents(spark.createDataFrame([(1, '{"version": 1, "reports": [], "settings": {"serviceAlerts": null}, "returns": [1]}')], "key long, doc string"))[0].collect()
    assert json.loads(m.doc) == audit.DEFAULTS | {"version": 3, "reports": [], "returns": [1], "settings": audit.DEFAULTS["settings"] | {"serviceAlerts": None}}
    whole = {"version": 1, "auth": {"userId": "u", "n": 1.5}, "reports": [{"id": "r", "attachments": None, "place": "a\"b"}, {"id": "s", "attachments": [{"name": "x"}], "rating": 3}], "settings": {"serviceAlerts": False, "failNextPayment": True, "nearbyBinAlerts": False}, "returns": [{"id": 7, "events": []}], "payoutMethods": [], "extra": {"k": [1, None, "x"]}}
    (m,) = audit.migrate_documents(spark.createDataFrame([(1, json.dumps(whole))], "key long, doc string"))[0].collect()
    assert json.loads(m.doc) == whole | {"version": 3, "notifications": [], "reports": [whole["reports"][0] | {"attachments": []}, whole["reports"][1]], "settings": audit.DEFAULTS["settings"] | whole["settings"]}


def test_kpi_zero_baseline(spark):
    df = spark.createDataFrame([("r", "m", "baseline", 0.0, "a"), ("r", "m", "priority", 5.0, "a"), ("q", "m", "baseline", 1.0, "a"), ("q", "m", "priority", 5.0, "b")], "run string, metric string, mode string, value double, setup string")
    got = {r.run: (r.valid, r.change, r.change_pct) for r in kpi.compare(df).collect()}
    assert got == {"r": (True, 5.0, None), "q": (False, None, None)}


def test_empty_inputs(spark):
    s, i = spark.createDataFrame([], "session_id long, resident long, status string, created_us long"), spark.createDataFrame([], "session_id long, type string, result string, reason string, created_us long, item_id long, line long")
    for out in (R.session_totals(s, i), R.session_counts(s, i), R.event_log(i), R.recoverable_sessions(i), R.recent_returns(s), kpi.duplicate_scans(i)):
        assert out.count() == 0
