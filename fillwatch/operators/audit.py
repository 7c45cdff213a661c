"""Registry audit of model bundles and migration of versioned application documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.sources.adapters import REASONS

#: Fixed values of the manifest format.
REQUIRED = ["sha256_checksum", "estimator_class", "feature_columns", "model_version", "dependencies"]
ALLOWED_ESTIMATORS = ["LinearRegression", "RandomForestRegressor", "GBTRegressor"]
VERSION = r"^[0-9]+(\.[0-9]+)*$"
_MANIFEST = "sha256_checksum string, estimator_class string, feature_columns array<string>, model_version string, dependencies map<string,string>"
#: Fixed values of the application's document: what it has where a document lacks it.
DEFAULTS = {"auth": {"authenticated": False, "userId": None}, "returns": [], "payoutMethods": [], "notifications": [], "settings": {"nearbyBinAlerts": True, "serviceAlerts": True, "nextItemType": "Can", "nextItemOutcome": "accepted", "rejectedReason": REASONS[0], "failNextPayment": False}}
_DOC = "version int, auth struct<userId:string>, reports array<struct<id:string,attachments:array<string>>>, settings struct<nearbyBinAlerts:boolean,reminders:boolean,nextItemType:string,serviceAlerts:boolean>"


def registry_audit(bundles: DataFrame, artifacts: DataFrame, allowed: list[str] = ALLOWED_ESTIMATORS) -> DataFrame:
    """(bundle, failure): one row for each reason why a bundle must not be loaded; none for a sound one.

    bundles (bundle, manifest JSON text, feature_list); artifacts (bundle, sha256). A manifest that is absent or can't
    be read fails and so do all checks that depend on it by name; nothing passes for want of data. A required field
    that is null counts as missing.
    """
    x = bundles.join(artifacts.select("bundle", F.col("sha256").alias("actual")), "bundle", "left")
    x = x.withColumn("m", F.from_json("manifest", _MANIFEST))
    x = x.withColumn("missing", F.array_compact(F.array(*[F.when(F.col("m")[f].isNull(), F.lit(f)) for f in REQUIRED])))
    no = lambda c: F.coalesce(c, F.lit(True))
    deps = F.col("m.dependencies")
    failures = F.array(
        F.when(F.col("manifest").isNull(), "manifest missing"), F.when(F.col("manifest").isNotNull() & (F.size("missing") > 0), F.concat(F.lit("fields missing: "), F.array_join(F.array_sort("missing"), ","))),
        F.when(no(~F.col("m.estimator_class").isin(allowed)), "estimator not allowed"), F.when(no(F.col("feature_list") != F.col("m.feature_columns")), "feature list differs"),
        F.when(no(F.size(deps) <= 0), "dependencies empty"), F.when(F.exists(F.map_values(deps), lambda v: ~F.coalesce(v.rlike(VERSION), F.lit(False))), "dependency version malformed"),
        F.when(F.col("actual").isNull(), "artifact missing"), F.when(F.col("actual").isNotNull() & no(F.col("actual") != F.col("m.sha256_checksum")), "checksum differs"),
    )
    return x.select("bundle", F.explode(F.filter(failures, lambda f: f.isNotNull())).alias("failure"))


def _completed(m: Column, missing: dict) -> Column:
    """A map of JSON values with further keys where it lacks them."""
    if not missing:
        return m
    more = F.create_map(*[x for k, v in missing.items() for x in (F.lit(k), F.parse_json(F.lit(json.dumps(v))))])
    return F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(m, k)), m)


def _merged(m: Column, new: dict[str, Column]) -> Column:
    """A map of JSON values with some of its keys set anew."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*new)), F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))


def migrate_documents(docs: DataFrame, defaults: dict = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(migrated, quarantine) of documents (key, doc JSON text). Versions 1 to 3 become 3; others stay untouched.

    doc is the whole document in version 3: attachments default to none, nearbyBinAlerts to reminders or else true,
    nextItemType to Can, keys that the document or its settings lack come from `defaults`, and everything else is kept as
    it is, known or not. The original is kept beside it. quarantine (key, version, reason, doc): future-version, or
    read-failed for what is no JSON object or lacks a list of reports or settings.
    """
    x = docs.withColumn("d", F.from_json("doc", _DOC)).withColumn("_v", F.try_parse_json("doc"))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit(""))
    known = F.coalesce(F.col("d.version").isin(1, 2, 3), F.lit(False))
    whole_doc = kind("$.reports").startswith("ARRAY") & kind("$.settings").startswith("OBJECT")
    reason = F.when(~kind("$").startswith("OBJECT"), "read-failed").when(~known, "future-version").when(~whole_doc, "read-failed")
    x = x.withColumn("_reason", reason).drop("_v")
    good = x.where("_reason IS NULL")
    reports = F.transform(F.coalesce("d.reports", F.array().cast("array<struct<id:string,attachments:array<string>>>")), lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["attachments"], F.array().cast("array<string>")).alias("attachments")))
    alerts, kind = F.coalesce("d.settings.nearbyBinAlerts", "d.settings.reminders", F.lit(True)), F.coalesce("d.settings.nextItemType", F.lit("Can"))
    value = lambda c: F.parse_json(F.to_json(c))
    none = F.create_map().cast("map<string,variant>")
    top = F.from_json("doc", "map<string,variant>")
    each = F.coalesce(F.from_json(F.to_json(top["reports"]), "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))
    each = F.transform(each, lambda r: _merged(r, {"attachments": F.coalesce(F.when(~F.is_variant_null(r["attachments"]), r["attachments"]), F.parse_json(F.lit("[]")))}))
    settings = F.coalesce(F.from_json(F.to_json(top["settings"]), "map<string,variant>"), none)
    settings = _merged(_completed(settings, defaults.get("settings", {})), {"nearbyBinAlerts": F.parse_json(alerts.cast("string")), "nextItemType": F.variant_get(value(F.struct(kind.alias("k"))), "$.k", "variant")})
    whole = _merged(_completed(top, {k: v for k, v in defaults.items() if k != "settings"}), {"version": F.parse_json(F.lit("3")), "reports": value(each), "settings": value(settings)})
    migrated = good.select(
        "key", F.lit(3).alias("version"), F.col("d.version").alias("from_version"), F.col("d.auth.userId").alias("user_id"), reports.alias("reports"), alerts.alias("nearby_bin_alerts"), kind.alias("next_item_type"),
        F.to_json(whole).alias("doc"), F.col("doc").alias("original"),
    )
    return migrated, x.where("_reason IS NOT NULL").select("key", F.col("d.version").alias("version"), F.col("_reason").alias("reason"), "doc")
