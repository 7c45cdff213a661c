"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import builtins
import os
import sys

import pytest

import __spark_entry__ as entry
from fillwatch.operators import models
from fillwatch.operators.features import FEATURES
from fillwatch.plans import service, streams, telemetry
from fillwatch.sources.adapters import TEST_FROM, VAL_FROM
from tests.sql_compare import assert_same, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't there")
SQL = telemetry.ORACLES | service.ORACLES | streams.ORACLES
PY = telemetry.QUERIES | service.QUERIES | streams.QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert_same(PY[name](spark, SF), SQL[name], con)


def test_all_sql_has_a_query():
    assert set(SQL) <= set(PY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"bin_id", "status", "hours", "risk_level"} <= set(df.columns)


def test_model_comparison(spark):
    rows = PY["model_comparison"](spark, SF).collect()
    assert {r.model for r in rows} == {"linear", "forest", "boosted", "naive"} and {r.split for r in rows} <= {"val", "test"}
    assert all(r.n_rows > 0 and 0 <= r.risk_accuracy <= 1 and r.mae_hours <= r.rmse_hours for r in rows)
    top = PY["feature_importance"](spark, SF).collect()
    assert {r.feature for r in top} == set(FEATURES) and abs(sum(r.importance for r in top) - 1) < 1e-9


def test_entry_hides_no_missing_module(monkeypatch):
    """A missing corpus part is left out; anything else that can't be imported is an error."""
    pytest.importorskip("fillwatch.llm")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_models_compute_their_rows_once(spark):
    """However many models and passes: the rows come from the log once."""
    x = telemetry.split(spark, SF)
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for b in parts:
            seen.add(b.num_rows)
            yield b

    models.train_and_compare(x.mapInArrow(count, x.schema), VAL_FROM, TEST_FROM, {"linear": {}})[0].collect()
    assert seen.value == x.count()
