"""Plan checks: no row-at-a-time Python UDFs, no cartesian
products or nested-loop joins in any registered query with an SQL oracle, and
filters/projections reach the Parquet scan."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_python_udf_or_cross_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"


def test_scan_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F

    from spate.plans import tables

    df = tables.table(spark, SF_SMALL, "events").filter(F.col("event_type") == "click").select("event_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def _optimized_and_physical(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString() + "\n" + qe.executedPlan().toString()


def test_first_row_per_key_is_partially_aggregated(spark):
    """A hot key is combined map-side: the plan has a partial min_by aggregate
    before the exchange, not a window over the whole group."""
    plan = _plan(entry.queries()["one_per_user_week"](spark, SF_SMALL))
    assert "partial_min_by" in plan and "Window" not in plan


def test_cleaning_evaluated_once(spark):
    """The cleaned text is produced by a Generate (with_computed), so the
    empty-text filter does not inline and re-run the cleaning expression."""
    plan = _optimized_and_physical(entry.queries()["clean_posts"](spark, SF_SMALL))
    assert "Generate explode(array(trim(regexp_replace" in plan
    assert plan.count("regexp_replace(lower(") == 2  # one in the optimised, one in the physical plan


def test_session_defaults_enable_aqe_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
