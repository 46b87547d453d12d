"""What the plans must not contain, and what must reach the scan."""

import pytest
from pyspark.sql import functions as F
from logweave.operators import analytics as A
from logweave.plans import load_queries
from logweave.plans.base import logs

QUERIES, _ = load_queries()
# built without running a fit or a stream first
LAZY = sorted(n for n in QUERIES if not any(w in n for w in (
    "stream", "iforest", "cluster", "novel", "pattern_anomaly", "live_tail", "tail_filter", "write_", "dead_letter", "compact",
    "refresh", "save_", "export", "score_services", "read_log", "train_all", "search_index")))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_row_udfs(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in text, word


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(A.error_rate_series(logs(spark, sf), start="2024-01-05", end="2024-01-06"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThanOrEqual(ts,2024-01-06T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    rows = logs(spark, sf)
    assert "WindowGroupLimit" in plan(A.recent_errors(rows))
    assert "TakeOrderedAndProject" in plan(A.top_error_services(rows))


def test_ingest_has_no_shuffle(spark, sf):
    from logweave.operators.ingest import auto_parse, normalize_entry
    text = plan(normalize_entry(auto_parse(logs(spark, sf).select(F.col("message").alias("value")))))
    assert "Exchange" not in text
