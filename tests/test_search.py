"""Search on a small corpus: terms, stems, paging, the two ways, suggestions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from logweave.functions.text import stem
from logweave.operators import filters as X
from logweave.operators import search as S

MESSAGES = (
    ["connection timeout to db", "timeouts while connecting", "Timeout: connected late"] + ["user logged in"] * 4
    + ["disk full on node"] * 3 + ["payment declined 100%", "the and of", "10.0.0.1 refused", "10.0.0.2 refused", "a_b wild"]
)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), "ERROR" if i % 2 else "INFO",
             "auth-service" if i % 3 else "pay", m, None if i % 5 == 0 else f"node-{i % 2}") for i, m in enumerate(MESSAGES)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, level string, service_name string, message string, host string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ["trace_id", "span_id", "environment", "metadata", "error_fingerprint"]}).withColumn(
        "ingested_at", F.col("timestamp"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("q", ["timeouts", "connect TIMEOUT", "the timeout", "auth-service disk", "10.0.0.1", "logging user", "error full", "nothing such", "the of", "a_b"])
def test_index_equals_scan(spark, corpus, q):
    scan = {(r["id"], r["rank"]) for r in S.matching(corpus, q).collect()}
    index = {(r["id"], r["rank"]) for r in S.matching(corpus, q, S.build_search_index(corpus)).collect()}
    assert scan == index


def test_stems_and_stop_words(corpus):
    assert ids(S.matching(corpus, "timeout")) == [0, 1, 2]
    assert ids(S.matching(corpus, "connections")) == [0, 1, 2]
    assert ids(S.matching(corpus, "timeout db")) == [0]
    assert ids(S.matching(corpus, "the of and")) == []
    assert ids(S.matching(corpus, "10.0.0.1")) == [12]


def test_pages_and_order(corpus):
    first, second = (S.search(corpus, page=p, page_size=6).collect() for p in (1, 2))
    assert [r["id"] for r in first + second] == list(range(len(MESSAGES) - 1, len(MESSAGES) - 13, -1))
    total = S.count_search(corpus, page_size=6).first()
    assert (total["total"], total["total_pages"]) == (15, 3)
    deep = S.search(corpus, page_size=6, after=(first[-1]["timestamp"], first[-1]["id"])).collect()
    assert [r["id"] for r in deep] == [r["id"] for r in second]
    hosts = [r["host"] for r in S.search(corpus, sort_by="host", sort_order_="asc").collect()]
    assert hosts[-3:] == [None] * 3 and hosts[:-3] == sorted(hosts[:-3])
    with pytest.raises(ValueError):
        S.search(corpus, sort_by="message")
    with pytest.raises(ValueError):
        S.search(corpus, levels="LOUD")


def test_filters_take_wildcards_literally(corpus):
    assert ids(X.filter_ilike(corpus, "100%")) == [10]
    assert ids(X.filter_ilike(corpus, "a_b")) == [14]


def test_suggest(corpus):
    rows = [(r["type"], r["suggestion"]) for r in S.suggest(corpus, "NODE", 10).collect()]
    assert rows == [("host", "node-0"), ("host", "node-1"), ("message", "disk full on node")]
    assert S.suggest(corpus, "  ").count() == 0
    assert S.suggest(corpus, "NODE", 0).count() == 0


def test_suggest_scans_once_and_sends_few_messages(spark, sf):
    """Whole messages as keys: equal to a plain aggregation, one scan, and a task sends at most the limit."""
    from logweave.plans.base import logs
    rows = logs(spark, sf).withColumn("message", F.concat(F.lit("a"), F.pmod(F.col("id") * 7919, F.lit(400)).cast("string")))
    got = S.suggest(rows, "a", 30)
    want = sorted({("service", r[0]) for r in rows.select("service_name").distinct().collect() if "a" in r[0]}
                  | {("host", r[0]) for r in rows.select("host").distinct().collect() if r[0] and "a" in r[0]}
                  | set(sorted({("message", r[0]) for r in rows.select("message").collect()})[:30]))[:30]
    assert [(r["type"], r["suggestion"]) for r in got.collect()] == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    for tasks in (1, 5):
        sent = [tuple(r) for r in rows.repartition(tasks).select(
            F.lit(None).cast("string").alias("service_key"), F.col("message").alias("message_key"), F.lit(None).cast("string").alias("host_key"),
            F.col("message").alias("shown"), F.col("timestamp").alias("at"), "id").mapInArrow(
                S._first_keys(30), "key string, suggestion string, at timestamp_ntz, id long, type string").collect()]
        assert len(sent) <= 30 * tasks


def test_highlight(corpus):
    got = S.highlight(S.matching(corpus, "timeout connect"), "timeout connect", before="[", after="]")
    assert sorted(r["message"] for r in got.collect()) == [
        "[Timeout]: [connected] late", "[connection] [timeout] to db", "[timeouts] while [connecting]"]


def test_trigrams(corpus):
    assert ids(S.trigram_search(corpus, S.trigram_index(corpus), "Disk f")) == [7, 8, 9]
    assert ids(S.trigram_search(corpus, S.trigram_index(corpus), "%")) == [10]


@pytest.mark.parametrize("words", ["caresses:caress ponies:poni feed:feed agreed:agre plastered:plaster motoring:motor sing:sing",
                                   "conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat",
                                   "conditional:condit rational:ration vietnamization:vietnam operator:oper hopefulness:hope",
                                   "triplicate:triplic electrical:electr adjustment:adjust adoption:adopt effective:effect rate:rate cease:ceas controlling:control roll:roll"])
def test_stems(spark, words):
    pairs = [tuple(p.split(":")) for p in words.split()]
    df = spark.createDataFrame(pairs, "w string, expected string").withColumn("got", stem("w"))
    assert df.where("got <> expected").collect() == []


def test_metadata_filters(spark):
    df = spark.createDataFrame([
        (1, '{"a":1,"b":{"c":"x","d":[1,{"e":2}]},"f":null,"g":true}'), (2, '{"a":"1"}'), (3, "broken"), (4, None), (5, '{"a":1.0}')], "id long, metadata string")
    check = lambda wanted: ids(X.filter_metadata(df, wanted))
    assert check({"a": 1}) == [1, 5]
    assert check("a=1") == [2]
    assert check({"b": {"c": "x"}}) == [1]
    assert check({"b": {"d": [{"e": 2}]}}) == [1]
    assert check({"b": {"d": [3]}}) == []
    assert check({"f": None, "g": True}) == [1]
    assert check('{"b": {}}') == [1]


def test_pages_after_a_row_follow_every_sort_column(corpus):
    for field in ["host", "level", "id", "environment", "timestamp"]:
        for order in ["asc", "desc"]:
            whole = S.search(corpus, page_size=1000, sort_by=field, sort_order_=order).collect()
            for at in (0, len(whole) // 2, len(whole) - 2):
                rest = S.search(corpus, page_size=1000, sort_by=field, sort_order_=order, after=(whole[at][field], whole[at]["id"])).collect()
                assert [r["id"] for r in rest] == [r["id"] for r in whole[at + 1:]]
    with pytest.raises(ValueError):
        S.search(corpus, "timeout", after=(None, 1))
    with pytest.raises(ValueError):
        S.search(corpus, page_size=0)


def test_exports_are_whole_by_default(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("id", "timestamp'2024-01-01' AS timestamp", "'INFO' AS level", "'s' AS service_name", "repeat('x', 1500) AS message",
                                          "'t' AS trace_id", "CAST(null AS string) AS environment", "CAST(null AS string) AS host", "'{}' AS metadata")
    S.export_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.count() == 12_000 and back.where("length(message) = 1500").count() == 12_000
    S.export_json(rows, str(tmp_path / "j"), 11_000)
    assert spark.read.json(str(tmp_path / "j" / "logs")).count() == 11_000


def test_index_scan_gets_the_words_as_literals(corpus, tmp_path):
    index = S.build_search_index(corpus, str(tmp_path / "i"))
    plan = S.matching(corpus, "timeout", index)._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    many = " ".join(f"word{i}" for i in range(80))
    assert S.matching(corpus, many, index).count() == 0


def test_index_is_sorted_by_tasks_of_bounded_text(corpus, tmp_path, monkeypatch):
    text = corpus.selectExpr("sum(octet_length(message))").first()[0]
    monkeypatch.setattr(S, "_TASK_BYTES", max(text // 40, 1), raising=False)
    S.build_search_index(corpus, str(tmp_path / "i"))
    assert len(list((tmp_path / "i" / "postings").glob("part-*.parquet"))) > 20


def test_index_query_keeps_a_common_word_out_of_one_task(spark, sf):
    from logweave.plans.search_queries import build_search_index
    plan = build_search_index(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0]  # postings are no broadcast, and nothing is grouped behind the join
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Aggregate" not in above
