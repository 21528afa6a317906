import pytest
from quillgrid.operators import evaluation as E

CHUNKS = "qid int, rank int, source_id string, char_start int, char_end int"
PASSAGES = "qid int, passage_id int, source_id string, char_start int, char_end int"


def test_coverage(spark):
    passages = spark.createDataFrame([(1, 1, "a", 100, 200)], PASSAGES)
    chunks = spark.createDataFrame([(1, 1, "a", 50, 150), (1, 2, "a", 100, 200), (1, 3, "b", 100, 200)], CHUNKS)
    assert {r["rank"]: r.coverage for r in E.coverage(chunks, passages).collect()} == {1: 0.5, 2: 1.0}


def test_query_metrics(spark):
    passages = spark.createDataFrame([(1, 1, "a", 100, 200)], PASSAGES)
    chunks = spark.createDataFrame([(1, 1, "b", 100, 200), (1, 2, "a", 100, 140), (1, 3, "a", 140, 200)], CHUNKS)
    m = E.query_metrics(chunks, passages).first()
    assert m.mrr == pytest.approx(1 / 3) and m.precision_at_5 == pytest.approx(0.2) and m.irrelevant_at_5 == 4
    assert m.recall_at_5 == 1 and m.passage_coverage_at_5 == pytest.approx(1) and m.boundary_completeness_at_5 == 0
    whole = spark.createDataFrame([(1, 1, "a", 50, 250)], CHUNKS)
    best = E.query_metrics(whole, passages).first()
    assert best.boundary_completeness_at_5 == 1 and best.ndcg_at_10 == 1
    nothing = E.query_metrics(whole.where("false"), passages).first()
    assert nothing.mrr == 0 and nothing.ndcg_at_10 == 0 and nothing.irrelevant_at_5 == 5
    with pytest.raises(ValueError):
        E.query_metrics(whole, passages, threshold=0)


def test_span_guard(spark):
    with pytest.raises(Exception, match="invalid character range"):
        E.check_spans(spark.createDataFrame([(5, 5)], "char_start int, char_end int")).collect()


def test_latency_and_throughput(spark):
    ms = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0)], "k string, ms double")
    r = E.latency(ms, "ms", ["k"]).first()
    assert (r.n, r.mean, r.p50, r.p95) == (3, 20, 20, 29)
    assert E.throughput(ms, "ms").first()[0] == pytest.approx(50) and E.throughput(ms.limit(0), "ms").first()[0] == 0


def test_compare_and_control(spark):
    a = spark.createDataFrame([("recall", 0.5), ("ndcg", 0.5), ("irrelevant_at_5", 2.0), ("zero", 0.0)], "metric string, value double")
    b = spark.createDataFrame([("recall", 0.75), ("ndcg", 0.6), ("irrelevant_at_5", 1.5), ("zero", 1.0)], "metric string, value double")
    found = {r.metric: r for r in E.compare_runs(a, b).collect()}
    assert found["recall"].relative_percent == pytest.approx(50) and found["ndcg"].relative_percent == pytest.approx(20)
    assert found["irrelevant_at_5"].relative_percent == pytest.approx(-25) and all(r.improved for r in found.values()) and found["zero"].relative_percent is None
    runs = spark.createDataFrame([("h", 10), ("g", 10)], "dataset_sha256 string, top_k int")
    with pytest.raises(ValueError, match="dataset_sha256"):
        E.check_control(runs.where("dataset_sha256 = 'h'"), runs.where("dataset_sha256 = 'g'"), ["dataset_sha256", "top_k"])


def test_bootstrap(spark):
    a = spark.createDataFrame([(1, 0.4), (2, 0.5)], "qid int, v double")
    b = spark.createDataFrame([(1, 0.6), (2, 0.6)], "qid int, v double")
    r = E.paired_bootstrap(a, b, "v", 100, 7).first()
    assert 0 < r.lower <= r.upper
    assert E.paired_bootstrap(b, a, "v", 100, 7, reduction=True).first().lower > 0
    with pytest.raises(ValueError):
        E.paired_bootstrap(a, b.limit(1), "v", 10)


def test_stability_and_mismatches(spark):
    runs = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "a"), (1, 2, 2, "b"), (2, 1, 1, "a"), (2, 2, 1, "b")], "qid int, repetition int, rank int, chunk_id string")
    assert {r.qid: r.stable for r in E.stability(runs).collect()} == {1: True, 2: False}
    got = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, v string")
    true = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "i int, v string")
    assert tuple(E.mismatches(got, true, "i", "v").first()) == (1, 3)


def test_medians_of_profiles(spark):
    runs = spark.createDataFrame([("full", 0.8, 100, 1, 5.0), ("full", 0.8, 100, 0, 8.0), ("full", 0.8, 90, 0, None), ("full", 0.4, 10, 0, 3.0)], "mode string, repeat_rate double, requests int, errors int, p95_ms double")
    found = {r.repeat_rate: (r.runs, r.requests, r.errors, r.p95_ms) for r in E.profile_medians(runs, ["p95_ms"]).collect()}
    assert found == {0.8: (3, 290, 1, 6.5), 0.4: (1, 10, 0, 3.0)}
