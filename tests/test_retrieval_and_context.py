import pytest
from pyspark.sql import functions as F
from quillgrid.operators import context, filters, retrieval
from quillgrid.plans import catalog


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("v", "orange fruit", [1.0, 0.0], "vectors.txt", "text/plain", '{"page":1}'), ("w", "apple pie apple", [0.0, 1.0], "words.md", "text/markdown", '{"page":2,"tags":["a","b"],"in":{"k":"x"}}'), ("n", "", None, "none.txt", "text/plain", "{}")], "chunk_id string, text string, embedding array<double>, filename string, media_type string, meta string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "Apple!", [1.0, 0.0])], "qid int, query string, vector array<double>")


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_modes(corpus, asked):
    by_vector = retrieval.search(corpus, asked, mode="vector").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in by_vector] == [("v", 1.0), ("w", 0.0)]
    by_word = retrieval.search(corpus, asked, mode="keyword").collect()
    assert [(r.chunk_id, r.keyword_score) for r in by_word] == [("w", 2 / 3)]
    both = retrieval.search(corpus, asked, vector_weight=0.5).collect()
    assert {r.chunk_id for r in both} == {"v", "w"} and all(0 <= r.score <= 1 for r in both)
    assert ids(retrieval.search(corpus, asked, vector_weight=0.0)) == ["w"]
    assert ids(retrieval.search(corpus, asked, vector_weight=1.0)) == ["v", "w"]


@pytest.mark.parametrize("wrong", [{"mode": "x"}, {"top": 0}, {"vector_weight": 1.5}])
def test_invalid_searches(corpus, asked, wrong):
    with pytest.raises(ValueError):
        retrieval.search(corpus, asked, **wrong)


def test_filters(corpus):
    kept = lambda c: {r.chunk_id for r in corpus.where(c).collect()}
    assert kept(filters.search_filters(filenames=["words.md", "none.txt"], media_types=["text/markdown"])) == {"w"}
    assert len(kept(filters.search_filters(filenames=[]))) == 3
    meta = F.col("meta")
    assert kept(filters.metadata_equals(meta, {"page": 2})) == {"w"} and kept(filters.metadata_equals(meta, {"page": None})) == {"n"}
    assert kept(filters.metadata_contains(meta, {"tags": ["b"], "in": {"k": "x"}})) == {"w"}
    assert kept(filters.filename_contains(F.col("filename"), "WORD")) == {"w"}


def test_bm25_order_and_fusion(spark):
    docs = spark.createDataFrame([("a", "process scheduler process scheduler"), ("b", "memory pages"), ("c", "scheduler notes and other words")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "scheduler process")], "qid int, query string")
    assert ids(retrieval.top_k(retrieval.bm25_scores(docs, asked, "chunk_id", "text"), 5, "chunk_id")) == ["a", "c"]
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, chunk_id string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, chunk_id string, rank int")
    fused = retrieval.weighted_rrf([(dense, 0.5), (sparse, 0.5)], "chunk_id").orderBy(F.desc("score")).collect()
    assert fused[0].chunk_id == "b" and fused[0].score == pytest.approx(0.5 * (61 / 62 + 1))
    assert {r.score for r in retrieval.weighted_rrf([(dense, 0.0)], "chunk_id").collect()} == {0.0}
    with pytest.raises(ValueError):
        retrieval.weighted_rrf([(dense, -1)], "chunk_id")


def test_ties_go_by_id(spark):
    scored = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "qid int, chunk_id string, score double")
    assert ids(retrieval.top_k(scored, 2, "chunk_id")) == ["c", "a"]


HITS = "qid int, chunk_id string, query string, text string, score double, rank int"


def test_rerank_dedup_and_budget(spark):
    hits = spark.createDataFrame([(1, "a", "alpha beta", "gamma delta", 0.9, 1), (1, "b", "alpha beta", "alpha  BETA", 0.5, 2), (1, "c", "alpha beta", "Alpha beta", 0.1, 3)], HITS)
    placed = context.rerank(hits, "chunk_id")
    assert [r.chunk_id for r in placed.orderBy("place").collect()] == ["b", "c", "a"]
    unique = context.deduplicate(placed)
    assert [(r.chunk_id, r.unique_place) for r in unique.orderBy("place").collect()] == [("b", 1), ("a", 2)]
    off = context.rerank(hits, "chunk_id", enabled=False)
    assert [(r.place, r.rerank_score) for r in off.orderBy("place").collect()] == [(1, None), (2, None), (3, None)]
    long = spark.createDataFrame([(1, "a", "q", "one two three four five six", 1.0, 1), (1, "b", "q", "seven", 0.5, 2)], HITS).withColumn("unique_place", F.col("rank"))
    fitted = context.fit_budget(long, F.lit("[1] head"), max_tokens=8).collect()
    assert [(r.context_text, r.context_tokens, r.truncated) for r in fitted] == [("one two three four", 4, True)]
    with pytest.raises(ValueError):
        context.fit_budget(long, F.lit(""), max_chunks=0)


def test_outside_rerankers_are_checked(spark):
    hits = spark.createDataFrame([(1, "a", "q", "x", 0.9, 1), (1, "b", "q", "y", 0.5, 2)], HITS)
    good = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0)], "qid int, chunk_id string, rerank_score double")
    assert [r.chunk_id for r in context.rerank_external(hits, good, "chunk_id").orderBy("place").collect()] == ["b", "a"]
    for bad in (good.limit(0), good.withColumn("rerank_score", F.lit(1.1))):
        with pytest.raises(Exception, match="reranker scores"):
            context.rerank_external(hits, bad, "chunk_id").collect()


def test_history_citations_and_conversations(spark):
    said = spark.createDataFrame([(1, p, n) for p, n in enumerate([5, 50, 10, 10])], "conv int, position int, n int")
    assert sorted(r.position for r in context.history_window(said, "conv", "position", F.col("n"), 20, 30).collect()) == [2, 3]
    assert sorted(r.position for r in context.history_window(said, "conv", "position", F.col("n"), 1, 30).collect()) == [3]
    answers = spark.createDataFrame([(1, "so [1], [99] and [1]")], "m int, answer string")
    available = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2")], "m int, citation_id int, chunk string")
    assert [r.chunk for r in context.cited(answers, available, "m", "answer").collect()] == ["c1"]
    heads = spark.createDataFrame([(1,), (2,)], "conv int")
    assert {(r.conv, r.messages, r.next_position) for r in context.conversations(heads, said, "conv").collect()} == {(1, 4, 4), (2, 0, 0)}


def test_of_texts_only_those_found_are_shuffled(spark, tmp_path):
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.createDataFrame([(1, 7, 1), (1, 9, 2), (2, 7, 1), (2, 999, 2)], "qid long, doc_id long, rank int").write.parquet(str(tmp_path / "f"))
    found = spark.read.parquet(str(tmp_path / "f"))
    got = retrieval.texts_of(found, texts, "doc_id")
    assert sorted((r.qid, r.doc_id, r.text) for r in got.collect()) == [(1, 7, "text 7"), (1, 9, "text 9"), (2, 7, "text 7")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, retrieval.texts_of(found, texts, "doc_id", most=1).collect())) == sorted(map(tuple, got.collect()))  # too many ids: by shuffle


@pytest.mark.parametrize("name", ["rerank_lexical", "context_budget"])
def test_hits_fetch_their_own_texts_only(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
