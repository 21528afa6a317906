from datetime import UTC, datetime

import pytest
from quillgrid.operators import chat
from quillgrid.plans import benchmark
from quillgrid.plans.service import SearchService

NOW = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "chunk_id string, document_id string, source_id string, filename string, media_type string, position int, text string, metadata string, embedding array<double>, char_start int, char_end int"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("a", "d1", "d1", "one.txt", "text/plain", 0, "apple pie and more", '{"page":1}', [1.0, 0.0], 0, 18), ("b", "d2", "d2", "two.txt", "text/plain", 0, "Apple  PIE and more", '{"page":2}', [0.9, 0.1], 0, 19), ("c", "d3", "d3", "three.md", "text/markdown", 0, "pears", "{}", [0.0, 1.0], 0, 5)], SCHEMA).cache()


def service(chunks, embed=lambda q: [1.0, 0.0]):
    return SearchService(chunks, embed, "m", 2)


def test_cache_statuses(chunks):
    s = service(chunks)
    first, again = s.search("  apple   pie ", now=NOW), s.search("apple pie", now=NOW)
    assert (first["embedding_cache"], first["retrieval_cache"]) == ("miss", "miss")
    assert (again["embedding_cache"], again["retrieval_cache"]) == ("skipped", "hit") and s.provider_calls == 1
    assert [h["chunk_id"] for h in again["hits"]] == ["a", "b", "c"]
    other = s.search("apple pie", filenames=["two.txt"], metadata={"page": 2}, now=NOW)
    assert (other["embedding_cache"], other["retrieval_cache"]) == ("hit", "miss") and [h["chunk_id"] for h in other["hits"]] == ["b"]
    s.cache.invalidate("delete")
    assert s.search("apple pie", now=NOW)["retrieval_cache"] == "miss" and s.provider_calls == 1


def test_keyword_needs_no_vector_and_bad_vectors_fail(chunks):
    def broken(query):
        raise RuntimeError("down")

    s = service(chunks, broken)
    assert s.search("pears", mode="keyword", now=NOW)["embedding_cache"] == "not_used"
    with pytest.raises(RuntimeError):
        s.search("pears", now=NOW)
    with pytest.raises(ValueError):
        service(chunks, lambda q: [1.0]).search("pears", now=NOW)
    with pytest.raises(ValueError):
        s.search("  ")


def test_context_and_chat(chunks):
    s, said = service(chunks), []
    package = s.build_context("apple pie")
    assert package["duplicates_removed"] == 1 and [c["citation_id"] for c in package["chunks"]] == [1, 2]
    assert package["context"].startswith('[1] Source: one.txt; media_type=text/plain; position=0; metadata={"page":1}\napple pie')
    made = s.ask("apple pie", [{"role": "user", "content": "before"}], lambda turns: f"{len(turns)} [1]", lambda *x: said.append(x))
    assert made == {"answer": "2 [1]", "citations": ["a"]} and [x[0] for x in said] == ["user", "assistant"]
    assert chat.build_turns("q", "", [])[0]["content"].startswith("Use the following")


def test_workload(chunks):
    rows = service(chunks).run_workload(["apple", "apple", "pears"], mode="keyword").orderBy("request_index").collect()
    assert [r.retrieval_cache for r in rows] == ["miss", "hit", "miss"]


def test_systems(spark, chunks):
    queries = spark.createDataFrame([(1, "pears", [0.0, 1.0])], "qid int, query string, vector array<double>")
    gold = spark.createDataFrame([(1, [("d3", 0, 5)])], "id int, relevant_passages array<struct<source_id:string,char_start:int,char_end:int>>")
    passages = benchmark.gold_passages(gold)
    systems = benchmark.run_systems(chunks, queries)
    found = {r.system: r for r in benchmark.evaluate_systems(systems, passages).collect()}
    assert set(found) == {"vector", "keyword", "hybrid", "bm25", "bm25_dense"} and all(r.mrr == 1 and r.recall_at_5 == 1 for r in found.values())
    hits = {r.chunk_id: r.relevant for r in benchmark.enrich_hits(systems["vector"], passages).collect()}
    assert hits == {"a": False, "b": False, "c": True}
    assert benchmark.run_systems(chunks, queries, rerank=True)["hybrid"].where("rank = 1").first().chunk_id == "c"


def test_hits_are_read_once_and_keep_the_best_share(spark, tmp_path):
    """Hits that were joined with their own coverage were found twice: the search, not the join, is the work."""
    rows = [(1, 1, "d1", 0, 10), (1, 2, "d1", 20, 30), (1, 3, "d2", 0, 10), (2, 1, "d1", 0, 10)]
    spark.createDataFrame(rows, "qid int, rank int, source_id string, char_start int, char_end int").write.parquet(str(tmp_path / "hits"))
    spans = [(1, 0, "d1", 5, 15), (1, 1, "d1", 0, 8), (1, 2, "d1", 29, 33), (2, 0, "d3", 0, 5)]
    passages = spark.createDataFrame(spans, "qid int, passage_id int, source_id string, char_start int, char_end int")
    met = benchmark.enrich_hits(spark.read.parquet(str(tmp_path / "hits")), passages)
    assert {(r.qid, r.rank): (r.coverage, r.relevant) for r in met.collect()} == {(1, 1): (1.0, True), (1, 2): (0.25, False), (1, 3): (0.0, False), (2, 1): (0.0, False)}
    assert met._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_corpus_check(spark):
    documents = spark.createDataFrame([("a", "ready", "indexed"), ("b", "ready", "failed")], "filename string, status string, indexing_status string")
    with pytest.raises(ValueError, match="b"):
        benchmark.verify_corpus(documents, documents.select("filename"))
    assert benchmark.duplicates(documents, "status").count() == 1
