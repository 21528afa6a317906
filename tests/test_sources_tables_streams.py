from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillgrid.operators import chat, tables
from quillgrid.sources import files
from quillgrid.streaming import ingest

NOW = datetime(2026, 1, 1, 12)


def test_text_sources(spark):
    rows = [("/x/a.txt", b"\xef\xbb\xbfalpha\r\nbeta\rgamma"), ("/x/b.MD", b"# h"), ("/x/c.txt", b"\xff\xfe\xfa"), ("/x/d.txt", b" \n"), ("/x/e.doc", b"x")]
    found = {r.path: r for r in files.parse_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["/x/a.txt"].text == "alpha\nbeta\ngamma" and found["/x/b.MD"].format == "markdown"
    assert [found[p].error is None for p, _ in rows] == [True, True, False, False, False]


def test_pdf_pages(spark):
    def pages(content):  # in place of a PDF library, which the box lacks
        if content == b"bad":
            raise ValueError("encrypted PDF")
        return ["First page", " ", "Second one"]

    rows = spark.createDataFrame([("/x/a.pdf", b"ok"), ("/x/b.pdf", b"bad")], "path string, content binary")
    found = {r.path: r for r in files.parse_pdfs(rows, pages).collect()}
    a = found["/x/a.pdf"]
    assert a.text == "First page\n\nSecond one" and a.page_count == 3 and "encrypted" in found["/x/b.pdf"].error
    spans = files.parse_pdfs(rows, pages).where("path = '/x/a.pdf'").select(files.pages_of_range(F.col("spans"), F.lit(0), F.lit(10)).alias("one"), files.pages_of_range(F.col("spans"), F.lit(8), F.lit(20)).alias("two")).first()
    assert spans.one == [1] and spans.two == [1, 3]


def test_store_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("/x/a.txt", b"same"), ("/x/b.txt", b"same"), ("/x/c.txt", b"other")], "path string, content binary")
    root = f"{tmp_path}/store"
    files.store(rows, root)
    files.store(rows, root)
    assert files.read_stored(spark, root).count() == 2
    other = files.read_stored(spark, root).where("path = '/x/c.txt'").select("content_hash")
    files.delete_stored(other, root)
    assert [bytes(r.content) for r in files.read_stored(spark, root).collect()] == [b"same"]
    files.store(rows, root)
    assert files.read_stored(spark, root).count() == 2
    (tmp_path / "q.txt").write_text("# no\nwhat is  it\n\nwhere\n")
    assert files.read_queries(spark, f"{tmp_path}/q.txt").count() == 2
    (tmp_path / "q.txt").write_text("what is  it\nwhat is it\n")
    with pytest.raises(ValueError):
        files.read_queries(spark, f"{tmp_path}/q.txt")
    (tmp_path / "g.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/g.jsonl", "id int").count() == 2
    inside = spark.createDataFrame([("file:/r/ab/x",), ("file:/r/../x",), ("http://r/x",)], "u string").select(files.inside_root(F.col("u"), "/r").alias("i"))
    assert [r.i for r in inside.collect()] == [True, False, False]


def test_gold(spark):
    text = "Some words before. The passage that matters has quite a few words in it. After."
    page = spark.createDataFrame([("s", 1, 0, text)], "source_path string, page_number int, page_start int, page_text string")
    notes = spark.createDataFrame([(1, "s", 1, "The passage", "in it.")], "id int, source_path string, page_number int, start_marker string, end_marker string")
    gold = files.locate_passages(notes, page)
    r = gold.first()
    assert text[r.char_start : r.char_end] == r.reference_text == "The passage that matters has quite a few words in it."
    documents = page.select("source_path", F.col("page_text").alias("text"))
    assert files.gold_violations(gold, documents).count() == 0
    assert {v.problem for v in files.gold_violations(gold.withColumn("reference_text", F.lit("x")), documents).collect()} == {"hash", "text", "too short"}


def test_jobs(spark):
    schema = "id string, status string, progress int, attempts int, worker_id string, error_message string, created_at timestamp, started_at timestamp, locked_at timestamp, next_attempt_at timestamp"
    jobs = spark.createDataFrame([("b", "queued", 0, 0, None, None, NOW, None, None, None), ("a", "queued", 0, 0, None, None, NOW, None, None, NOW + timedelta(hours=1)), ("c", "parsing", 10, 1, "w", None, NOW, NOW, NOW - timedelta(minutes=5), None)], schema)
    taken = tables.claim(jobs, "w1", NOW).collect()
    assert [(r.id, r.status, r.attempts, r.progress) for r in taken] == [("b", "parsing", 1, 10)]
    back = {r.id: r for r in tables.recover_stale(jobs, NOW - timedelta(seconds=1)).collect()}
    assert back["c"].status == "queued" and back["c"].attempts == 1 and back["c"].locked_at is None
    failed = tables.after_failure(jobs.where("id = 'c'"), "no", NOW).first()
    assert failed.status == "queued" and failed.next_attempt_at == NOW + timedelta(seconds=2)
    assert tables.after_failure(jobs.where("id = 'c'"), "no", NOW, max_attempts=1).first().status == "failed"


def test_claim_of_a_given_job(spark):
    schema = "id string, status string, progress int, attempts int, worker_id string, error_message string, created_at timestamp, started_at timestamp, locked_at timestamp, next_attempt_at timestamp"
    jobs = spark.createDataFrame([(i, s, 0, 0, None, None, NOW + timedelta(seconds=n), None, None, None) for n, (i, s) in enumerate([("a", "queued"), ("b", "queued"), ("c", "parsing")])], schema)
    assert [(r.id, r.worker_id) for r in tables.claim(jobs, "w", NOW, "b").collect()] == [("b", "w")]
    assert tables.claim(jobs, "w", NOW, "c").count() == 0


def test_latest_and_tombstones(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "c", True)], "k int, seq int, v string, gone boolean")
    assert [(r.k, r.v) for r in tables.latest(log, ["k"], "seq", "gone").collect()] == [(1, "b")]
    assert tables.without_deleted(log, log.where("k = 1"), "k").select("k").distinct().count() == 1


def test_caches(spark):
    cache = tables.QueryCache()
    key = lambda q, f: cache.retrieval_key(q, "hybrid", 10, 0.7, f, "m", 4, 60, cache.corpus_version())
    assert key(" apple  pie ", {"a": [2, 1]}) == key("apple pie", {"a": [1, 2]}) != key("apple pie", {"a": [1]})
    k = key("q", {})
    assert cache.get("retrieval", k, NOW)[0] == "miss"
    cache.put("retrieval", k, "r", NOW)
    assert cache.get("retrieval", k, NOW) == ("hit", "r") and cache.get("retrieval", k, NOW + timedelta(hours=2))[0] == "expired"
    e = cache.embedding_key("m", 8, "q")
    cache.put("embedding", e, [1.0], NOW)
    cache.invalidate("upload")
    assert cache.get("retrieval", key("q", {}), NOW)[0] == "miss" and cache.get("embedding", e, NOW)[0] == "hit"
    assert tables.QueryCache(results=False).get("retrieval", k, NOW)[0] == "disabled"
    lines = tables.exposition(cache.metrics(spark), "cache_total", ["cache", "status"]).collect()
    assert 'cache_total{cache="embedding",status="hit"} 1' in {r.value for r in lines}
    trace = tables.build_trace([str(i) for i in range(10)], 10, 0.8, 1)
    assert len(trace) == 10 and len(set(trace)) <= 2


def test_chat():
    said = []
    store = lambda role, text, cites: said.append((role, cites))
    made = chat.ask("what?", "ctx", {1: "c1"}, [], lambda turns: "it is [1] and [99]", store)
    assert made["citations"] == ["c1"] and said == [("user", []), ("assistant", ["c1"])]
    assert [e for e, _ in chat.stream("q", "", {}, [], lambda turns: iter(["a", "b"]), store)] == ["metadata", "delta", "delta", "done"]
    assert [e for e, _ in chat.stream("q", "", {}, [], lambda turns: iter([]), store)] == ["metadata", "error"]
    with pytest.raises(RuntimeError):
        chat.ask("q", "", {}, [], lambda turns: " ", store)


def test_ingestion_resumes_and_skips_duplicates(spark, tmp_path):
    inbox, root = tmp_path / "in", f"{tmp_path}/store"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one two three four five")
    (inbox / "b.txt").write_text("one two three four five")
    (inbox / "c.txt").write_bytes(b"\xff\xfe")
    ingest.ingest_stream(spark, str(inbox), root, 4, 1).awaitTermination(120)
    (inbox / "d.md").write_text("another text")
    (inbox / "e.md").write_text("one two three four five")
    ingest.ingest_stream(spark, str(inbox), root, 4, 1).awaitTermination(120)
    documents = spark.read.parquet(f"{root}/documents")
    assert {(r.filename, r.status) for r in documents.collect()} == {("a.txt", "ready"), ("c.txt", "failed"), ("d.md", "ready")}
    assert spark.read.parquet(f"{root}/chunks").count() == 3


def test_ingestion_takes_pdfs_and_indexes(spark, tmp_path):
    def pages(content):
        if content != b"ok":
            raise ValueError("encrypted PDF")
        return ["First page", "Second one"]

    def broken(texts):
        return [[1.0] for _ in texts] if "plain" in texts[0] else [[0.5] * 4 for _ in texts]

    inbox, root = tmp_path / "in", f"{tmp_path}/store"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"ok")
    (inbox / "b.pdf").write_bytes(b"bad")
    (inbox / "c.txt").write_text("plain text")
    ingest.ingest_stream(spark, str(inbox), root, 4, 1, pages, broken, "m", 4).awaitTermination(120)
    found = {r.filename: r for r in spark.read.parquet(f"{root}/documents").collect()}
    assert {n: r.status for n, r in found.items()} == {"a.pdf": "ready", "b.pdf": "failed", "c.txt": "ready"}
    assert "encrypted" in found["b.pdf"].error_message and found["a.pdf"].page_count == 2 and found["a.pdf"].text == "First page\n\nSecond one"
    indexed = lambda: {r.document_id: (r.embedding, r.embedding_model) for r in ingest.read_embeddings(spark, root).collect()}
    assert indexed() == {found["a.pdf"].document_id: ([0.5] * 4, "m")}
    assert [r.error for r in spark.read.parquet(f"{root}/embeddings").where("error is not null").collect()] == ["the embedding provider returned an invalid vector"]
    ingest.index_again(spark, root, lambda texts: [[0.25] * 4 for _ in texts], "n", 4)  # what is indexed is skipped
    assert indexed() == {found["a.pdf"].document_id: ([0.5] * 4, "m"), found["c.txt"].document_id: ([0.25] * 4, "n")}
    ingest.index_again(spark, root, lambda texts: [[0.75] * 4 for _ in texts], "o", 4, force=True)
    assert {v for _, v in indexed().values()} == {"o"} and len(indexed()) == 2


def test_rate_limits(spark, tmp_path):
    times = [0, 10, 20, 61, 62, 75]
    wanted = [True, True, False, True, False, True]
    assert ingest.admit([float(t) for t in times], 2, 60) == wanted
    rows = spark.createDataFrame([(7, NOW + timedelta(seconds=t), i) for i, t in enumerate(times)], "client long, ts timestamp, request_id long")
    assert [r.allowed for r in ingest.rate_limit_batch(rows, 2, 60).orderBy("request_id").collect()] == wanted
    rows.coalesce(1).write.parquet(f"{tmp_path}/requests")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/requests")
    query = ingest.rate_limit(stream, 2, 60).writeStream.format("memory").queryName("allowed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.allowed for r in spark.table("allowed").orderBy("request_id").collect()] == wanted


def test_versions_over_stretches(spark):
    rows = [(i, i % 7 == 3 if i % 5 else None) for i in [*range(0, 60), 59, 200, 201, 31]]
    found = tables.versions_at(spark.createDataFrame(rows, "n long, bad boolean"), "n", F.col("bad"), span=8).collect()
    assert sorted((r.n, r.corpus_version) for r in found) == sorted((n, 1 + sum(1 for m, bad in rows if bad and m < n)) for n, _ in rows)
    assert tables.versions_at(spark.createDataFrame([], "n long, bad boolean"), "n", F.col("bad")).count() == 0
