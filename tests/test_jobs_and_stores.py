"""Jobs, conversations and stored caches over their logs."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillgrid.operators import context, filters, jobs, tables
from quillgrid.operators.conversations import Conversations
from quillgrid.plans.service import SearchService

NOW = datetime(2026, 1, 1, tzinfo=UTC)


def test_two_workers_never_hold_one_job(spark, tmp_path):
    queue, other = (jobs.JobQueue(spark, str(tmp_path)) for _ in range(2))
    first, second = queue.enqueue(["a", "b", "a"], NOW)
    assert queue.enqueue(["a"], NOW) == []  # it has a job that isn't over
    seen = queue.current()
    assert seen.count() == 2
    one, two = queue.claim("w1", NOW), other.claim("w2", NOW)
    assert {one["id"], two["id"]} == {first, second} and queue.claim("w3", NOW) is None
    assert (one["status"], one["progress"], one["attempts"], one["worker_id"]) == ("parsing", 10, 1, "w1")
    assert not queue._create(f"{one['id']}-0", NOW)  # the claim itself can be made once only
    assert other.claim("w2", NOW, one["id"]) is None


def test_states_retries_and_stale_leases(spark, tmp_path):
    queue = jobs.JobQueue(spark, str(tmp_path), max_attempts=2, backoff_s=2.0, lease_s=60)
    (key,) = queue.enqueue(["doc"], NOW)
    queue.claim("w", NOW)
    assert queue.set_status(key, "chunking", 40)["progress"] == 40
    with pytest.raises(ValueError, match="progress"):
        queue.set_status(key, "chunking", 101)
    again = queue.failed(key, "no luck", NOW)
    assert (again["status"], again["error_message"], again["next_attempt_at"].replace(tzinfo=UTC)) == ("queued", "no luck", NOW + timedelta(seconds=2))
    assert queue.claim("w", NOW + timedelta(seconds=1)) is None
    assert queue.claim("w", NOW + timedelta(seconds=3))["attempts"] == 2
    assert queue.recover_stale(NOW + timedelta(seconds=50)) == 0 and queue.recover_stale(NOW + timedelta(seconds=70)) == 1
    late = NOW + timedelta(seconds=71)
    job = queue.claim("v", late)
    assert job["attempts"] == 3 and queue.failed(key, "again", late)["status"] == "failed"
    assert [r.status for r in queue.of_document("doc").collect()] == ["failed"]


def test_a_worker_survives_what_goes_wrong(spark, tmp_path):
    queue, done = jobs.JobQueue(spark, str(tmp_path), max_attempts=1), []

    def process(document):
        if document == "bad":
            raise RuntimeError("cannot be read")
        done.append(document)

    queue.enqueue(["good", "bad", "fine"], NOW)
    assert jobs.run_available(queue, "w", process, lambda d: None, lambda: NOW) == 3 and sorted(done) == ["fine", "good"]
    assert {(r.document_id, r.status, r.progress, r.error_message) for r in queue.current().collect()} == {("good", "completed", 100, None), ("fine", "completed", 100, None), ("bad", "failed", 10, "cannot be read")}


def test_conversations_are_kept_in_order(spark, tmp_path):
    kept = Conversations(spark, str(tmp_path))
    chunks = spark.createDataFrame([("c1", "d", "f.txt", "text/plain", 0, "alpha beta gamma", "{}", [1.0, 0.0])], "chunk_id string, document_id string, filename string, media_type string, position int, text string, metadata string, embedding array<double>")
    service, turns = SearchService(chunks, lambda q: [1.0, 0.0], "m", 2), []

    def generate(given):
        turns.append([t["role"] for t in given])
        return "Found in [1]."

    first = service.converse("what is  alpha?", kept, generate, now=NOW)
    service.converse("and beta?", kept, generate, first["conversation_id"], now=NOW + timedelta(seconds=1))
    other = service.converse("gamma?", kept, generate, now=NOW + timedelta(seconds=2))
    assert turns == [["user"], ["user", "assistant", "user"], ["user"]] and first["citations"] == ["c1"]
    assert [(r.position, r.role) for r in kept.messages(first["conversation_id"]).collect()] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    assert [(r.id, r.title, r.messages) for r in kept.page().collect()] == [(other["conversation_id"], "gamma?", 2), (first["conversation_id"], "what is alpha?", 4)]
    with pytest.raises(RuntimeError):
        service.converse("empty?", kept, lambda t: " ", other["conversation_id"], now=NOW)
    assert kept.messages(other["conversation_id"]).count() == 3  # the question stays
    kept.delete(other["conversation_id"])
    assert kept.page().count() == 1 and kept.messages(other["conversation_id"]).count() == 0
    with pytest.raises(LookupError):
        service.converse("more", kept, generate, other["conversation_id"])


def test_stored_cache_outlives_its_service(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d", "f.txt", "text/plain", 0, "alpha beta", "{}", [1.0, 0.0])], "chunk_id string, document_id string, filename string, media_type string, position int, text string, metadata string, embedding array<double>")
    service = lambda: SearchService(chunks, lambda q: [1.0, 0.0], "m", 2, tables.StoredCache(spark, str(tmp_path)))
    a, b = service(), service()
    one, two = a.search("alpha", now=NOW), b.search("alpha", now=NOW)
    assert (one["retrieval_cache"], two["retrieval_cache"], two["hits"]) == ("miss", "hit", one["hits"]) and b.provider_calls == 0
    assert a.cache.invalidate("document_indexed") == 2 and b.search("alpha", now=NOW)["retrieval_cache"] == "miss" and b.provider_calls == 0
    key = b.cache.embedding_key("m", 2, "alpha")
    b.cache.put("embedding", key, [1.0], NOW)
    assert a.embed_query("alpha", NOW)[0] == "invalid" and a.embed_query("alpha", NOW)[0] == "hit"
    assert a.cache.get("embedding", key, NOW + timedelta(days=2))[0] == "expired"
    a.cache.clear()
    assert b.cache.get("embedding", key, NOW)[0] == "miss" and b.cache.corpus_version() == 2


def test_provider_calls_fall_with_repeats(spark):
    """Of 25 requests with 80 % repeats 5 are different: 80 % fewer calls; no result is of an older corpus version."""
    chunks = spark.createDataFrame([("c1", "d", "f.txt", "text/plain", 0, "alpha beta", "{}", [1.0, 0.0])], "chunk_id string, document_id string, filename string, media_type string, position int, text string, metadata string, embedding array<double>")
    service = SearchService(chunks, lambda q: [1.0, 0.0], "m", 2)
    trace = tables.build_trace([f"alpha {i}" for i in range(20)], 25, 0.8)
    rows = service.run_workload(trace, concurrency=1, mode="vector")
    assert service.provider_calls == len(set(trace)) == 5 and rows.where("corpus_version <> 1").count() == 0
    service.cache.invalidate("changed")
    again = service.run_workload(trace, concurrency=4, mode="vector")
    assert again.where("corpus_version <> 2").count() == 0 and service.provider_calls == 5


def test_metadata_is_compared_by_type(spark):
    rows = ['{"k":"2"}', '{"k":2}', '{"k":2.0}', '{"a\'b\\"":1}', '{"l":[{"b":1,"c":2}]}', "{}", "not json", None, '{"k":null}', '{"k":true}', '{"o":{"x":1,"y":[1,"2"]}}']
    df = spark.createDataFrame([(r,) for r in rows], "m string")
    found = lambda c: [rows.index(r.m) for r in df.where(c).collect()]
    same, holds = (lambda w: found(filters.metadata_equals(F.col("m"), w))), (lambda w: found(filters.metadata_contains(F.col("m"), w)))
    assert same({"k": 2}) == [1, 2] and same({"k": "2"}) == [0] and same({"a'b\"": 1}) == [3] and same({"k": True}) == [9]
    assert same({"k": None}) == [3, 4, 5, 6, 7, 8, 10] and same({"o": {"y": [1, "2"], "x": 1}}) == [10] and same({"o": {"x": 1}}) == []
    assert holds({"l": [{"b": 1}]}) == [4] and holds({"o": {"y": ["2"]}}) == [10] and holds({"o": {"y": [2]}}) == [] and holds({"k": 2}) == [1, 2]


def test_repeated_chunk_ids_are_dropped_too(spark):
    rows = [(1, "a", "one"), (2, "b", "ONE "), (3, "b", "three"), (4, "a", "four"), (5, "c", "four"), (6, "d", "three")]
    hits = spark.createDataFrame([(0, p, c, t) for p, c, t in rows], "qid int, place int, chunk_id string, text string")
    assert [r.place for r in context.deduplicate(hits, key="chunk_id").orderBy("place").collect()] == [1, 3, 5]
