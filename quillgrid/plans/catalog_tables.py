"""Further registered queries: jobs, stores, predicates, evaluation and report operators over whole test tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators import chunking, context, evaluation, filters, index, jobs, retrieval, tables
from quillgrid.plans import benchmark
from quillgrid.plans import catalog as C
from quillgrid.plans.catalog import documents, messages, r6, register, table, tokens_sql
from quillgrid.sources import files

NOW = datetime(2024, 1, 15)
_NOW = "TIMESTAMP '2024-01-15'"
# Every event as a job: its type is the state, its value decides attempts, pauses and locks.
_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'parsing' WHEN 'error' THEN 'embedding' WHEN 'signup' THEN 'failed' ELSE 'completed' END"
_JOBS = f"""jobs AS (SELECT event_id AS id, user_id AS document_id, ts AS created_at, {_STATE} AS status, (floor(value) % 3)::INT AS attempts, (floor(value) % 100)::INT AS progress,
CASE WHEN value > 50 THEN ts + INTERVAL 5 DAY END AS next_attempt_at, CASE WHEN value > 20 THEN ts END AS locked_at, CASE WHEN value > 20 THEN 'w' || user_id END AS worker_id, NULL::TIMESTAMP AS started_at, NULL::VARCHAR AS error_message FROM events)"""


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda least, column: F.when(F.col("value") > least, column)
    state = F.expr(_STATE)
    worker = F.concat(F.lit("w"), F.col("user_id").cast("string"))
    cut = lambda n: (F.floor("value") % n).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), state.alias("status"), cut(3).alias("attempts"), cut(100).alias("progress"), when(50, F.expr("ts + INTERVAL 5 DAYS")).alias("next_attempt_at"), when(20, F.col("ts")).alias("locked_at"), when(20, worker).alias("worker_id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("error_message"))


@register(f"WITH {_JOBS} SELECT id, created_at FROM jobs WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW})")
def eligible_jobs(spark, sf_dir):
    return job_rows(spark, sf_dir).where(filters.eligible_jobs(F.lit(NOW))).select("id", "created_at")


@register(f"WITH {_JOBS} SELECT id, status FROM jobs WHERE status IN ('parsing', 'chunking', 'embedding', 'indexing') AND (locked_at IS NULL OR locked_at < {_NOW})")
def stale_jobs(spark, sf_dir):
    return job_rows(spark, sf_dir).where(filters.stale_jobs(F.lit(NOW))).select("id", "status")


@register(f"WITH {_JOBS} SELECT id, 'parsing' AS status, 10 AS progress, attempts + 1 AS attempts, 'me' AS worker_id, {_NOW} AS locked_at, {_NOW} AS started_at FROM jobs WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) ORDER BY created_at, id LIMIT 1")
def job_claim(spark, sf_dir):
    return tables.claim(job_rows(spark, sf_dir), "me", NOW).select("id", "status", "progress", "attempts", "worker_id", "locked_at", "started_at")


@register(f"""WITH {_JOBS}, s AS (SELECT *, status IN ('parsing', 'chunking', 'embedding', 'indexing') AND (locked_at IS NULL OR locked_at < {_NOW}) stale FROM jobs)
SELECT id, attempts, progress, if(stale, 'queued', status) AS status, if(stale, NULL, worker_id) AS worker_id, if(stale, {_NOW}, next_attempt_at) AS next_attempt_at, if(stale, 'recovered stale worker lease', NULL) AS error_message FROM s""")
def job_recovery(spark, sf_dir):
    return tables.recover_stale(job_rows(spark, sf_dir), NOW, NOW).select("id", "attempts", "progress", "status", "worker_id", "next_attempt_at", "error_message")


@register(f"""WITH {_JOBS} SELECT id, if(attempts < 2, 'queued', 'failed') AS status, if(attempts < 2, 0, progress) AS progress, 'no luck' AS error_message,
CASE WHEN attempts < 2 THEN {_NOW} + to_microseconds((2000000 * pow(2, attempts - 1))::BIGINT) END AS next_attempt_at FROM jobs WHERE status NOT IN ('completed', 'failed')""")
def job_retry(spark, sf_dir):
    return tables.after_failure(job_rows(spark, sf_dir).where("status not in ('completed', 'failed')"), "no luck", NOW, 2, 2.0).select("id", "status", "progress", "error_message", "next_attempt_at")


_ORDER = "CASE status WHEN 'queued' THEN 0 WHEN 'parsing' THEN 10 WHEN 'embedding' THEN 60 WHEN 'completed' THEN 100 END"


@register(f"WITH {_JOBS} SELECT document_id, arg_max(status, id) AS status, arg_max(progress, id) AS progress, max(id) AS id, count(*) AS rows FROM jobs GROUP BY 1")
def job_transitions(spark, sf_dir):
    log = job_rows(spark, sf_dir)
    counts = log.groupBy("document_id").agg(F.count("*").alias("rows"))
    return tables.latest(log, ["document_id"], "id").select("document_id", "status", "progress", "id").join(counts, "document_id")


@register(f"WITH {_JOBS} SELECT id, created_at, status FROM jobs WHERE document_id = 7 ORDER BY created_at, id")
def jobs_of_document(spark, sf_dir):
    return filters.jobs_of_document(job_rows(spark, sf_dir), 7).select("id", "created_at", "status")


@register(C._CHUNKS + "SELECT doc_id AS document_id, count(*) chunks, count(*) FILTER (position % 5 <> 4) indexed, ceil(count(*) / 32)::BIGINT batches, if(count(*) = count(*) FILTER (position % 5 <> 4), 'indexed', 'pending') indexing_status FROM chunks GROUP BY 1")
def index_batches(spark, sf_dir):
    rows = C.chunks(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "position")
    held = rows.withColumn("embedding", F.when(F.col("position") % 5 != 4, F.array(F.lit(1.0))))
    return jobs.index_summary(rows, held)


@register("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return filters.point_lookup(documents(spark, sf_dir), "doc_id", 7).select("doc_id", "source", "n_chars")


@register(C._CHUNKS + "SELECT position, token_start, token_end FROM chunks WHERE doc_id = 8 ORDER BY position")
def chunks_of_document(spark, sf_dir):
    rows = C.chunks(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return filters.chunks_of_document(rows, 8).select("position", "token_start", "token_end")


@register(f"SELECT event_id, ts + INTERVAL 3600 SECOND <= {_NOW} AS expired FROM events")
def cache_expiry(spark, sf_dir):
    until = F.col("ts") + F.make_dt_interval(secs=F.lit(3600))
    return table(spark, sf_dir, "events").select("event_id", tables.expired(until, F.lit(NOW)).alias("expired"))


@register("SELECT doc_id, n_chars > 0 AND n_chars <= 1000 AS accepted FROM documents")
def upload_size(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", filters.upload_size(F.col("n_chars"), 1000).alias("accepted"))


@register("SELECT user_id, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 1")
def duplicate_counts(spark, sf_dir):
    return benchmark.duplicates(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id").select("user_id", "count")


# Two runs of each user's events: those of odd and those of even ids.
_RUNS = "runs AS (SELECT user_id qid, event_id % 2 repetition, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS rank, event_type chunk_id FROM events)"


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("qid", "repetition").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 2).alias("repetition"), "event_id", F.col("event_type").alias("chunk_id"))
    return rows.withColumn("rank", F.row_number().over(order))


@register(f"WITH {_RUNS}, l AS (SELECT qid, repetition, list(chunk_id ORDER BY rank) ids FROM runs GROUP BY ALL) SELECT qid, count(DISTINCT ids) = 1 AS stable FROM l GROUP BY 1")
def ranking_stability(spark, sf_dir):
    return evaluation.stability(run_rows(spark, sf_dir))


@register(C._CHUNKS + f", {_RUNS}, l AS (SELECT qid, repetition, list(chunk_id ORDER BY rank) ids FROM runs GROUP BY ALL), st AS (SELECT qid, count(DISTINCT ids) = 1 AS stable FROM l GROUP BY 1), " + """d AS (SELECT doc_id, count(c.doc_id) chunk_count, coalesce(max(token_end), 0) token_count FROM documents LEFT JOIN chunks c USING (doc_id) GROUP BY 1)
SELECT count(*) documents, sum(chunk_count)::BIGINT chunks, sum(token_count)::BIGINT tokens, (SELECT count(*) FROM st WHERE NOT stable) unstable_rankings FROM d""")
def corpus_totals(spark, sf_dir):
    rolled = chunking.document_rollup(documents(spark, sf_dir).select("doc_id"), C.chunks(spark, sf_dir), "doc_id")
    return evaluation.corpus_totals(rolled, evaluation.stability(run_rows(spark, sf_dir)))


@register("SELECT round(count(*) / (sum(value) / 1000), 6) queries_per_second FROM events")
def throughput(spark, sf_dir):
    return evaluation.throughput(table(spark, sf_dir, "events"), "value").select(r6(F.col("queries_per_second")).alias("queries_per_second"))


@register("WITH a AS (SELECT user_id, max(event_type) v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(event_type) v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT count(*) FILTER (a.v IS DISTINCT FROM b.v) stale, count(*) compared FROM a JOIN b USING (user_id)")
def stale_results(spark, sf_dir):
    half = lambda k: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("event_type").alias("v"))
    return evaluation.mismatches(half(0), half(1), "user_id", "v")


@register("""WITH r AS (SELECT user_id, event_id % 4 AS mode, floor(value / 100) * 0.2 AS repeat_rate, count(*) requests, count(*) FILTER (event_type = 'error') errors, max(value) p95 FROM events GROUP BY ALL)
SELECT mode, round(repeat_rate, 1) repeat_rate, count(*) runs, sum(requests)::BIGINT requests, sum(errors)::BIGINT errors, round(median(p95), 3) p95 FROM r GROUP BY 1, 2""")
def profile_medians(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4).alias("mode"), F.round(F.floor(F.col("value") / 100) * 0.2, 1).alias("repeat_rate")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("p95"))
    return evaluation.profile_medians(runs, ["p95"])


@register("SELECT event_type AS route, count(*) requests, round(sum(value) / 1000, 5) AS seconds FROM events GROUP BY 1")
def request_counters(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.lit("GET").alias("method"), F.col("event_type").alias("route"), F.lit(200).alias("status"), F.col("value").alias("duration_ms"))
    return tables.request_counters(log).select("route", "requests", F.round("seconds", 5).alias("seconds"))


@register("""SELECT 'requests{type="' || replace(replace(event_type, '\\', '\\\\'), '"', '\\"') || '"} ' || count(*) AS value FROM events GROUP BY event_type""")
def exposition_lines(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumnRenamed("event_type", "type")
    return tables.exposition(counts, "requests", ["type"])


@register("SELECT event_type AS name, round(sum(value), 3) AS value FROM events GROUP BY 1")
def metrics_scrape(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("v"))
    lines = sums.select(F.concat_ws(" ", "event_type", F.col("v").cast("string")).alias("value")).unionByName(sums.select(F.concat(F.lit("# HELP "), F.col("event_type")).alias("value")))
    return files.parse_metrics(lines)


@register("SELECT doc_id, left(sha256(regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g')), 16) AS query_id FROM documents")
def query_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.query_id(F.col("text")).alias("query_id"))


@register(r"SELECT page_id, string_split(url, '/')[-1] AS name, lower(regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]+)$', 1)) AS suffix, regexp_matches(string_split(url, '/')[-1], '^[A-Za-z0-9._-]+$') AND length(string_split(url, '/')[-1]) <= 128 AS safe FROM pages")
def page_names(spark, sf_dir):
    name = X.basename(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), X.suffix(F.col("url")).alias("suffix"), X.safe_label(name).alias("safe"))


@register(r"""SELECT page_id, CASE lower(regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]+)$', 1)) WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.pdf' THEN 'pdf' END AS format,
left(sha256(html), 2) || '/' || sha256(html) || lower(regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]+)$', 1)) AS place FROM pages""")
def stored_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.file_format(F.col("url")).alias("format"), files.storage_path(F.sha2("html", 256), F.col("url")).alias("place"))


_SPANS = r"""p AS (SELECT conv_id, turn + 1 AS page_number, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) n FROM conversations),
spans AS (SELECT conv_id, page_number, coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT char_start, n FROM p WHERE n > 0)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = messages(spark, sf_dir).withColumn("number", F.col("position") + 1)
    return files.page_spans(pages, "conv_id", "number", "text")


@register(f"WITH {_SPANS} SELECT conv_id, page_number, char_start, char_start + n AS char_end FROM spans")
def page_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@register(f"WITH {_SPANS} SELECT conv_id, string_agg(page_number, ',' ORDER BY page_number) pages FROM spans WHERE char_start < 700 AND char_start + n > 300 GROUP BY 1")
def pages_of_range(spark, sf_dir):
    listed = spans(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "char_start", "char_end"))).alias("spans"))
    return listed.select("conv_id", F.array_join(files.pages_of_range(F.col("spans"), F.lit(300), F.lit(700)).cast("array<string>"), ",").alias("pages")).where("pages <> ''")


@register("SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 0")
def without_deleted(spark, sf_dir):
    gone = documents(spark, sf_dir).where("doc_id % 7 = 0").select("doc_id")
    return tables.without_deleted(documents(spark, sf_dir).select("doc_id", "source"), gone, "doc_id")


@register(C._CHUNKS + "SELECT doc_id, position FROM chunks WHERE doc_id % 7 <> 0")
def cascade_delete(spark, sf_dir):
    gone = documents(spark, sf_dir).where("doc_id % 7 = 0").select("doc_id")
    return tables.without_deleted(C.chunks(spark, sf_dir).select("doc_id", "position"), gone, "doc_id")


@register("WITH l AS (SELECT user_id AS key, arg_max(event_type, event_id) AS payload, max(event_id) AS seq FROM events GROUP BY 1) SELECT * FROM l WHERE payload <> 'error'")
def cache_rows(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("payload"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    return tables.latest(log, ["key"], "seq", "deleted").select("key", "payload", "seq")


@register("SELECT event_id, 1 + count(*) FILTER (event_type = 'error') OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS corpus_version FROM events")
def corpus_versions(spark, sf_dir):
    """The version under which each request ran, where every error was an invalidation."""
    log = table(spark, sf_dir, "events").select("event_id", "event_type")
    return tables.versions_at(log, "event_id", F.col("event_type") == "error").select("event_id", "corpus_version")


@register("""SELECT item_id, sha256('{"dimension":64,"model":"m","query":"' || regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g') || '"}') AS key FROM benchmark""")
def embedding_keys(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", X.normalize(F.col("text")).alias("query"))
    return asked.select("item_id", F.sha2(F.to_json(F.struct(F.lit(64).alias("dimension"), F.lit("m").alias("model"), "query")), 256).alias("key"))


@register("SELECT conv_id AS id, max(turn) AS updated_at FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50 OFFSET 10")
def conversation_page(spark, sf_dir):
    heads = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(F.max("position").alias("updated_at"))
    return filters.page(heads, [F.desc("updated_at"), F.col("id")], 10, 50)


@register(f"SELECT doc_id, sha256(CASE WHEN len({tokens_sql('text')}) <= 50 THEN text ELSE array_to_string(regexp_extract_all(text, '\\s*(?:{C.TOKEN})')[1:50], '') END) AS cut FROM documents")
def truncated_texts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.truncate_tokens(F.col("text"), F.lit(50)), 256).alias("cut"))


@register("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS usable FROM embeddings")
def usable_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", X.usable_vector(F.col("embedding"), 64).alias("usable"))


@register("""SELECT conv_id, turn, sha256('Use the following retrieved context to answer the question.' || chr(10) || chr(10) || 'Context:' || chr(10) || '(No relevant context was retrieved.)' || chr(10) || chr(10) || 'Question:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS prompt FROM conversations WHERE role = 'user'""")
def grounded_prompts(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.sha2(X.prompt(F.lit(""), F.col("text")), 256).alias("prompt"))


@register(C._CHUNKS.replace("200", "50").replace("180", "40") + "SELECT doc_id, position, token_start, token_end, char_start, char_end FROM chunks")
def chunk_override(spark, sf_dir):
    rows = chunking.chunk_fixed(documents(spark, sf_dir), "doc_id", "text", 50, 10)
    return rows.select("doc_id", "position", "token_start", "token_end", *[F.col(c).cast("int").alias(c) for c in ("char_start", "char_end")])


@register("SELECT DISTINCT source || '-' || lang AS filename FROM documents WHERE source || '-' || lang NOT IN (SELECT source || '-' || lang FROM documents WHERE n_chars > 3000 AND source IS NOT NULL AND lang IS NOT NULL)")
def missing_files(spark, sf_dir):
    """Pairs of source and language that have no long document: expected less present."""
    name = F.concat("source", F.lit("-"), "lang").alias("filename")
    named = documents(spark, sf_dir).select(name).where("filename is not null").distinct()
    present = documents(spark, sf_dir).where("n_chars > 3000").select(name)
    return benchmark.missing(present.withColumns({"status": F.lit("ready"), "indexing_status": F.lit("indexed")}), named)


@register(C._GOLD + " SELECT h.qid, h.rank::INT AS rank, round(coalesce(max(coverage), 0), 6) coverage, coalesce(max(coverage), 0) >= 0.5 relevant FROM hits h LEFT JOIN cov USING (qid, rank) GROUP BY ALL")
def enriched_hits(spark, sf_dir):
    passages, hits = C.gold_and_hits(spark, sf_dir)
    return benchmark.enrich_hits(hits, passages).select("qid", "rank", r6(F.col("coverage")).alias("coverage"), "relevant")


@register("WITH e AS (SELECT user_id, avg(value) AS a, max(value) AS b FROM events GROUP BY 1) SELECT round(avg(a), 6) a, round(avg(b), 6) b FROM e")
def macro_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid")).agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return evaluation.macro_average(rows).select(r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@register(C._CHUNKS + "SELECT doc_id, position, char_start, char_end FROM chunks WHERE char_start >= 0 AND char_end > char_start")
def checked_spans(spark, sf_dir):
    """The spans of all chunks; one that isn't a span would be an error."""
    return evaluation.check_spans(C.chunk_fixed(spark, sf_dir)).select("doc_id", "position", "char_start", "char_end")


@register(f"""WITH {C._KEYWORD}, h AS (SELECT qid, doc_id, rank FROM kr WHERE rank <= 3) SELECT qid, string_agg(rank || ':' || doc_id || ':' || source, ',' ORDER BY rank) AS citations FROM h JOIN documents USING (doc_id) GROUP BY 1""")
def available_citations(spark, sf_dir):
    hits = retrieval.top_k(index.keyword_scores(C.document_index(spark, sf_dir), C.benchmark_queries(spark, sf_dir), 3), 3, "doc_id")
    rows = hits.join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id").select("qid", F.col("rank").alias("citation_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("filename"), F.lit(0).alias("position"))
    listed = benchmark.available_citations(rows)
    return listed.select("qid", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["citation_id"].cast("string"), c["chunk_id"].cast("string"), F.coalesce(c["filename"], F.lit("")))), ",").alias("citations"))


@register(f"""WITH {C._KEYWORD}, h AS (SELECT *, 1.0 / (1 + rank) AS rerank_score, min(score) OVER (PARTITION BY qid) lo, max(score) OVER (PARTITION BY qid) hi FROM kr WHERE rank <= 5),
b AS (SELECT qid, doc_id, round(0.7 * rerank_score + (1 - 0.7) * CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS blended FROM h) SELECT * FROM b""")
def rerank_given_scores(spark, sf_dir):
    hits = retrieval.top_k(index.keyword_scores(C.document_index(spark, sf_dir), C.benchmark_queries(spark, sf_dir), 5), 5, "doc_id")
    scores = hits.select("qid", "doc_id", (1.0 / (1 + F.col("rank"))).alias("rerank_score"))
    return context.rerank_external(hits, scores, "doc_id").select("qid", "doc_id", r6(F.col("blended")).alias("blended"))


@register(f"""WITH {C._KEYWORD} SELECT qid, doc_id AS document_id, doc_id || '-0' AS chunk_id, source AS filename, lang AS media_type, 0 AS position, rank::INT AS rank, round(score, 6) AS score FROM kr JOIN documents USING (doc_id) WHERE rank <= 10""")
def search_hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    one = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", F.lit(0).alias("position"), F.lit(0).alias("token_start"), X.token_count(F.col("text")).alias("token_end"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    named = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("media_type"))
    ranked = retrieval.top_k(index.keyword_scores(C.document_index(spark, sf_dir), C.benchmark_queries(spark, sf_dir), 10), 10, "doc_id")
    found = ranked.select("qid", "rank", F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"), "score", F.lit(None).cast("double").alias("vector_score"), F.col("score").alias("keyword_score"))
    return retrieval.hits_of(found, one, named).select("qid", "document_id", "chunk_id", "filename", "media_type", "position", "rank", r6(F.col("score")).alias("score"))


@register(f"WITH q AS (SELECT item_id qid, list_distinct({C.terms_sql('text')}) w FROM benchmark), d AS (SELECT doc_id, {C.terms_sql('text')} t FROM documents) SELECT qid, doc_id FROM q, d WHERE len(w) > 0 AND list_has_all(t, w)")
def full_text_matches(spark, sf_dir):
    return index.text_matches(C.document_index(spark, sf_dir), C.benchmark_queries(spark, sf_dir))


@register("""SELECT user_id AS client, event_id AS request_id, to_json({'event_id': event_id, 'event_type': event_type}) AS line FROM events""")
def log_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    lines = files.log_lines(rows.select("event_id", "event_type")).select(F.col("value").alias("line"), F.get_json_object("value", "$.event_id").cast("long").alias("request_id"))
    return rows.select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id")).join(lines, "request_id")


@register(f"WITH a AS (SELECT conv_id, turn, text, len({tokens_sql('text')})::INT n FROM conversations) SELECT conv_id, turn, n AS tokens, strpos(text, 'e') - 1 AS first_e FROM a")
def message_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", X.token_count(F.col("text")))
    return rows.select("conv_id", "turn", "tokens", (F.instr("text", "e") - 1).alias("first_e"))


# Gold annotations: the first line of each document as a marker on a page that is the whole text.
_MARKED = "m AS (SELECT doc_id, text, string_split(text, chr(10))[1] marker FROM documents WHERE length(string_split(text, chr(10))[1]) >= 10)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), F.lit(1).alias("page_number"), F.lit(0).alias("page_start"), F.col("text").alias("page_text"))
    line = F.get(F.split("page_text", "\n"), F.lit(0))
    notes = pages.select(F.col("source_path").alias("id"), "source_path", "page_number", line.alias("start_marker"), line.alias("end_marker")).where("length(start_marker) >= 10")
    return files.locate_passages(notes, pages)


@register(f"WITH {_MARKED} SELECT doc_id::VARCHAR AS id, 0 AS char_start, length(rtrim(marker, ' ')) AS char_end, sha256(rtrim(marker, ' ')) AS text_sha256 FROM m")
def gold_passages_located(spark, sf_dir):
    return marked(spark, sf_dir).select("id", "char_start", "char_end", "text_sha256")


@register(f"WITH {_MARKED}, w AS (SELECT doc_id::VARCHAR AS id, len(string_split(regexp_replace(trim(rtrim(marker, ' '), ' ' || chr(10)), '\\s+', ' ', 'g'), ' ')) n FROM m) SELECT id, 'too short' AS problem FROM w WHERE n < 8")
def gold_problems(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), "text")
    return files.gold_violations(marked(spark, sf_dir), docs)
