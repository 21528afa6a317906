"""Offline evaluation over a gold set: systems side by side, with corpus checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import context, evaluation, retrieval


def missing(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected files that aren't ready and indexed."""
    ready = documents.where("status = 'ready' and indexing_status = 'indexed'").select("filename")
    return expected.join(ready, "filename", "left_anti")


def verify_corpus(documents: DataFrame, expected: DataFrame) -> None:
    """An error naming expected files that are missing."""
    absent = [r.filename for r in missing(documents, expected).orderBy("filename").limit(20).collect()]
    if absent:
        raise ValueError(f"documents are missing or not indexed: {', '.join(absent)}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """A25."""
    return df.groupBy(key).count().where("count > 1")


def gold_passages(entries: DataFrame) -> DataFrame:
    """A row for each relevant passage of each entry, its range checked."""
    rows = entries.select(F.col("id").alias("qid"), F.posexplode("relevant_passages").alias("passage_id", "p"))
    return evaluation.check_spans(rows.select("qid", "passage_id", "p.source_id", "p.char_start", "p.char_end"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Measurements of requests that succeeded."""
    schema = "request_index int, query string, latency_ms double, status_code int, result_chunk_ids string"
    return spark.read.option("header", True).schema(schema).csv(path).where("status_code between 200 and 299")


def write_measurements(rows: DataFrame, path: str) -> None:
    """S13."""
    rows.write.option("header", True).csv(path)


def available_citations(chunks: DataFrame) -> DataFrame:
    """A context's chunks as what an answer may cite, in the form they are stored."""
    return chunks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("citation_id", "chunk_id", "filename", "position"))).alias("citations"))  # at most max_chunks a query


def run_systems(chunks: DataFrame, queries: DataFrame, k: int = 20, rerank: bool = False, vector_weight: float = 0.7) -> dict[str, DataFrame]:
    """Ranked hits (qid, chunk_id, rank, source_id, char_start, char_end) of each system, for all queries at once."""
    if k < 20:
        raise ValueError("top_k must be at least 20")
    scored = {
        "vector": retrieval.search(chunks, queries, mode="vector", top=k),
        "keyword": retrieval.search(chunks, queries, mode="keyword", top=k),
        "hybrid": retrieval.search(chunks, queries, top=k, vector_weight=vector_weight),
        "bm25": retrieval.top_k(retrieval.bm25_scores(chunks, queries, "chunk_id", "text"), k, "chunk_id"),
    }
    dense = retrieval.search(chunks, queries, mode="vector", top=4 * k)
    words = retrieval.top_k(retrieval.bm25_scores(chunks, queries, "chunk_id", "text"), 4 * k, "chunk_id")
    scored["bm25_dense"] = retrieval.top_k(retrieval.weighted_rrf([(dense, vector_weight), (words, 1 - vector_weight)], "chunk_id"), k, "chunk_id")
    spans = chunks.select("chunk_id", "source_id", "char_start", "char_end", "text")
    out = {}
    for name, hits in scored.items():
        met = hits.select("qid", "chunk_id", "score", "rank").join(spans, "chunk_id")
        if rerank:  # O6: the reranker's order alone
            met = context.rerank(met.join(queries.select("qid", "query"), "qid"), "chunk_id", weight=1.0).withColumn("rank", F.col("place"))
        out[name] = met.select("qid", "chunk_id", "rank", "source_id", "char_start", "char_end")
    return out


def evaluate_systems(systems: dict[str, DataFrame], passages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Macro-averaged metrics, a row a system."""
    rows = None
    for name, hits in systems.items():
        one = evaluation.macro_average(evaluation.query_metrics(hits, passages, threshold)).withColumn("system", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def enrich_hits(hits: DataFrame, passages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hits with the best share of any passage they cover, and whether that makes them relevant. Hits, a search as a rule, are read once."""
    spans = passages.groupBy("qid", "source_id").agg(F.collect_list(F.struct("char_start", "char_end")).alias("_spans"))  # a query's passages in one source
    share = lambda p: evaluation.overlap(F.col("char_start"), F.col("char_end"), p["char_start"], p["char_end"]) / (p["char_end"] - p["char_start"])
    best = F.coalesce(F.array_max(F.transform("_spans", share)), F.lit(0.0))
    return hits.join(spans, ["qid", "source_id"], "left").withColumn("coverage", best).drop("_spans").withColumn("relevant", F.col("coverage") >= threshold)
