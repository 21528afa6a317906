"""Reranking, deduplication and token-budgeted context (A11, A12, C3, C4, O5, W5, W6), history and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as X


def lexical_overlap(query: Column, text: Column) -> Column:
    """Shared different terms over the geometric mean of both counts; 0 if either has none."""
    q, d = X.rerank_terms(query), X.rerank_terms(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, d)).cast("double"), F.sqrt(F.size(q).cast("double") * F.size(d))), F.lit(0.0))


def min_max(score: Column, group: str = "qid") -> Column:
    """0 to 1 within the list; all 1 where the ends are as good as equal."""
    over = Window.partitionBy(group)
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(1.0)).otherwise((score - low) / (high - low))


def rerank(hits: DataFrame, key: str, query: str = "query", text: str = "text", weight: float = 0.7, enabled: bool = True) -> DataFrame:
    """Hits (qid, key, query, text, score, rank) with rerank_score, final score ``blended`` and ``place``."""
    if not 0 <= weight <= 1:
        raise ValueError("rerank_weight must be between 0 and 1")
    if not enabled:
        return hits.withColumns({"rerank_score": F.lit(None).cast("double"), "blended": F.col("score"), "place": F.col("rank")})
    scored = hits.withColumn("rerank_score", lexical_overlap(F.col(query), F.col(text)))
    scored = scored.withColumn("blended", weight * F.col("rerank_score") + (1 - weight) * min_max(F.col("score")))
    order = Window.partitionBy("qid").orderBy(F.desc("blended"), "rank", F.col(key).cast("string"))
    return scored.withColumn("place", F.row_number().over(order))


def rerank_external(hits: DataFrame, scores: DataFrame, key: str, weight: float = 0.7) -> DataFrame:
    """As :func:`rerank` with scores (qid, key, rerank_score) from elsewhere; one is required for each hit, from 0 to 1."""
    met = hits.join(scores, ["qid", key], "left")
    checked = F.when(F.col("rerank_score").between(0.0, 1.0), F.col("rerank_score")).otherwise(F.raise_error(F.lit("reranker scores must be finite and between 0 and 1, one a document")).cast("double"))
    scored = met.withColumn("rerank_score", checked).withColumn("blended", weight * F.col("rerank_score") + (1 - weight) * min_max(F.col("score")))
    order = Window.partitionBy("qid").orderBy(F.desc("blended"), "rank", F.col(key).cast("string"))
    return scored.withColumn("place", F.row_number().over(order))


def deduplicate(hits: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Hits of a query in place order, less those whose folded text, or whose id ``key``, an earlier kept hit has; places
    close up in ``unique_place``. Without ``key`` ids are taken to be different.

    A query's hits are a bounded list (its candidates), so the walk over ids and texts is one fold a query."""
    same = X.dedup_key(F.col(text))
    if key is None:
        first = Window.partitionBy("qid", "_same").orderBy("place")
        kept = hits.withColumn("_same", same).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_same", "_n")
    else:
        listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.col(key).cast("string").alias("id"), F.sha2(same, 256).alias("same")))).alias("_all"))
        start = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<int>").alias("places"))
        seen = lambda a, x: F.array_contains(a["ids"], x["id"]) | F.array_contains(a["texts"], x["same"])
        add = lambda a, x: F.struct(F.array_append(a["ids"], x["id"]).alias("ids"), F.array_append(a["texts"], x["same"]).alias("texts"), F.array_append(a["places"], x["place"].cast("int")).alias("places"))
        walked = F.aggregate("_all", start, lambda a, x: F.when(seen(a, x), a).otherwise(add(a, x)))
        kept = hits.join(listed.select("qid", F.explode(walked["places"]).alias("place")), ["qid", "place"])
    return kept.withColumn("unique_place", F.row_number().over(Window.partitionBy("qid").orderBy("place")))


def fit_budget(hits: DataFrame, header: Column, text: str = "text", max_chunks: int = 8, max_tokens: int = 1200) -> DataFrame:
    """Hits in unique_place order until the token budget is used up, headers included; the last text may be cut.

    Adds citation_id, context_text, context_tokens and truncated. Tokens never span the line break behind a header, so
    counts of pieces add up and a running sum decides."""
    if max_chunks <= 0 or max_tokens <= 0:
        raise ValueError("max_chunks and max_context_tokens must be positive")
    sized = hits.withColumn("_head", X.token_count(header)).withColumn("_size", X.token_count(F.col(text)))
    before = Window.partitionBy("qid").orderBy("unique_place").rowsBetween(Window.unboundedPreceding, -1)
    free = F.lit(max_tokens) - F.coalesce(F.sum(F.col("_head") + F.col("_size")).over(before), F.lit(0)) - F.col("_head")
    kept = sized.withColumn("_free", free.cast("int")).where((F.col("unique_place") <= max_chunks) & (F.col("_free") > 0) & (F.col("_size") > 0))
    return kept.withColumns({"citation_id": F.col("unique_place"), "context_text": X.truncate_tokens(F.col(text), F.col("_free")), "context_tokens": F.least("_size", "_free"), "truncated": F.col("_size") > F.col("_free")}).drop("_head", "_size", "_free")


def history_window(messages: DataFrame, conversation: str, position: str, tokens: Column, most: int = 20, budget: int = 2000) -> DataFrame:
    """Of the last ``most`` messages those that fit the budget, walking back until the first that doesn't."""
    back = Window.partitionBy(conversation).orderBy(F.desc(position))
    rows = messages.withColumn("token_count", tokens).withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most)
    return rows.withColumn("_sum", F.sum("token_count").over(back.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_back", "_sum")


def cited(answers: DataFrame, available: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, citation_id, ...) of the context's chunks that an answer cites; unknown numbers are dropped."""
    ids = answers.select(key, F.explode(X.citation_ids(F.col(answer))).alias("citation_id"))
    return ids.join(available, [key, "citation_id"])


def conversations(heads: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Every conversation with its number of messages and its next position (A3)."""
    counts = messages.groupBy(key).agg(F.count("*").alias("messages"), (F.max("position") + 1).alias("next_position"))
    return heads.join(counts, key, "left").withColumns({"messages": F.coalesce("messages", F.lit(0)), "next_position": F.coalesce("next_position", F.lit(0))})
