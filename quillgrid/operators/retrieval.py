"""Keyword, BM25 and vector search, fusion, and the composed search (A5-A10, O1-O6, J2-J5, C1). All work for many queries at once, by qid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators import exact

BROADCAST_ROWS = 10_000  # queries (a stated set) that may be broadcast; more are joined by shuffle


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """A side that is broadcast only behind a check of its size."""
    return F.broadcast(df) if is_small(df) else df


def texts_of(found: DataFrame, texts: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``found`` with its rows of ``texts``. Of these only those found are shuffled, by the ids of what was found (at most
    ``most`` are broadcast, behind a check; with more both sides are shuffled). found: written, as it is read more than once."""
    ids = found.select(key).distinct()
    held = texts.join(F.broadcast(ids), key, "left_semi") if is_small(ids, most) else texts
    return found.join(held, key)


def top_k(scored: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best of each query, score falling, then key as text rising; with their rank from 1."""
    if k <= 0:
        raise ValueError("top_k must be positive")
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.col(key).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): counts of each folded word in each text. Materialise it, by term, to serve many searches."""
    return _counted(_words(texts, key, text), key)


def _words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term): every word of every text; words are cut out once, and counted before they become rows."""
    return texts.select(F.col(key), X.terms(F.col(text)).alias("_terms")).select(key, F.size("_terms").alias("length"), F.explode("_terms").alias("term"))


def _counted(words: DataFrame, key: str) -> DataFrame:
    return words.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def corpus_figures(texts: DataFrame, text: str) -> DataFrame:
    """One row, the number of texts and the mean number of words; words are counted, not cut out."""
    return texts.agg(F.count("*").alias("n"), F.avg(X.term_count(F.col(text))).alias("mean"))


def _asked(texts: DataFrame, queries: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(words, hits): the queries' different words, and counts of those of them that occur in each text."""
    words = query_terms(queries)
    held = F.broadcast if is_small(words) else (lambda df: df)
    return held(words), _counted(_words(texts, key, text).join(held(words.select("term").distinct()), "term"), key)


def keyword_scores(texts: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """A5: (qid, key, score): share of a text's words that are words of the query; any one makes a hit."""
    words, hits = _asked(texts, queries, key, text)
    return hits.join(words, "term").groupBy("qid", key).agg((F.sum("tf") / F.first("length")).alias("score"))


def bm25_scores(texts: DataFrame, queries: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, key, score). Corpus figures are over all texts; only postings of query terms are counted."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    words, tf = _asked(texts, queries, key, text)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = tf.join(df, "term").crossJoin(F.broadcast(corpus_figures(texts, text)))  # one row of corpus figures
    return rows.select(key, "term", part.alias("part")).join(words, "term").groupBy("qid", key).agg(F.sum("part").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(qid, key, score) of each query against each present vector, exactly. Queries are a small stated set, checked in size."""
    asked = queries.where("vector is not null").select("qid", F.col("vector").alias("_q"))
    if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} query vectors: search in blocks")
    return vectors.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(asked)).select("qid", F.col(key), cosine(F.col(vector), F.col("_q")).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """(qid, key, score) with the k best of each query by :func:`vector_scores`, rounded to ``digits``; any number of queries.

    Vectors of one width, finite and not zero, are scored as matrix products of blocks. Others, on either side, pair by pair."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    asked = queries.where("vector is not null").select("qid", "vector")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    good = exact.regular(F.col("vector"), width)
    pairs = lambda a, b: a.crossJoin(b.withColumnRenamed("vector", "_q")).select("qid", "key", F.round(cosine(F.col("vector"), F.col("_q")), digits).alias("score"))
    found = exact.best_pairs(rows.where(good), asked.where(good), width, k, digits, is_small(asked))
    for odd, others in ((rows.where(~good), asked), (rows.where(good), asked.where(~good))):
        if not odd.isEmpty() and not others.isEmpty():
            found = found.unionByName(pairs(odd, others))
    return found.withColumnRenamed("key", key)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, vector_weight: float = 0.7, rrf_k: int = 60) -> DataFrame:
    """(qid, key, score, vector_score, keyword_score) of ranked lists by weighted reciprocal rank, 1 at best."""
    if not 0 <= vector_weight <= 1 or rrf_k < 0:
        raise ValueError("vector_weight must be between 0 and 1 and rrf_k at least 0")
    none = F.lit(None).cast("double")
    both = vector_hits.select("qid", key, (F.lit(float(vector_weight)) / (rrf_k + F.col("rank"))).alias("w"), F.col("score").alias("v"), none.alias("t")).unionByName(keyword_hits.select("qid", key, (F.lit(1.0 - vector_weight) / (rrf_k + F.col("rank"))).alias("w"), none.alias("v"), F.col("score").alias("t")))
    return both.groupBy("qid", key).agg((F.sum("w") * (rrf_k + 1)).alias("score"), F.max("v").alias("vector_score"), F.max("t").alias("keyword_score"))


def weighted_rrf(rankings: list[tuple[DataFrame, float]], key: str, rrf_k: int = 60) -> DataFrame:
    """(qid, key, score) over any number of weighted ranked lists; 0 where all weights are 0."""
    if not rankings or any(w < 0 for _, w in rankings):
        raise ValueError("at least one list, and weights of at least 0")
    parts = [hits.select("qid", key, (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("w")) for hits, w in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    best = sum(w for _, w in rankings) / (rrf_k + 1)
    return union.groupBy("qid", key).agg((F.sum("w") / best if best else F.lit(0.0)).alias("score"))


def branches(mode: str, top: int, vector_weight: float) -> tuple[bool, bool]:
    """The arguments of a search, checked; whether it looks by vector, and by words."""
    if mode not in ("vector", "keyword", "hybrid"):
        raise ValueError("unknown mode")
    if top <= 0 or not 0 <= vector_weight <= 1:
        raise ValueError("top_k must be positive and vector_weight between 0 and 1")
    return mode == "vector" or (mode == "hybrid" and vector_weight > 0), mode == "keyword" or (mode == "hybrid" and vector_weight < 1)


def search(texts: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text", vector: str = "embedding", mode: str = "hybrid", top: int = 10, vector_weight: float = 0.7, where: Column | None = None, candidate_multiplier: int = 4, rrf_k: int = 60, index=None, digits: int | None = None) -> DataFrame:
    """(qid, key, score, vector_score, keyword_score, rank). queries: qid, query, vector (needed unless keyword only).

    Filters hold before ranking. A branch of weight 0 isn't planned at all; each branch gives top * multiplier candidates. Texts
    without a vector are found by their words, queries without one ask by theirs. With an ``index`` of the texts (index.py), and
    no filter, words are looked up there. ``digits``: scores are rounded to so many before they are ranked, so that ties don't
    hang on the order of a sum."""
    use_vector, use_keyword = branches(mode, top, vector_weight)
    rows = texts if where is None else texts.where(where)
    many = top * candidate_multiplier if mode == "hybrid" else top
    even = lambda scored: scored if digits is None else scored.withColumn("score", F.round("score", digits))
    by_vector = top_k(vector_scores(rows, queries, key, vector) if digits is None else nearest(rows, queries, key, vector, many, digits), many, key) if use_vector else None
    by_word = lambda: keyword_scores(rows, queries, key, text) if index is None or where is not None else index.keyword(queries, many)
    by_keyword = top_k(even(by_word()), many, key) if use_keyword else None
    none = F.lit(None).cast("double")
    if mode == "vector":
        return by_vector.select("qid", key, "score", F.col("score").alias("vector_score"), none.alias("keyword_score"), "rank")
    if mode == "keyword":
        return by_keyword.select("qid", key, "score", none.alias("vector_score"), F.col("score").alias("keyword_score"), "rank")
    empty = (by_vector if by_vector is not None else by_keyword).limit(0)
    return top_k(even(fuse(empty if by_vector is None else by_vector, empty if by_keyword is None else by_keyword, key, vector_weight, rrf_k)), top, key)


#: The fields of a hit, in order.
HIT = ["chunk_id", "document_id", "filename", "media_type", "text", "position", "token_start", "token_end", "char_start", "char_end", "page_numbers", "metadata", "score", "vector_score", "keyword_score"]


def hits_of(found: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, rank and the fields of HIT): what a search found, with its chunks and their documents."""
    named = documents.select(F.col("id").alias("document_id"), "filename", "media_type")
    met = found.select("qid", "rank", "chunk_id", "score", "vector_score", "keyword_score").join(chunks, "chunk_id").join(named, "document_id")
    absent = [c for c in HIT if c not in met.columns]
    return met.withColumns({c: F.lit(None).cast("array<int>" if c == "page_numbers" else "string") for c in absent}).select("qid", "rank", *HIT)


def text_match(text: Column, query: Column, every: bool = True) -> Column:
    """P5: whether all different words of the query (or any of them) are words of the text; a query without words matches nothing."""
    asked, held = F.array_distinct(X.terms(query)), X.terms(text)
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, held)) == 0 if every else F.arrays_overlap(asked, held))


def text_matches(texts: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """P5 for many queries: (qid, key) where every word of the query is one of the text's, over the postings of query words."""
    words, hits = _asked(texts, queries, key, text)
    wanted = words.groupBy("qid").agg(F.count("*").alias("_wanted"))
    met = hits.select(key, "term").join(words, "term").groupBy("qid", key).agg(F.count("*").alias("_met"))
    return met.join(wanted, "qid").where("_met = _wanted").select("qid", key)
