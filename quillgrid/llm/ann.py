"""Approximate nearest neighbours by largest inner product, with collision-counting hashing.

Vectors get one more component that gives all of a shard the same length, so that the largest inner product is the smallest
distance. The index of a shard is, for each of PROJECTIONS directions, the vectors sorted by their projection; directions are
drawn in orthogonal sets, so that none repeats what another says. A query opens a window around its own projection in each
array; windows widen together (virtual rehashing: each width is a coarser hash of the same array). A vector that has been
met in THRESHOLD of the windows is a candidate; as windows that wide hold most of an array, what is counted are the vectors
left outside, on both sides. Widening ends when the candidates are a fixed share of the shard's different vectors;
candidates, however many, are then verified by their exact inner products. The first width is read off a sample of the shard.

Index shards and blocks of queries have bounded numbers of rows. Blocks travel to shards, each shard once to its task.
Vectors of different lengths (numbers of components) have no inner product: each length is searched by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize

K = 20
PROJECTIONS = 56
THRESHOLD = 0.9  # of the windows that must hold a candidate
SHARD = 8192  # expected vectors of a shard
BLOCK = 4096  # expected queries of a block
SHARE = 0.06  # of a shard's different vectors: candidates at which windows stop widening
LEAST = 20  # and at least so many times k
SAMPLE = 512  # vectors of a shard that a query's first width is read off
WIDEN = 1.04  # first step; each is so many times larger than the last
SEED = 20
SPREAD = 2000  # partitions that shards are dealt to, at most, where fewer are set for shuffles


def usable(vector: Column) -> Column:
    """Not null, not empty, all components present and finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(rows: pd.DataFrame, key: str, dtype: str) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    vectors = np.array(rows["vector"].tolist(), dtype=dtype)
    return pd.DataFrame({"size": [vectors.shape[1]], key: [int(rows[key].iloc[0])], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "vectors": [vectors.tobytes()]})


def directions(n: int, size: int) -> np.ndarray:
    """n directions in sets of ``size`` that are orthogonal among themselves."""
    rng, sets = np.random.default_rng(SEED), []
    for _ in range(-(-n // size)):
        sets.append(np.linalg.qr(rng.standard_normal((size, size)))[0])
    return np.concatenate(sets)[:n]


class Shard:
    """Sorted arrays over a shard's different vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        starts = np.searchsorted(which.ravel()[order], np.arange(len(self.vectors) + 1))
        # of equal vectors only the k + 1 smallest ids can be among the k nearest that aren't the query itself
        self.members = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(starts, starts[1:], strict=False)]
        squares = (self.vectors**2).sum(axis=1)
        self.longest = math.sqrt(squares.max())
        self.directions = directions(PROJECTIONS, self.vectors.shape[1] + 1)
        values = np.hstack([self.vectors, np.sqrt(np.maximum(0.0, squares.max() - squares))[:, None]]) @ self.directions.T
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        self.sample = values[np.random.default_rng(SEED).permutation(len(values))[:SAMPLE]]
        self.collisions = math.ceil(THRESHOLD * PROJECTIONS)

    def first_widths(self, centres: np.ndarray, need: int) -> np.ndarray:
        """For each query the width at which the needed share of the sample is met in enough windows."""
        share = min(1.0, need / len(self.vectors))
        at = min(len(self.sample) - 1, math.ceil(share * len(self.sample)))
        return np.array([np.partition(np.partition(np.abs(self.sample - c), self.collisions - 1, axis=1)[:, self.collisions - 1], at)[at] for c in centres])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, scores, verified) of each query: the k best candidates, and how many there were."""
        n = len(self.vectors)
        # the direction of a query is what counts; scaled to the vectors' length its windows fit
        scaled = queries * (self.longest / np.sqrt((queries**2).sum(axis=1, keepdims=True)))
        centres = scaled @ self.directions[:, :-1].T
        need = min(n, k + 1 + max(LEAST * k, math.ceil(SHARE * n)))
        widths, open_ = self.first_widths(centres, need), np.arange(len(queries))
        out, spare, orders = [None] * len(queries), PROJECTIONS - self.collisions, list(self.order)
        turn = 0
        while len(open_):
            turn += 1
            edges = [values.searchsorted([c - widths[open_], c + widths[open_]]).T for values, c in zip(self.sorted, centres[open_].T, strict=True)]
            still = []
            for q, ends in zip(open_.tolist(), np.stack(edges, axis=1).tolist(), strict=True):
                outside = [part for order, (low, high) in zip(orders, ends, strict=True) for part in (order[:low], order[high:])]
                found = np.flatnonzero(np.bincount(np.concatenate(outside), minlength=n) <= spare)
                if len(found) < need:
                    still.append(q)
                else:
                    out[q] = (*self.verify(found, int(query_ids[q]), queries[q], k), len(found))
            open_ = np.array(still, dtype=np.int64)
            widths[open_] = np.maximum(widths[open_] * WIDEN**turn, 1e-12 * self.longest)
        return out

    def verify(self, found: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact inner products of the candidates; the k best of their rows, ties to the smaller id, without the query's own."""
        vectors = self.vectors[found]
        scores = vectors @ query
        if len(found) > k + 1:  # rows of the k + 1 best different vectors, and of any that tie with the last of them
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            keep = scores >= least - 1e-9 * max(1.0, abs(least))
            found, vectors = found[keep], vectors[keep]
        exact = (vectors * query).sum(axis=1)
        members = [self.members[f] for f in found]
        ids, exact = np.concatenate(members), np.repeat(exact, [len(m) for m in members])
        ids, exact = ids[ids != own], exact[ids != own]
        top = np.lexsort((ids, -exact))[:k]
        return ids[top], exact[top]


def _search(batches: Iterator[pd.DataFrame], k: int, dtype: str) -> Iterator[pd.DataFrame]:
    """Rows are tiles, a shard and a block of queries; those of a shard follow one another."""
    last, shard = None, None
    for batch in batches:
        for size, number, ids, vectors, query_ids, queries in zip(batch["size"], batch["shard"], batch["ids"], batch["vectors"], batch["query_ids"], batch["queries"], strict=True):
            if last != (size, number):
                last, shard = (size, number), Shard(np.frombuffer(ids, dtype="<i8"), np.frombuffer(vectors, dtype=dtype).reshape(-1, size).astype(np.float64), k)
            query_ids, queries = np.frombuffer(query_ids, dtype="<i8"), np.frombuffer(queries, dtype=dtype).reshape(-1, size).astype(np.float64)
            found = shard.search(query_ids, queries, k)
            counts = [len(v) for v, _, _ in found]
            yield pd.DataFrame({"query_id": np.repeat(query_ids, counts), "vec_id": np.concatenate([v for v, _, _ in found]), "score": np.concatenate([s for _, s, _ in found])})


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on ``vec_id``) picks, its k nearest rows
    but those of its own id, by inner product in double precision, ties to the smaller id; all, where there are fewer.

    Rows with a null id or a vector that isn't usable take no part; a vector's neighbours are those of its own length. Rows
    that repeat an id count once for each different vector. An empty table, or one without queries, gives no rows."""
    spark = bounded_batches(vectors).sparkSession
    single = vectors.schema[embedding].dataType == T.ArrayType(T.FloatType(), vectors.schema[embedding].dataType.containsNull)
    dtype, kind = ("<f4", "float") if single else ("<f8", "double")
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    facts = given.agg(F.count("*").alias("n"), F.count_if(queries).alias("queries")).first()
    if not facts.n or not facts.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = math.ceil(facts.n / SHARD), math.ceil(facts.queries / BLOCK)
    different = lambda rows: rows.dropDuplicates(["vec_id", "vector"]).withColumn("size", F.size("vector"))
    dealt = different(given).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    index = materialize(dealt.groupBy("size", "shard").applyInPandas(partial(_pack, key="shard", dtype=dtype), "size int, shard long, ids binary, vectors binary"), "ann-index")
    asked = different(given.where(queries)).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)))
    packed = materialize(asked.groupBy("size", "block").applyInPandas(partial(_pack, key="block", dtype=dtype), "size int, block long, ids binary, vectors binary"), "ann-queries")
    # few large rows with much work each: partitions whose number is given aren't merged by size
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(8 * shards, SPREAD))
    sent = packed.select("size", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    tiles = index.repartition(width, "size", "shard").join(sent.repartition(width, "size", "shard"), ["size", "shard"])
    found = tiles.select("size", "shard", "ids", "vectors", "query_ids", "queries").mapInPandas(partial(_search, k=k, dtype=dtype), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.repartition("query_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
