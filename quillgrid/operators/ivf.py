"""An inverted file of vectors (J2, O1): lists around centroids, searched near the query only; exact scores within.

The centroids are fitted by distributed k-means on a bounded sample of rows (SAMPLE); every usable vector is then put into the
list of its nearest centroid, and lists are written as blocks of about BLOCK vectors, so that one list may hold most of the table
(copies, say) without being one row or one task. A query is compared with the centroids and meets the blocks of its ``probe``
nearest lists, many queries and many vectors in one matrix product. Scores are exact cosines in double precision; what is
approximate is only which lists are read. With as many probes as lists the search is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.retrieval import top_k
from quillgrid.sources.tables import written

SAMPLE = 100_000  # rows that centroids are fitted on, at most
LISTS = 4096  # lists, at most; else the square root of the number of vectors
BLOCK = 1024  # vectors of a block, about
ASKED = 256  # queries that meet a block together


@dataclass(frozen=True)
class Ivf:
    """rows: list, block, keys, values (the vectors one after the other); centroids: a unit vector a list, on the driver."""

    rows: DataFrame
    centroids: np.ndarray
    key: str


def usable(vector: Column) -> Column:
    """Present, not empty, all components finite, and not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows  # squares of tiny and huge numbers
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, probe: int) -> Iterator[pa.RecordBatch]:
    """(key, list, vector): each row with its ``probe`` nearest lists."""
    for batch in batches:
        if not len(batch):
            continue
        near = np.argpartition(-(_unit(_matrix(batch.column("vector"), centroids.shape[1])) @ centroids.T), probe - 1, axis=1)[:, :probe]
        repeat = pa.array(np.repeat(np.arange(len(batch)), probe))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(repeat), pa.array(near.ravel().astype(np.int32)), batch.column("vector").take(repeat)], ["key", "list", "vector"])


def _listed(rows: DataFrame, centroids: np.ndarray, probe: int) -> DataFrame:
    """rows: key, vector. Vectors are doubles, of the centroids' width."""
    given = rows.select("key", F.col("vector").cast("array<double>").alias("vector"))
    return given.mapInArrow(partial(_nearest, centroids=centroids, probe=probe), f"key {rows.schema['key'].dataType.simpleString()}, list int, vector array<double>")


def _blocks(listed: DataFrame, size: int) -> DataFrame:
    """(list, block, keys, values): blocks of about ``size`` rows, dealt by key; a list's rows are counted, never gathered."""
    held = listed.groupBy("list").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = listed.join(F.broadcast(held), "list")  # one row a list, at most LISTS
    gathered = dealt.groupBy("list", F.pmod(F.xxhash64("key", "vector"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("key", "vector")).alias("_r"))
    return gathered.select("list", "block", F.col("_r.key").alias("keys"), F.flatten("_r.vector").alias("values"))


def write_ivf(vectors: DataFrame, key: str, vector: str, lists: int | None = None, seed: int = 11) -> Ivf:
    """Write the inverted file of ``vectors``. Rows without a usable vector aren't in it; vectors must be of one width.

    An empty table gives no lists and finds nothing."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    n, small, wide = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if small != wide:
        raise ValueError(f"vectors of {small} to {wide} components")
    if not n:
        return Ivf(_blocks(_listed(rows, np.ones((1, 1)), 1), BLOCK), np.empty((0, 0)), key)
    k = lists or max(1, min(LISTS, math.isqrt(n)))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    share = rows if n <= SAMPLE else rows.orderBy(F.xxhash64("key")).limit(SAMPLE)
    units = written(share.select(F.transform("vector", lambda x: x.cast("double")).alias("vector"), length.alias("length")).select(array_to_vector(F.transform("vector", lambda x: x / F.col("length"))).alias("features")), "ivf-sample")
    centroids = _unit(np.array(KMeans(k=k, seed=seed, maxIter=15).fit(units).clusterCenters()))
    return Ivf(written(_blocks(_listed(rows, centroids, 1), BLOCK).repartition("list", "block").sortWithinPartitions("list"), "ivf"), centroids, key)


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each block and the queries that meet it: the k best of each query, and what is equal to the last of them."""
    for batch in batches:
        for i in range(len(batch)):
            keys, asking = batch.column("keys")[i].values, batch.column("qids")[i].values
            width = len(batch.column("values")[i].values) // len(keys)
            own, other = (_unit(_matrix(batch.column(c).slice(i, 1), width)) for c in ("asked", "values"))
            scores = own @ other.T
            least = np.partition(scores, -k, axis=1)[:, -k] if k < len(keys) else np.full(len(own), -np.inf)
            q, at = np.nonzero(scores >= least[:, None] - 1e-12)
            yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)), keys.take(pa.array(at)), pa.array(scores[q, at])], ["qid", "key", "score"])


def met(ivf: Ivf, queries: DataFrame, probe: int) -> DataFrame:
    """(list, block, keys, values, qids, asked): blocks with the queries (qid, vector) that meet them, at most about ASKED a row."""
    asked = queries.where(usable(F.col("vector")) & (F.size("vector") == ivf.centroids.shape[1])).select(F.col("qid").alias("key"), "vector")
    groups = _blocks(_listed(asked, ivf.centroids, min(probe, len(ivf.centroids))), ASKED)
    return ivf.rows.join(groups.select("list", F.col("keys").alias("qids"), F.col("values").alias("asked")), "list")


def search(ivf: Ivf, queries: DataFrame, k: int, probe: int) -> DataFrame:
    """O1: (qid, key, score, rank), the k nearest by cosine in the ``probe`` lists nearest to each query; ties by key as text.

    Queries without a usable vector, or of another width, find nothing."""
    if k <= 0 or probe <= 0:
        raise ValueError("k and probe must be positive")
    ids, keys = (df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (ivf.rows, "keys")))
    if not len(ivf.centroids):
        return queries.sparkSession.createDataFrame([], f"qid {ids}, {ivf.key} {keys[6:-1]}, score double, rank int")
    found = met(ivf, queries, probe).mapInArrow(partial(_scored, k=k), f"qid {ids}, key {keys[6:-1]}, score double")
    return top_k(found.withColumn("score", F.round("score", 9)).withColumnRenamed("key", ivf.key), k, ivf.key)


def share_read(ivf: Ivf, queries: DataFrame, probe: int) -> float:
    """What part of all pairs of a query and a vector a search scores."""
    pairs = met(ivf, queries, probe).agg(F.sum(F.size("keys").cast("long") * F.size("qids"))).first()[0] or 0
    asked = queries.where(usable(F.col("vector"))).count()
    return pairs / max(1, asked * (ivf.rows.agg(F.sum(F.size("keys"))).first()[0] or 0))


def probes(ivf: Ivf, k: int = 10, target: float = 0.95, sample: int = 64) -> int:
    """How many lists a search must read for ``target`` of the k nearest: measured on ``sample`` of the index's own vectors.

    Each asks all lists once; the places, in its order of lists, of those that hold its nearest give the number. Where vectors
    have no clusters, that is most of the lists: the search says so by its cost, not by what it misses."""
    if not len(ivf.centroids):
        return 1
    width = ivf.centroids.shape[1]
    at = ivf.rows.select("list", "block", F.posexplode("keys").alias("pos", "qid"))
    drawn = at.orderBy(F.xxhash64("qid"), "list", "block", "pos").limit(sample).dropDuplicates(["qid"])
    asked = written(drawn.join(ivf.rows.select("list", "block", "values"), ["list", "block"]).select("qid", F.slice("values", F.col("pos") * width + 1, F.lit(width)).alias("vector")), "ivf-asked")
    found = search(ivf, asked, k + 1, len(ivf.centroids)).where(F.col(ivf.key) != F.col("qid"))
    where = at.select(F.col("qid").alias(ivf.key), "list")
    rows = where.join(F.broadcast(found), ivf.key).select("qid", "list").collect()  # sample * (k + 1) rows
    if not rows:
        return 1
    vectors = {r.qid: r.vector for r in asked.collect()}
    order = {q: np.argsort(np.argsort(-(ivf.centroids @ _unit(np.array([v]))[0]))) for q, v in vectors.items()}
    return 1 + int(np.quantile([order[r.qid][r.list] for r in rows], target, method="higher"))
