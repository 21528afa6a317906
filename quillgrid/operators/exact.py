"""The k best vectors of each query by cosine, all pairs scored, as matrix products of blocks.

Rows and queries are gathered into bounded blocks; every block of rows meets every block of queries in some task, and of each
meeting only a query's k best are handed on. Pairs grow with both sides, memory and rows that are shuffled don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.sources.tables import bounded_batches

VALUES = 1 << 19  # components of a block of rows, about
ASKED = 512  # queries of a block, about
_LARGE, _SMALL = 1e100, 1e-100  # whose squares are numbers


def regular(vector: Column, width: int) -> Column:
    """Of that width, all components finite, and a length that isn't 0 nor out of the range of squares."""
    v = F.transform(vector, lambda x: x.cast("double"))
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    even = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & largest.between(_SMALL, _LARGE)
    return (F.size(vector) == width) & F.coalesce(even, F.lit(False))


def _blocks(rows: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """rows: key, vector."""
    block = F.pmod(F.xxhash64("key", "vector"), F.lit(max(1, -(-rows.count() // size))))
    return rows.groupBy(block.alias("_block")).agg(F.collect_list(F.struct("key", F.col("vector").cast("array<double>").alias("v"))).alias("_r")).select(F.col("_r.key").alias(names[0]), F.flatten("_r.v").alias(names[1]))


def _best(batches: Iterator[pa.RecordBatch], width: int, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """Of each meeting: the k best of each query, rounded score falling, then key as text."""
    for batch in batches:
        for i in range(len(batch)):
            own, other = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("asked", "values"))
            keys, asking = batch.column("keys")[i].values, batch.column("qids")[i].values
            order = pc.array_sort_indices(pc.cast(keys, pa.string()), null_placement="at_start")
            keys, other = keys.take(order), other[order.to_numpy()]
            length = lambda m: np.sqrt((m * m).sum(axis=1, keepdims=True))
            scores = np.round((own @ other.T) / (length(own) * length(other).T), digits)
            if k < len(keys):
                least = np.partition(scores, -k, axis=1)[:, -k]
                q, at = np.nonzero(scores >= least[:, None])
                last = scores[q, at] == least[q]  # of those equal to the k-th, as many by text as still have a place
                first = np.searchsorted(q, np.arange(len(own)))
                better, equal = np.cumsum(~last), np.cumsum(last)
                before = lambda sums: np.where(first > 0, sums[first - 1], 0)[q]
                better_all = (np.bincount(q, weights=~last, minlength=len(own)).astype(int))[q]
                stays = ~last | (equal - before(equal) + better_all <= k)
                q, at = q[stays], at[stays]
            else:
                q, at = (x.ravel() for x in np.indices(scores.shape))
            yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)), keys.take(pa.array(at)), pa.array(scores[q, at])], ["qid", "key", "score"])


def best_pairs(rows: DataFrame, queries: DataFrame, width: int, k: int, digits: int, few: bool) -> DataFrame:
    """(qid, key, score) with the k best of each query, and more. rows: key, vector; queries: qid, vector; all regular.

    few: the queries are few enough to be broadcast."""
    ids, keys = (df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (rows, "key")))
    asked = _blocks(queries.select(F.col("qid").alias("key"), "vector"), ASKED, ("qids", "asked"))
    held = _blocks(rows, max(k, VALUES // width), ("keys", "values"))
    met = held.crossJoin(F.broadcast(asked)) if few else held.hint("shuffle_replicate_nl").crossJoin(asked)
    return bounded_batches(met).mapInArrow(partial(_best, width=width, k=k, digits=digits), f"qid {ids}, key {keys}, score double")
