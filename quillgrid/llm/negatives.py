"""Hard negatives of anchors by norm-bucketed search, exactly.

Candidates are sorted by norm, longest first, for each label, and cut into buckets of at most BUCKET rows; buckets that follow
one another make a lane of at most LANE rows. By Cauchy-Schwarz no row of a bucket scores more with an anchor than the anchor's
norm times the bucket's largest norm. An anchor looks for scores in windows; a lane is not sent to a block of anchors, and a
bucket is not scored, where that bound stays below the lower limit of every window, or below the score of the last of the
k best so far. Nothing else is left out, so the result is that of all rows.

Two searches: the positives (rows of the anchor's label, one window without limits; the longest bucket of each label is
searched first, and what it finds is the lower limit for the others), then the negatives (rows of other labels, one window a
positive). Blocks of anchors meet lanes in tasks of bounded size; no pair of rows leaves a task but the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_batches, materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of a positive's score between which a hard negative's score lies
BUCKET = 2048  # rows of a bucket
LANE = 64 * BUCKET  # rows of a lane
BLOCK = 4096  # anchors of a block
GROUP = 16  # blocks that meet a lane in one task
SLICE = 256  # anchors scored at once against a bucket
SPREAD = 2000  # partitions that lanes are dealt to, at most, where fewer are set for shuffles
_LEAST, _MOST = -(1 << 62), 1 << 62
_SLACK = 1 + 1e-9  # norms are rounded; bounds are not undercut by that


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors are whole and finite, their components as floor(scale * x): bytes of 4-byte floats where exact, else 8."""
    for batch in batches:
        vectors = batch.column("vector")
        lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), -1)
        values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        for size in np.unique(lengths[lengths >= 0]):
            at = np.flatnonzero(lengths == size)
            rows = values[starts[at][:, None] + np.arange(size)]
            fine = np.isfinite(rows).all(axis=1)
            at, rows = at[fine], np.floor(scale * rows[fine])
            norms = np.sqrt((rows**2).sum(axis=1))
            if len(at) and not norms.max() < 2.0**31:
                raise ValueError("a vector is too long: its scores don't fit a long")
            for kind, some in (("<f4", np.abs(rows).max(axis=1, initial=0) < 1 << 24), ("<f8", np.abs(rows).max(axis=1, initial=0) >= 1 << 24)):
                if some.any():
                    packed = pa.array([r.tobytes() for r in rows[some].astype(kind)], pa.binary())
                    ids = [batch.column(c).take(pa.array(at[some])) for c in ("vec_id", "label")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(some.sum(), size, np.int32)), pa.array(norms[some]), packed], ["vec_id", "label", "size", "norm", "vector"])


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    if all(len(v) == 4 * size for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f4").reshape(-1, size) if size else np.zeros((len(vectors), 0), "<f4")
    return np.array([np.frombuffer(v, f"<f{len(v) // size}") for v in vectors], dtype="<f8")


_PACKED = pa.schema([("number", pa.int64()), ("run", pa.int64()), ("size", pa.int32()), ("label", pa.int64()), ("rows", pa.int32()), ("width", pa.int32()), ("top", pa.float64()), ("need", pa.float64()), ("ids", pa.binary()), ("norms", pa.binary()), ("vectors", pa.binary()), ("windows", pa.binary())])
_PACKED_SQL = "number long, run long, size int, label long, rows int, width int, top double, need double, ids binary, norms binary, vectors binary, windows binary"


def _cut(batches: Iterator[pa.RecordBatch], limit: int, a_run: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as packs of at most ``limit`` of one size and label; ``a_run`` packs that follow one another share a run."""
    number = run = TaskContext.get().partitionId() << 32
    key, held, in_run = None, [], 0

    def pack() -> pa.RecordBatch:
        nonlocal number, run, in_run
        if in_run == a_run:
            run, in_run = run + 1, 0
        rows = pa.Table.from_batches(held)
        rows = rows.take(np.argsort(rows["vec_id"].to_numpy(), kind="stable"))  # of equal scores the first is the smallest id
        matrix, norms = _matrix(rows["vector"].to_pylist(), key[0]), rows["norm"].to_numpy()
        windows = np.stack([np.array(rows[c].to_pylist(), "<i8").reshape(len(rows), -1) for c in ("lows", "highs")]) if "lows" in rows.column_names else None
        need = 0.0
        if windows is not None:
            lows = np.where(windows[0] <= windows[1], windows[0], _MOST).min(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = float(np.where(lows <= 0, 0.0, lows / norms).min())
        ids = np.stack([rows["vec_id"].to_numpy(), rows["row"].to_numpy()]).astype("<i8")
        one = [number, run, key[0], key[1], len(rows), matrix.itemsize, float(norms.max()), need, ids.tobytes(), norms.astype("<f8").tobytes(), matrix.tobytes(), windows.tobytes() if windows is not None else None]
        number, in_run = number + 1, in_run + 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, _PACKED, strict=True)], schema=_PACKED)

    for batch in batches:
        sizes, labels = batch.column("size").to_numpy(), batch.column("label").to_numpy()
        ends = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(labels) != 0)) + 1
        for a, b in zip([0, *ends], [*ends, len(batch)], strict=True):
            if a == b:
                continue
            own = (int(sizes[a]), int(labels[a]))
            if own != key and held:
                yield pack()
                held = []
            if own != key:
                key, run, in_run = own, run + 1, 0
            while a < b:
                room = limit - sum(map(len, held))
                held.append(batch.slice(a, min(room, b - a)))
                a += room
                if sum(map(len, held)) == limit:
                    yield pack()
                    held = []
    if held:
        yield pack()


def _packs(rows: DataFrame, n: int, limit: int, run_rows: int, name: str) -> DataFrame:
    """``rows`` sorted by size, label and falling norm over ranges of about equal numbers, cut into packs, written."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(n / run_rows), min(width, math.ceil(n / limit)))
    a_run = max(1, min(run_rows // limit, math.ceil(n / limit) // width))
    order = ["size", "label", F.desc("norm"), "vec_id", "row"]
    return materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(_cut, limit=limit, a_run=a_run), _PACKED_SQL), name)


def _unpack(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(pack["ids"], "<i8").reshape(2, -1)
    return ids[0], ids[1], np.frombuffer(pack["norms"], "<f8"), np.frombuffer(pack["vectors"], f"<f{pack['width']}").reshape(pack["rows"], pack["size"])


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows of whole numbers; by doubles where these hold them exactly."""
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_block(block: dict, buckets: list[dict], k: int, seen: list | None = None) -> tuple[np.ndarray, ...]:
    """(row, window, id, score) of the k best of ``buckets`` (longest norms first) in each window of each anchor of a block.

    ``seen`` gets the number of each bucket that was scored."""
    ids, rows, norms, vectors = _unpack(block)
    lows, highs = np.frombuffer(block["windows"], "<i8").reshape(2, len(ids), -1)
    scores, found = np.full((*lows.shape, k), _LEAST), np.full((*lows.shape, k), _MOST)
    for bucket in buckets:
        bound = norms * bucket["top"] * _SLACK + 1e-9
        open_ = (lows <= highs) & (bound[:, None] >= np.maximum(lows, scores[:, :, -1]))
        some = np.flatnonzero(open_.any(axis=1))
        if not len(some):
            break  # later buckets are shorter still
        if seen is not None:
            seen.append(bucket["number"])
        others, _, _, candidates = _unpack(bucket)
        for at in (some[i : i + SLICE] for i in range(0, len(some), SLICE)):
            made = _scores(vectors[at], candidates, float(bound[at].max()))
            made[ids[at][:, None] == others] = _LEAST
            for w in np.flatnonzero(open_[at].any(axis=0)):
                inside = np.where((made >= lows[at, w, None]) & (made <= highs[at, w, None]), made, _LEAST)
                best, who = [scores[at, w]], [found[at, w]]
                for _ in range(min(k, len(others))):
                    first = inside.argmax(axis=1)[:, None]
                    top = np.take_along_axis(inside, first, axis=1)
                    best.append(top)
                    who.append(np.where(top > _LEAST, others[first], _MOST))
                    np.put_along_axis(inside, first, _LEAST, axis=1)
                best, who = np.hstack(best), np.hstack(who)
                order = np.lexsort((who, -best), axis=1)[:, :k]
                scores[at, w], found[at, w] = np.take_along_axis(best, order, axis=1), np.take_along_axis(who, order, axis=1)
    a, w, j = np.nonzero(scores > _LEAST)
    return rows[a], w.astype(np.int32), found[a, w, j], scores[a, w, j]


def _meet(lane: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    buckets = sorted(lane.to_pylist(), key=lambda b: (-b["top"], b["number"]))
    parts = [search_block(b, buckets, k) for b in blocks.to_pylist()] if buckets else []
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in ("i8", "i4", "i8", "i8")]
    return pa.table(dict(zip(("row", "window", "vec_id", "score"), columns, strict=True)))


def _best(anchors: DataFrame, n: int, buckets: DataFrame, same_label: bool, k: int, name: str) -> DataFrame:
    """(row, window, vec_id, score): candidates that hold the k best of each window of each anchor; at most k of each lane.

    anchors: vec_id, row, size, label, norm, vector, lows and highs."""
    blocks = _packs(anchors, n, BLOCK, BLOCK * GROUP, f"{name}-blocks").withColumnRenamed("run", "block_run")
    lanes = buckets.groupBy("run", "size", "label").agg(F.max("top").alias("top"))
    # one row: a few numbers for each lane of up to 131,072 vectors
    listed = lanes.agg(F.collect_list(F.struct("run", "size", "label", "top")).alias("lanes"))
    reach = lambda x: (x["size"] == F.col("size")) & ((x["label"] == F.col("label")) if same_label else (x["label"] != F.col("label"))) & (x["top"] * _SLACK + 1e-9 >= F.col("need"))
    sent = blocks.crossJoin(F.broadcast(listed)).withColumn("run", F.explode(F.transform(F.filter("lanes", reach), lambda x: x["run"]))).drop("lanes")
    spark = buckets.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * math.ceil(n / BLOCK), SPREAD))
    wanted = sent.select(F.col("run").alias("lane"), F.col("block_run").alias("with")).distinct()
    candidates = buckets.select(F.col("run").alias("lane"), "number", "size", "rows", "width", "top", "ids", "norms", "vectors")
    met = candidates.join(wanted, "lane").repartition(width, "lane", "with").groupBy("lane", "with")
    def meet(lane: pa.Table, with_: pa.Table) -> pa.Table:
        return _meet(lane, with_, k)

    made = met.cogroup(sent.repartition(width, "run", "block_run").groupBy("run", "block_run")).applyInArrow(meet, "row long, window int, vec_id long, score long")
    return materialize(made, name)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``anchors`` (a condition on
    ``vec_id``) picks: its first rows of other labels whose score lies between ``low`` and ``high`` percent of a positive's.

    Components x count as floor(scale * x); scores are exact whole numbers. A positive below 0 has an empty window; one of 0
    takes scores of 0. Rows with a null id, label or vector, or a component that is null or not finite take no part, empty
    vectors do (all their scores are 0). Vectors meet those of their own length. Rows of an anchor's own id are never found; of
    rows that repeat id, label and vector one counts. No anchors, no positives or an empty table: no rows. Vectors so long that
    scores could leave 62 bits are an error. Other columns aren't read."""
    spark = bounded_batches(vectors).sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    whole = given.mapInArrow(partial(_whole, scale=scale), "vec_id long, label long, size int, norm double, vector binary")
    rows = materialize(whole.dropDuplicates(["vec_id", "label", "size", "vector"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(anchors)
    facts = rows.agg(F.count("*").alias("n"), F.count_if(anchors).alias("asked")).first()
    if not facts.asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    buckets = _packs(rows, facts.n, BUCKET, LANE, "buckets")
    longest = buckets.groupBy("size", "label").agg(F.min("number").alias("number"))
    longs = lambda *c: F.array(*[x.cast("long") for x in c])
    # positives: the longest bucket of the label first, the others only as far as they can reach what it gave
    open_ = asked.withColumns({"lows": longs(F.lit(_LEAST + 1)), "highs": longs(F.lit(_MOST))})
    first = _best(open_, facts.asked, buckets.join(longest, ["size", "label", "number"], "left_semi"), True, positives, "positives")
    reached = _ranked(first, positives).where(F.col("rank") == positives).select("row", F.col("score").alias("least"))
    limited = asked.join(reached, "row", "left").withColumns({"lows": longs(F.coalesce("least", F.lit(_LEAST + 1))), "highs": longs(F.lit(_MOST))}).drop("least")
    others = _best(limited, facts.asked, buckets.join(longest, ["size", "label", "number"], "left_anti"), True, positives, "positives")
    chosen = materialize(_ranked(first.unionByName(others), positives).select("row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # negatives: a window a positive; one that is absent is empty
    edges = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("_w"))
    share = lambda percent, j: F.expr(f"({percent}L * get(_w, {j}).positive_score - pmod({percent}L * get(_w, {j}).positive_score, 100L)) div 100L")  # noqa: E731  rounded down
    windows = edges.withColumns({"lows": longs(*[F.coalesce(-share(-low, j), F.lit(1)) for j in range(positives)]), "highs": longs(*[F.coalesce(share(high, j), F.lit(0)) for j in range(positives)])}).drop("_w")
    searching = asked.join(windows, "row").where(F.exists(F.arrays_zip("lows", "highs"), lambda x: x["lows"] <= x["highs"]))
    found = _ranked(_best(searching, facts.asked, buckets, False, negatives, "negatives"), negatives)
    named = asked.select("row", F.col("vec_id").alias("anchor_id"))
    return found.join(chosen, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
