"""Mixing sources to target weights by entropy balancing.

Document d of source s, with ``size`` words, gets the rate r_d that minimises sum(r log r - r) under one constraint a
source, sum(r_d * size_d) = target_s, and the bound r_d <= 2. The dual is convex with one multiplier a source:
r_d = min(2, exp(lambda_s * size_d / mean_s)). Newton steps on the dual are distributed: an iteration is one aggregation
of gradient and curvature over a histogram of (source, size), a sufficient statistic far smaller than the documents.

Rates become whole copies by a threshold: copies = floor(r) + [u - frac(r) < shift_s] with u a hash of the document;
shift_s is found by counting words in ever finer buckets, and single documents then close what is left of the gap.
Everything that reaches the driver or is broadcast has one row a source.
"""

from __future__ import annotations

import math
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all words, what the mix takes
MOST = 2  # copies of a document, and times its source's size
MAX_SOURCES = 100_000  # rows that may be held on the driver; more is an error
BUCKETS = 512
PASSES = 3
NEWTON_STEPS = 60
MENDS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("0"))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source is to give: ``share`` of all, by weights repeated over sources in code-point order (null last);
    what exceeds ``most`` times a source's size goes to the others by weight, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = dict(zip(order, cycle(weights), strict=False))
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _rate(lam: Column, size: Column, mean: Column) -> Column:
    """min(2, exp(lambda x)); a null lambda stands for a source whose target is all its words twice."""
    return F.when(lam.isNull(), F.lit(float(MOST))).otherwise(F.exp(F.least(lam * size / mean, F.lit(math.log(MOST)))))


def _solve(histogram: DataFrame, stats: dict[str, tuple[int, int]], goal: dict[str, float]) -> dict[str, float | None]:
    """The multiplier of each source by guarded Newton steps; each step is one distributed aggregation for all sources."""
    spark = histogram.sparkSession
    lam: dict[str, float | None] = {s: None if goal[s] >= MOST * size else 0.0 for s, (size, _) in stats.items() if size}
    low, high, open_ = {}, {}, {s for s in lam if lam[s] is not None}
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, float(lam[s]), stats[s][0] / stats[s][1]) for s in open_], "sk string, lam double, mean double")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        curve = F.when(rate < MOST, words * F.col("size") / F.col("mean")).otherwise(0.0)
        for row in histogram.join(F.broadcast(now), "sk").groupBy("sk").agg(F.sum(words).alias("words"), F.sum(curve).alias("curve")).collect():
            s, gap = row.sk, row.words - goal[row.sk]
            if abs(gap) <= max(0.5, 1e-6 * goal[s]):
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap / row.curve if row.curve > 0 else math.inf
            a, b = low.get(s), high.get(s)
            if not ((a is None or step > a) and (b is None or step < b) and abs(step - lam[s]) <= 50 + abs(lam[s])):
                step = (a + b) / 2 if a is not None and b is not None else (lam[s] - gap / abs(gap) * max(1.0, abs(lam[s])))
            lam[s] = step
    return lam


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A plan row for each row of ``docs``: doc_id, source, size, source_size, target, rate, copies (0 to 2), taken.

    ``taken`` is copies * size. Null text has size 0 and gives nothing; null is a source of its own, last in order. Rows
    that agree in doc_id, source and text take the same decision, so reruns agree whatever the order of rows. No rows, or
    no words at all: targets are 0. Other columns are not read."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _identity(docs, doc_id, text, source))
    units = materialize(read.withColumn("sk", _source_key(F.col("source"))), "mix-units")
    plan = _plan(units)
    return _apply(units, plan).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as many times as :func:`mix` says. Texts are not shuffled."""
    names = [F.col(f"r.`{c}`") for c in docs.columns]
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _identity(docs, doc_id, text, source)).withColumn("sk", _source_key(F.col("source")))
    units = materialize(read.select("source", "size", "rid", "sk"), "mix-units")
    copies = _apply(read, _plan(units))
    return copies.where("copies > 0").withColumn("_again", F.explode(F.expr("sequence(1, cast(copies as int))"))).select(*names)


def _identity(docs: DataFrame, doc_id: str, text: str, source: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("rid")


def _plan(units: DataFrame) -> DataFrame:
    """One row a source: its size, target, multiplier, shift and single corrections. units: sk, source, size, rid."""
    spark = units.sparkSession
    by_source = units.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats = {r.sk: (r["size"], r.n) for r in by_source}
    wanted = targets({r.source: r["size"] for r in by_source})
    goal = {r.sk: wanted[r.source] for r in by_source}
    if not by_source:
        return _parameters(spark, {}, {}, {}, {}, {})
    histogram = materialize(units.where("size > 0").groupBy("sk", "size").agg(F.count("*").alias("n")), "mix-histogram")
    lam = _solve(histogram, stats, goal)

    # rates to copies: the widest shift of the threshold that doesn't take more than the target
    distinct = materialize(units.where("size > 0").groupBy("sk", "rid").agg(F.first("size").alias("one"), F.sum("size").alias("size")), "mix-distinct")
    live = [s for s in lam if lam[s] is not None]
    shift, width = dict.fromkeys(live, -1.0), 2.0
    for at in range(PASSES):
        now = _parameters(spark, stats, goal, lam, shift, {})
        rated = _rated(distinct.withColumnRenamed("size", "all").withColumnRenamed("one", "size").join(F.broadcast(now), "sk").where("lam is not null"))
        bucket = F.floor((F.col("edge") - F.col("shift")) / F.lit(width / BUCKETS))
        place = F.when(F.col("whole") >= MOST, F.lit(BUCKETS)).otherwise(F.greatest(F.lit(-1), F.least(bucket, F.lit(BUCKETS))).cast("int"))
        counts = rated.select("sk", "target", place.alias("at"), "all", (F.col("whole") * F.col("all")).alias("sure")).groupBy("sk", "at").agg(F.first("target").alias("target"), F.sum("all").alias("extra"), F.sum("sure").alias("sure"))
        # at most BUCKETS + 2 rows a source: the first bucket that would take more than the target is found where they are
        own = Window.partitionBy("sk")
        up_to = F.sum(F.when(F.col("at") < BUCKETS, F.col("extra")).otherwise(0)).over(own.orderBy("at"))
        beyond = (F.col("at") < BUCKETS) & (F.sum("sure").over(own) + up_to > F.col("target"))
        for r in counts.select("sk", F.when(beyond, F.greatest("at", F.lit(0))).alias("k")).groupBy("sk").agg(F.min("k").alias("k")).collect():
            shift[r.sk] += (BUCKETS if r.k is None else r.k) * width / BUCKETS
        width /= BUCKETS

    # single documents close the rest: each pass takes, for a source, the largest that fits into its gap
    mends: dict[str, dict[int, int]] = {s: {} for s in live}
    copied = None
    for _ in range(MENDS):
        copied = _apply(distinct.withColumnRenamed("size", "all").withColumnRenamed("one", "size"), _parameters(spark, stats, goal, lam, shift, mends)).where("lam is not null")
        gap = {r.sk: goal[r.sk] - r.taken for r in copied.groupBy("sk").agg(F.sum(F.col("copies") * F.col("all")).alias("taken")).collect()}
        gaps = spark.createDataFrame([(s, float(g)) for s, g in gap.items() if abs(g) >= 1] or [("", 0.0)], "sk string, gap double")
        fits = copied.join(F.broadcast(gaps), "sk").where("all <= abs(gap) and if(gap > 0, copies < 2, copies > 0)")
        found = fits.groupBy("sk").agg(F.max(F.struct("all", "rid")).alias("best")).collect()
        if not found:
            break
        for r in found:
            mends[r.sk][r.best.rid] = mends[r.sk].get(r.best.rid, 0) + (1 if gap[r.sk] > 0 else -1)
    return _parameters(spark, stats, goal, lam, shift, mends)


def _parameters(spark, stats, goal, lam, shift, mends) -> DataFrame:
    rows = [(s, size, float(goal[s]), size / n if n else 1.0, None if lam.get(s) is None else float(lam[s]), float(shift.get(s, 0.0)), {int(k): int(v) for k, v in mends.get(s, {}).items()}) for s, (size, n) in stats.items()]
    return spark.createDataFrame(rows, "sk string, source_size long, target double, mean double, lam double, shift double, mends map<long,int>")


def _rated(joined: DataFrame) -> DataFrame:
    """Adds rate, whole (copies for sure) and edge (below the shift: one copy more)."""
    joined = joined.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size"), F.col("mean"))).otherwise(F.lit(0.0)))
    unit = F.pmod(F.xxhash64("rid", F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.withColumn("whole", F.floor("rate").cast("long")).withColumn("edge", unit - (F.col("rate") - F.floor("rate")))


def _apply(units: DataFrame, plan: DataFrame) -> DataFrame:
    """units with source_size, target, rate and copies; ``plan`` has one row a source and at most MAX_SOURCES rows."""
    rated = _rated(units.join(F.broadcast(plan), "sk", "left"))
    mended = F.coalesce(F.try_element_at("mends", "rid"), F.lit(0))
    copies = F.when(F.col("size") == 0, 0).when(F.col("whole") >= MOST, MOST + mended).otherwise(F.col("whole") + F.when(F.col("edge") < F.col("shift"), 1).otherwise(0) + mended)
    return rated.withColumn("copies", F.least(F.lit(MOST), F.greatest(F.lit(0), copies)).cast("long"))
