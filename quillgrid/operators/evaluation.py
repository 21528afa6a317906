"""Retrieval evaluation: passage coverage, ranking metrics, latency, run comparison."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.ranks import in_place, with_percentiles
from quillgrid.sources.tables import written

#: Fields of a run that must agree before its metrics are compared.
CONTROL = ["dataset_sha256", "mode", "top_k", "vector_weight", "relevance_threshold", "repetitions", "embedding_models"]
RESAMPLES_AT_ONCE = 500
ROWS_AT_ONCE = 50_000
#: Metrics of which less is better.
LESS_IS_BETTER = ("irrelevant_at_5", "latency_mean_ms", "latency_p50_ms", "latency_p95_ms")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def check_spans(df: DataFrame, start: str = "char_start", end: str = "char_end") -> DataFrame:
    """An error where a span doesn't begin at 0 or later and end behind its start."""
    good = (F.col(start) >= 0) & (F.col(end) > F.col(start))
    return df.withColumn(start, F.when(good, F.col(start)).otherwise(F.raise_error(F.lit("invalid character range")).cast(df.schema[start].dataType)))


def coverage(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Each retrieved chunk with each passage of its query and source, and the share of the passage it covers.

    chunks: qid, rank, source_id, char_start, char_end; passages: qid, passage_id, source_id, char_start, char_end."""
    p = passages.select("qid", "source_id", "passage_id", F.col("char_start").alias("p_start"), F.col("char_end").alias("p_end"))
    met = chunks.join(p, ["qid", "source_id"])
    common = overlap(F.col("char_start"), F.col("char_end"), F.col("p_start"), F.col("p_end"))
    return met.withColumn("coverage", common / (F.col("p_end") - F.col("p_start"))).withColumn("whole", (F.col("char_start") <= F.col("p_start")) & (F.col("char_end") >= F.col("p_end")))


def union_coverage(covered: DataFrame, k: int) -> DataFrame:
    """(qid, passage_id, coverage) of the first k chunks together: clipped intervals, overlaps counted once."""
    clipped = covered.where(F.col("rank") <= k).select("qid", "passage_id", "p_start", "p_end", F.greatest("char_start", "p_start").alias("s"), F.least("char_end", "p_end").alias("e")).where("e > s")
    before = Window.partitionBy("qid", "passage_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.col("s"))))
    return clipped.withColumn("new", new).groupBy("qid", "passage_id").agg((F.sum("new") / F.first(F.col("p_end") - F.col("p_start"))).alias("coverage"))


def _merged(spans: Column) -> Column:
    """Length of a union of intervals, as structs that begin with s and e."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    longer = lambda a, x: F.struct((a["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).cast("long").alias("total"), F.greatest(a["reach"], x["e"].cast("long")).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, longer)["total"]


def query_metrics(chunks: DataFrame, passages: DataFrame, threshold: float = 0.5, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """A row a query that has passages: recall, passage_coverage and boundary_completeness at each cut, mrr,
    precision_at_5, irrelevant_at_5, ndcg_at_10.

    One pass: passages meet their hits once, a query's few hits are held in an array, and all cuts are read off it."""
    if not 0 < threshold <= 1:
        raise ValueError("relevance_threshold must be above 0 and at most 1")
    p = passages.select("qid", "source_id", "passage_id", F.col("char_start").alias("p_start"), F.col("char_end").alias("p_end"))
    met = p.join(chunks.select("qid", "source_id", "rank", "char_start", "char_end"), ["qid", "source_id"], "left")
    size = F.col("p_end") - F.col("p_start")
    common = overlap(F.col("char_start"), F.col("char_end"), F.col("p_start"), F.col("p_end"))
    hit = F.struct(F.greatest("char_start", "p_start").alias("s"), F.least("char_end", "p_end").alias("e"), "rank", (common / size).alias("coverage"), ((F.col("char_start") <= F.col("p_start")) & (F.col("char_end") >= F.col("p_end"))).alias("whole"))
    each = met.groupBy("qid", "passage_id").agg(F.first(size).alias("size"), F.collect_list(F.when(F.col("rank").isNotNull(), hit)).alias("hits"))
    first = lambda k, more: F.filter("hits", lambda x: (x["rank"] <= k) & more(x))
    found = lambda k: F.size(first(k, lambda x: x["coverage"] >= threshold)) > 0
    whole = lambda k: F.size(first(k, lambda x: x["whole"])) > 0
    cover = lambda k: _merged(first(k, lambda x: x["e"] > x["s"])) / F.col("size")
    flags = [x for k in cuts for x in (F.avg(found(k).cast("double")).alias(f"recall_at_{k}"), F.avg(cover(k)).alias(f"passage_coverage_at_{k}"), F.avg(whole(k).cast("double")).alias(f"boundary_completeness_at_{k}"))]
    graded = F.flatten(F.collect_list(F.transform("hits", lambda x: F.struct(x["rank"].alias("rank"), x["coverage"].alias("coverage")))))
    rows = each.groupBy("qid").agg(*flags, F.count("*").alias("passages"), graded.alias("all"))
    best = lambda r: F.array_max(F.transform(F.filter("all", lambda x: x["rank"] == r), lambda x: x["coverage"]))
    ranks = F.array_distinct(F.transform("all", lambda x: x["rank"]))
    rows = rows.withColumn("grades", F.transform(ranks, lambda r: F.struct(r.alias("rank"), best(r).alias("grade"))))
    relevant = F.transform(F.filter("grades", lambda g: g["grade"] >= threshold), lambda g: g["rank"])
    in_five = F.size(F.filter(relevant, lambda r: r <= 5))
    gain = lambda g: F.when(g["rank"] <= 10, (F.pow(F.lit(2.0), g["grade"]) - 1) / F.log2(g["rank"] + F.lit(1))).otherwise(0.0)
    dcg = F.aggregate(F.transform(F.array_sort("grades"), gain), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("passages"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    names = [f"{m}_at_{k}" for k in cuts for m in ("recall", "passage_coverage", "boundary_completeness")]
    return rows.select("qid", *names, F.coalesce(1 / F.array_min(relevant), F.lit(0.0)).alias("mrr"), (in_five / 5).alias("precision_at_5"), (5 - in_five).cast("double").alias("irrelevant_at_5"), F.least(F.lit(1.0), dcg / ideal).alias("ndcg_at_10"))


def latency(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99), digits: int = 6) -> DataFrame:
    """Count, mean and interpolated percentiles, by ranks: no task holds a group."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"))
    return with_percentiles(counts, df, by, {value: F.col(value)}, {f"p{round(p * 100)}": (value, p) for p in points}, digits)


def macro_average(metrics: DataFrame) -> DataFrame:
    """The mean of each metric over queries, 0 without queries."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in metrics.columns if c != "qid"])


def throughput(df: DataFrame, latency_ms: str) -> DataFrame:
    """A27."""
    return df.agg(F.coalesce(F.try_divide(F.count("*").cast("double"), F.sum(latency_ms) / 1000), F.lit(0.0)).alias("queries_per_second"))


def stability(runs: DataFrame) -> DataFrame:
    """Per query, whether all repetitions ranked the same ids alike. runs: qid, repetition, rank, chunk_id."""
    lists = runs.groupBy("qid", "repetition").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return lists.groupBy("qid").agg((F.count_distinct("ids") == 1).alias("stable"))


def mismatches(measured: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """How many measured rows differ from the truth of their key; rows without truth don't count."""
    met = measured.join(truth.select(key, F.col(value).alias("_true")), key)
    return met.agg(F.count_if(~F.col(value).eqNullSafe(F.col("_true"))).alias("stale"), F.count("*").alias("compared"))


def cache_summary(log: DataFrame, by: list[str], ok: Column, hit: Column, latency_ms: str, embedding_hit: Column | None = None) -> DataFrame:
    """Requests, successes, hit rates and p95 latency of the three states of the caches: fully warm (the result was
    cached), embedding warm (only the query's vector was) and cold. Without ``embedding_hit`` there are two states."""
    ms = F.col(latency_ms)
    half = F.lit(False) if embedding_hit is None else embedding_hit & ~hit
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(ok & c), F.count_if(ok)), F.lit(0.0)), 6)
    counts = log.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(ok).alias("successes"), rate(hit).alias("hit_rate"), rate(hit | half).alias("embedding_hit_rate"))
    states = {"warm": F.when(ok & hit, ms), "embedding": F.when(ok & half, ms), "cold": F.when(ok & ~hit & ~half, ms)}
    found = with_percentiles(counts, log, by, states, {f"{name}_p95": (name, 0.95) for name in states}, 3)
    return found if embedding_hit is not None else found.drop("embedding_hit_rate", "embedding_p95")


def profile_medians(runs: DataFrame, measures: list[str], totals: tuple[str, ...] = ("requests", "errors")) -> DataFrame:
    """(mode, repeat_rate) with the number of runs, sums of totals and the median of each measure, nulls left out."""
    by = ["mode", "repeat_rate"]
    counts = runs.groupBy(*by).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in totals])
    return with_percentiles(counts, runs, by, {c: F.col(c) for c in measures}, {c: (c, 0.5) for c in measures}, 3)


def check_control(baseline: DataFrame, candidate: DataFrame, fields: list[str] | None = None) -> None:
    """An error naming the control fields in which two one-row runs differ."""
    a, b = baseline.first(), candidate.first()
    wrong = [f for f in fields or CONTROL if a[f] != b[f]]
    if wrong:
        raise ValueError(f"runs differ in control fields: {', '.join(wrong)}")


#: Fields of a run's summary that say how it was made, not how good it is.
NOT_COMPARED = ("queries", "repetitions", "top_k")


def compare_runs(baseline: DataFrame, candidate: DataFrame, less_is_better: tuple[str, ...] = LESS_IS_BETTER, not_compared: tuple[str, ...] = NOT_COMPARED) -> DataFrame:
    """(metric, baseline, candidate, delta, relative_percent, improved) over shared metrics; frames of (metric, value)."""
    met = baseline.select("metric", F.col("value").alias("baseline")).join(candidate.select("metric", F.col("value").alias("candidate")), "metric").where(~F.col("metric").isin(*not_compared))
    delta = F.col("candidate") - F.col("baseline")
    better = F.when(F.col("metric").isin(*less_is_better), delta < 0).otherwise(delta > 0)
    return met.select("metric", "baseline", "candidate", delta.alias("delta"), F.try_divide(delta * 100, F.abs("baseline")).alias("relative_percent"), better.alias("improved"))


def check_same_queries(baseline: DataFrame, candidate: DataFrame, key: str = "qid") -> None:
    """An error where two runs don't hold the same queries."""
    a, b = baseline.select(key).distinct(), candidate.select(key).distinct()
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError("runs must hold the same queries")


def _states(batches: Iterator[pd.DataFrame], samples: int, seed: int, at_once: int) -> Iterator[pd.DataFrame]:
    """The state of the generator before each slice of resamples: the stream is run through once, nothing is summed."""
    for batch in batches:
        for n in batch["n"]:
            rng = random.Random(seed)
            for first in range(0, samples, at_once):
                yield pd.DataFrame({"first": [first], "n": [n], "state": [pickle.dumps(rng.getstate())]})
                for _ in range(min(at_once, samples - first) * n):
                    rng.randrange(n)


def _picks(batches: Iterator[pd.DataFrame], samples: int, at_once: int) -> Iterator[pd.DataFrame]:
    """(sample, place, times) of the resamples of each slice."""
    rng = random.Random()
    for batch in batches:
        for first, n, state in zip(batch["first"], batch["n"], batch["state"], strict=True):
            rng.setstate(pickle.loads(state))
            parts = []
            for sample in range(first, min(first + at_once, samples)):
                places, times = np.unique([rng.randrange(n) for _ in range(n)], return_counts=True)
                parts.append((np.full(len(places), sample), places, times))
                if len(parts) * n >= ROWS_AT_ONCE or sample + 1 == min(first + at_once, samples):
                    yield pd.DataFrame(dict(zip(("sample", "place", "times"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts = []


def seeded_draws(queries: DataFrame, samples: int, seed: int) -> DataFrame:
    """(sample, place, times): how often each of ``samples`` resamples of n rows draws each place; queries: one row with n.

    The draws are those of one seeded generator, as if made one after another; slices of resamples are drawn in tasks."""
    states = written(queries.mapInPandas(partial(_states, samples=samples, seed=seed, at_once=RESAMPLES_AT_ONCE), "first long, n long, state binary"), "states")
    slices = -(-samples // RESAMPLES_AT_ONCE)
    return states.repartition(slices, "first").mapInPandas(partial(_picks, samples=samples, at_once=RESAMPLES_AT_ONCE), "sample long, place long, times long")


def resampled_interval(pairs: DataFrame, draws: DataFrame, reduction: bool = False) -> DataFrame:
    """(lower, upper) of the 95 % interval of the relative change of the mean in percent (its fall, for ``reduction``).

    pairs: place, a, b; draws: sample, place, times. A resample whose baseline is 0 counts as no change."""
    sums = draws.join(pairs, "place").groupBy("sample").agg(F.sum(F.col("times") * F.col("a")).alias("x"), F.sum(F.col("times") * F.col("b")).alias("y"))
    change = (F.col("x") - F.col("y")) if reduction else (F.col("y") - F.col("x"))
    effects = sums.select(F.when(F.col("x") != 0, change / F.col("x") * 100).otherwise(0.0).alias("effect"))
    ordered = effects.agg(F.array_sort(F.collect_list("effect")).alias("e"), F.count("*").alias("n"))  # one number a sample
    return ordered.select(F.get("e", F.floor(0.025 * (F.col("n") - 1)).cast("int")).alias("lower"), F.get("e", F.ceil(0.975 * (F.col("n") - 1)).cast("int")).alias("upper"))


def paired_rows(baseline: DataFrame, candidate: DataFrame, value: str) -> DataFrame:
    """(qid, a, b, place, n): both runs' values by query in the order of qid; an error where they don't hold the same queries."""
    met = written(baseline.select("qid", F.col(value).alias("a")).join(candidate.select("qid", F.col(value).alias("b")), "qid", "full"), "paired")
    if met.isEmpty() or not met.where("a is null or b is null").isEmpty():
        raise ValueError("runs must hold the same queries")
    rows = met.select(F.lit(0).alias("all"), "qid", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return in_place(rows, "all", ["qid"]).drop("all")


def paired_bootstrap(baseline: DataFrame, candidate: DataFrame, value: str, samples: int = 10_000, seed: int = 42, reduction: bool = False) -> DataFrame:
    """(lower, upper) of the 95 % interval of the relative change of the mean over resampled queries, by seeded draws.

    Both frames hold (qid, value) of the same queries, else an error. Values meet draws by place and are summed by resample."""
    pairs = paired_rows(baseline, candidate, value)
    return resampled_interval(pairs.select("place", "a", "b"), seeded_draws(pairs.agg(F.count("*").alias("n")), samples, seed), reduction)


def corpus_totals(documents: DataFrame, stable: DataFrame) -> DataFrame:
    """Documents, sums of their chunk_count and token_count, and the number of queries whose ranking isn't stable."""
    counts = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return counts.crossJoin(F.broadcast(stable.agg(F.count_if(~F.col("stable")).alias("unstable_rankings"))))  # a row each
