"""Percentiles and places by ranges, resamples in slices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgrid.operators import evaluation, ranks


def test_percentiles_of_groups_with_ties_nulls_and_one_value(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(40))) for _ in range(3000)] + [("few", 3.0), ("few", 1.0), ("one", 7.0), ("none", None), (None, 2.0), (None, 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {(r.g, r.name, r.point): r.value for r in ranks.percentiles(df, ["g"], {"v": F.col("v"), "w": -F.col("v")}, (0.0, 0.5, 0.95, 1.0)).collect()}
    for g in ("hot", "few", "one", None):
        own = [v for k, v in rows if k == g and v is not None]
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[g, "v", p] == pytest.approx(np.percentile(own, 100 * p)) and got[g, "w", p] == pytest.approx(np.percentile([-v for v in own], 100 * p))
    assert len(got) == 4 * 2 * 4
    summary = evaluation.latency(df, "v", ["g"], digits=3)
    assert {r.g: (r.n, r.p50) for r in summary.collect()}["none"] == (0, None) and summary.count() == 5
    assert ranks.percentiles(df.limit(0), ["g"], {"v": F.col("v")}, (0.5,)).collect() == []


def test_one_group_of_ten_million_values(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit("all").alias("g"), F.pmod(F.col("id") * 7_654_321, F.lit(n)).cast("double").alias("v"))
    found = evaluation.latency(rows, "v", ["g"]).first()
    assert (found.n, found.p50, found.p95, found.p99) == pytest.approx((n, (n - 1) * 0.5, (n - 1) * 0.95, (n - 1) * 0.99), rel=1e-12)


def test_places(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", 9), ("a", 2), (None, 4)], "g string, v int").repartition(4)
    assert sorted((r.g or "", r.v, r.place, r.n) for r in ranks.in_place(rows, "g", ["v"]).collect()) == [("", 4, 0, 2), ("", 5, 1, 2), ("a", 1, 0, 3), ("a", 2, 1, 3), ("a", 3, 2, 3), ("b", 9, 0, 1)]


def test_resamples_are_those_of_one_generator(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RESAMPLES_AT_ONCE", 7)  # many slices
    rng = random.Random(3)
    a, b = [rng.random() for _ in range(11)], [rng.random() for _ in range(11)]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "qid long, v double")
    got = evaluation.paired_bootstrap(frame(a), frame(b), "v", samples=60, seed=5).first()
    draws, effects = random.Random(5), []
    for _ in range(60):
        picks = [draws.randrange(11) for _ in range(11)]
        x, y = sum(a[i] for i in picks), sum(b[i] for i in picks)
        effects.append((y - x) / x * 100)
    effects.sort()
    assert tuple(got) == pytest.approx((effects[math.floor(0.025 * 59)], effects[math.ceil(0.975 * 59)]))
    drawn = evaluation.seeded_draws(spark.createDataFrame([(11,)], "n long"), 60, 5)
    assert drawn.rdd.getNumPartitions() > 1 and drawn.groupBy("sample").agg(F.sum("times").alias("n")).where("n <> 11").isEmpty()


def test_three_states_of_the_caches(spark):
    log = spark.createDataFrame([(1, True, True, True, 1.0), (1, True, False, True, 5.0), (1, True, False, False, 9.0), (1, False, False, False, 99.0), (2, True, False, True, 4.0)], "m int, ok boolean, result boolean, vector boolean, ms double")
    rows = {r.m: r.asDict() for r in evaluation.cache_summary(log, ["m"], F.col("ok"), F.col("result"), "ms", F.col("vector")).collect()}
    assert rows[1] == {"m": 1, "requests": 4, "successes": 3, "hit_rate": 0.333333, "embedding_hit_rate": 0.666667, "warm_p95": 1.0, "embedding_p95": 5.0, "cold_p95": 9.0}
    assert rows[2]["warm_p95"] is None and rows[2]["embedding_p95"] == 4.0
