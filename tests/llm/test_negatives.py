"""Hard negatives against all pairs in plain Python, and the pruning of buckets."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgrid.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>, row int, size int, norm string, vector int, run int, score int, `window` int"


def brute(rows, picks, scale=256, positives=5, negatives=3, low=50, high=95):
    rows = {(i, c, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, c, v in rows:
        if not picks(i):
            continue
        others = [(sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in rows if j != i and len(w) == len(v)]
        for ps, p in sorted(((s, j) for s, j, d in others if d == c), key=lambda x: (-x[0], x[1]))[:positives]:
            fit = sorted(((s, j) for s, j, d in others if d != c and low * ps <= 100 * s <= high * ps), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(i, p, r, j, ps, s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, cond):
    return sorted(tuple(r) for r in negatives.mine(df, cond).collect())


def test_query_equals_all_pairs_and_its_sql(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    found = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect())
    assert found and found == brute(rows, lambda i: i % 50 == 0)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in con.sql(queries.oracle_sql()["op11_hard_negatives"]).fetchall()) == found


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0, 3.0]) for _ in range(4)]) for i in range(120)]  # many ties
    rows += [(200 + i, 1, [rng.random() for _ in range(2)]) for i in range(9)] + [(300 + i, 2, [rng.random() for _ in range(2)]) for i in range(9)]
    rows += [(400, 1, [0.0] * 4), (410, 1, []), (411, 1, []), (412, 2, []), (None, 1, [1.0] * 4), (420, None, [1.0] * 4), (430, 1, None), (440, 1, [1.0, None, 1.0, 1.0]), (450, 1, [1.0, math.nan, 1.0, 1.0]), (460, 1, [1.0, math.inf, 1.0, 1.0]), (470, 2, [70000.5] * 4), (480, 1, [-9.0] * 4), (20, 0, [2.0] * 4)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)
    assert mined(df, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)
    assert mined(df, F.lit(False)) == [] and mined(df.limit(0), F.lit(True)) == []


def test_small_buckets_lanes_and_blocks(spark, monkeypatch):
    for name, value in (("BUCKET", 8), ("LANE", 16), ("BLOCK", 4), ("GROUP", 2), ("SLICE", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(4), [rng.gauss(0.3, 1) * (1 + i % 5) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert mined(df, F.col("vec_id") % 9 == 0) == brute(rows, lambda i: i % 9 == 0)


def test_too_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too long"):
        mined(df, F.lit(True))


def _pack(number, rows, windows=None):
    ids = np.array([[r[0] for r in rows]] * 2, "<i8")
    vectors = np.array([r[1] for r in rows], "<f4")
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    return {"number": number, "size": vectors.shape[1], "rows": len(rows), "width": 4, "top": norms.max(), "ids": ids.tobytes(), "norms": norms.tobytes(), "vectors": vectors.tobytes(), "windows": None if windows is None else np.array(windows, "<i8").tobytes()}


def test_buckets_below_the_lower_limit_are_not_scored():
    buckets = [_pack(n, [(100 * (n + 1) + j, [float(20 - 5 * n), float(j) / 4]) for j in range(2)]) for n in range(4)]
    block, seen = _pack(0, [(1, [10.0, 0.0])], [[[120]], [[1000]]]), []
    _, _, ids, scores = negatives.search_block(block, buckets, 3, seen)
    assert seen == [0, 1] and sorted(zip(ids, scores, strict=True)) == [(100, 200), (101, 200), (200, 150)]


def test_the_running_score_closes_buckets():
    buckets = [_pack(n, [(100 * (n + 1) + j, [float(20 - 5 * n), float(j) / 4]) for j in range(4)]) for n in range(4)]
    block, seen = _pack(0, [(1, [10.0, 0.0])], [[[1]], [[1000]]]), []
    _, _, ids, scores = negatives.search_block(block, buckets, 3, seen)
    assert seen == [0] and sorted(ids) == [100, 101, 102] and set(scores) == {200}
    low = _pack(0, [(1, [10.0, 0.0])], [[[1]], [[160]]])
    seen.clear()
    _, _, ids, scores = negatives.search_block(low, buckets, 3, seen)
    assert seen == [0, 1] and set(scores) == {150}
    by = defaultdict(list)
    for i, s in zip(ids, scores, strict=True):
        by[s].append(i)
    assert by == {150: [200, 201, 202]}
