"""Blocks of vectors against scores pair by pair: ties, copies, odd vectors, more than one block, more queries than are broadcast."""

import random

import pytest
from pyspark.sql import functions as F
from quillgrid.operators import exact, retrieval

SCHEMA = "id long, v array<float>"


def best(scored, k):
    rows = retrieval.top_k(scored.withColumn("score", F.round("score", 9)), k, "id").collect()
    return sorted((r.qid, r["rank"], r.id, r.score) for r in rows)


@pytest.mark.parametrize("few", [True, False])
def test_best_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(exact, "VALUES", 120)
    monkeypatch.setattr(exact, "ASKED", 7)
    if not few:
        monkeypatch.setattr(retrieval, "is_small", lambda df: False)
    draw = random.Random(3)
    some = [[draw.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    rows = [(i, some[i % 60] if i % 4 else some[0]) for i in range(300)]
    rows += [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 0.0]), (903, [1.0, 2.0]), (904, [-1.0, 0.0, 0.0]), (905, [])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    asked = vectors.where("id % 20 = 0 or id > 899").select(F.col("id").alias("qid"), F.col("v").alias("vector"))
    for k in (1, 12, 400):
        assert best(retrieval.nearest(vectors, asked, "id", "v", k), k) == best(retrieval.vector_scores(vectors, asked, "id", "v"), k)


def test_copies_hand_on_no_more_than_k_a_block(spark):
    vectors = spark.range(2000).select("id", F.lit([1.0, 2.0]).cast("array<float>").alias("v"))
    asked = vectors.where("id < 3").select(F.col("id").alias("qid"), F.col("v").alias("vector"))
    assert retrieval.nearest(vectors, asked, "id", "v", 5).count() == 15


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert retrieval.nearest(none, none.select(F.col("id").alias("qid"), F.col("v").alias("vector")), "id", "v", 3).collect() == []
