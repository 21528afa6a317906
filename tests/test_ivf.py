import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgrid.operators import ivf, retrieval
from quillgrid.plans import catalog


def exact(rows: dict, asked: dict, k: int) -> dict:
    out = {}
    for q, a in asked.items():
        scores = {i: round(float(np.dot(a, v) / np.sqrt(np.dot(a, a) * np.dot(v, v))), 9) for i, v in rows.items()}
        out[q] = sorted(scores, key=lambda i: (-scores[i], str(i)))[:k]
    return out


def test_all_lists_give_the_exact_answer(spark):
    draw = np.random.default_rng(3)
    rows = {i: draw.normal(size=6) for i in range(300)}
    rows |= {i: rows[7] for i in range(300, 500)}  # copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, v array<double>")
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, []), (904, [None] * 6)], "id long, v array<double>")
    made = ivf.write_ivf(table.unionByName(odd).withColumn("list", F.lit(1)), "id", "v", lists=9)
    asked = {i: rows[i] for i in range(0, 500, 50)}
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()] + [(999, None), (998, [0.0] * 6), (997, [1.0])], "qid long, vector array<double>")
    found = {}
    for r in sorted(ivf.search(made, queries, 12, 50).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.qid, []).append(r.id)
    assert found == exact(rows, asked, 12)
    assert ivf.share_read(made, queries.where("qid < 900"), 50) == 1
    assert ivf.search(ivf.write_ivf(table.limit(0), "id", "v"), queries, 3, 2).count() == 0
    with pytest.raises(ValueError):
        ivf.write_ivf(table.unionByName(spark.createDataFrame([(1, [1.0])], "id long, v array<double>")), "id", "v")


def test_recall_of_the_registered_search(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.queries()["vector_topk_ivf"](spark, sf).select("qid", "doc_id").collect()
    wanted = catalog.vector_ranked(spark, sf, 10).select("qid", "doc_id").collect()
    assert len(found) == len(wanted) and len(set(found) & set(wanted)) >= 0.9 * len(wanted)


def test_clustered_vectors_need_few_lists(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16))
    rows = {i: centres[i % 40] + 0.05 * draw.normal(size=16) for i in range(4000)}
    made = ivf.write_ivf(spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, v array<double>"), "id", "v", lists=40)
    needed = ivf.probes(made)
    asked = {i: rows[i] for i in range(0, 4000, 100)}
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "qid long, vector array<double>")
    wanted = {(q, i) for q, near in exact(rows, asked, 10).items() for i in near}
    found = {(r.qid, r.id) for r in ivf.search(made, queries, 10, needed).collect()}
    assert len(found & wanted) >= 0.9 * len(wanted) and ivf.share_read(made, queries, needed) < 0.2
