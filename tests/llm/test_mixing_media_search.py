"""Mixing, media columns and nearest neighbours against brute force, round trips and their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgrid.llm import ann, media, mixing


def test_targets_share_the_excess():
    sizes = {"b": 100, "a": 10, None: 50, "c": 1000, "d": 0}
    found = mixing.targets(sizes)
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    assert sum(found.values()) == pytest.approx(1.5 * 1160) and all(found[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    free = [s for s in sizes if found[s] < 2 * sizes[s] - 1e-6]
    assert len({round(found[s] / weight[s], 6) for s in free}) == 1
    assert mixing.targets({}) == {}


def plan_of(df):
    return mixing.mix(df).collect()


def test_mix_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = plan_of(docs)
    sizes = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    total, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", sizes[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        total[r.source] += r["size"]
        taken[r.source] += r.taken
    wanted = mixing.targets(dict(total))
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(wanted[r.source])
    for s in total:
        assert abs(taken[s] - wanted[s]) <= max(25, 0.02 * wanted[s])
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in plan_of(docs.repartition(5)))


def test_rates_solve_the_dual(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 200)), rng.choice("pqr")) for i in range(500)]
    found = plan_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(own[0].target, rel=1e-4)
        # inside the bounds log rate is proportional to size: the exponential tilt
        slopes = [math.log(r.rate) / r["size"] for r in own if 1e-6 < r.rate < 2 - 1e-9 and r["size"] > 5]
        assert not slopes or max(slopes) - min(slopes) < 1e-9


def test_mix_of_odd_rows(odd, odd_rows, none):
    rows = plan_of(odd)
    assert len(rows) == len(odd_rows) and all(r.taken <= 2 * r["size"] for r in rows) and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert len({r.taken for r in rows if r.doc_id == 11 and r["size"]}) == 1  # repeated rows decide alike
    again = mixing.repeat_rows(odd)
    assert again.columns == odd.columns and again.count() == sum(r.copies for r in rows)
    assert plan_of(none) == [] and mixing.repeat_rows(none).count() == 0


def test_png_round_trip_and_refusals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40):
        payload = rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
        stored = media.png_encode(payload)
        assert media.png_decode(stored) == payload
        with pytest.raises(ValueError):
            media.png_decode(stored[:-20] + bytes([stored[-20] ^ 1]) + stored[-19:])
    with pytest.raises(ValueError):
        media.png_encode(b"abc")


def test_parts_stay_in_order_with_their_captions():
    page = '<html><head><style>x{}</style></head><body><p>One &amp; two<img src="sha256:aa" alt="first">three</p><figure><img data-digest="bb" alt="no"><figcaption>The <b>second</b></figcaption></figure>end</body></html>'
    assert media.parse_parts(page) == [(0, "text", "One & two", None, None), (1, "media", None, "aa", "first"), (2, "text", "three", None, None), (3, "media", None, "bb", "The second"), (4, "text", "end", None, None)]
    assert media.parse_parts(None) == [] and media.parse_parts("<p") == media.parse_parts("<p")


def test_resolve_keeps_references_without_media(spark):
    pages = spark.createDataFrame([(1, '<img src="aa"><p>t</p><img src="zz" alt="c">'), (2, None), (3, '<img src="aa">')], "id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, w int")
    found = sorted((r.key, r.position, r.digest, r.caption, r.w) for r in media.resolve(media.interleave(pages, "id", "html"), store).collect())
    assert found == [(1, 0, "aa", None, 7), (1, 2, "zz", "c", None), (3, 0, "aa", None, 7)]


def check_media(rows, texts):
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        stored = media.png_encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))


def test_documents_as_media(spark, sf, odd, odd_rows, none):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = media.documents_as_media(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(rows) == len(texts)
    check_media(rows, texts)
    found = media.documents_as_media(odd).collect()
    assert len(found) == len(odd_rows)
    check_media([r for r in found if r.doc_id not in (None, 11)], {r[0]: r[1] for r in odd_rows})
    assert media.documents_as_media(none).count() == 0


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(ids[i], scores[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vectors = np.float32(centres[rng.integers(0, 12, 3000)] * 0.6 + rng.normal(size=(3000, 24)))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = defaultdict(dict)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    wanted = exact(list(range(3000)), vectors.astype(float), range(0, 3000, 20), 20)
    assert found.keys() == wanted.keys()
    hits = 0
    for q, best in wanted.items():
        got = [found[q][rank] for rank in range(1, 21)]
        assert all(math.isclose(s, float(vectors[v].astype(float) @ vectors[q].astype(float)), rel_tol=1e-12) for v, s in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in got} & {v for v, _ in best})
    assert hits / (20 * len(wanted)) >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (20, [0.5, 0.5]), (40, None), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (60, [1.0, 1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, shard string")
    found = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (60, 1, 9, 4.5)]  # 9 and 60 have another length, and meet each other only
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(100)], "vec_id long, embedding array<double>")
    ties = ann.nearest(same, F.col("vec_id") % 20 == 0)
    assert [r.vec_id for r in ties.where("query_id = 20").orderBy("rank").collect()] == list(range(20))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, size):
    path = f"/root/testdata/{size}/embeddings.parquet"
    ids, vectors = zip(*duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{path}' ORDER BY 1").fetchall(), strict=True)
    found = defaultdict(set)
    for r in ann.nearest(spark.read.parquet(path), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    wanted = exact(list(ids), np.array(vectors), [i for i in ids if i % 20 == 0], 20)
    assert found.keys() == wanted.keys() and all(len(v) == 20 for v in found.values())
    assert sum(len(found[q] & {v for v, _ in best}) for q, best in wanted.items()) / (20 * len(wanted)) >= 0.9


def test_few_are_verified():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(8000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    shard, ids = ann.Shard(np.arange(8000), vectors, 20), np.arange(40)
    found = shard.search(ids, vectors[:40], 20)
    assert np.mean([n for _, _, n in found]) / 8000 < 0.15
    hits = [len(set(v.tolist()) & {i for i in np.argsort(-(vectors @ vectors[q]), kind="stable")[:21].tolist() if i != q}) for q, (v, _, _) in enumerate(found)]
    assert np.mean(hits) >= 0.85 * 20


def test_mix_plan_of_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{rng.randrange(40)}") for i in range(3000)]
    found = plan_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken, target = defaultdict(int), {r.source: r.target for r in found}
    for r in found:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
