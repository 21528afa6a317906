"""Toxicity and quality: held-out accuracy, the folded machine, odd rows."""

import zlib

import duckdb
import numpy as np
import pytest
from quillgrid.llm import cotraining, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql(f"SELECT doc_id, text, toxic, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY 1").fetchall()


def kernel(a, b):
    """The kernel of two words straight from its definition."""
    def features(word):
        letters = toxicity.codes([word], len(word))[0].tolist()
        out, norm = {}, 0.0
        for i in range(len(letters)):
            for k in range(i + 2, min(len(letters), i + toxicity.MAX_GAP + 3)):
                for j in range(i + 1, k):
                    w = toxicity.DECAY ** (k - i - 2)
                    key = (letters[i], letters[j], letters[k])
                    out[key] = out.get(key, 0) + w
                    norm += w * w
        return out, norm**0.5

    (fa, na), (fb, nb) = features(a), features(b)
    return sum(v * fb.get(k, 0) for k, v in fa.items()) / (na * nb)


def test_kernel_and_folded_machine():
    marks, words = ["idiot", "clown", "überaus"], ["idioot", "dolt", "clowns", "ü", "überall"]
    basis = toxicity.Landmarks.of(marks)
    values = basis.kernel(words)
    assert np.allclose(values, [[kernel(w, m) for m in marks] for w in words], atol=1e-5)
    alpha = np.array([0.5, -2.0, 1.0])
    machine = toxicity.Machine(basis.fold(alpha), 0.25)
    assert np.allclose(machine.values(words), values @ alpha + 0.25, atol=1e-5)
    assert np.isfinite(machine.values(["", "x" * 5000])).all()


def test_toxicity_held_out(spark, labelled):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].score, t) for i, _, t, _ in labelled if rows[i].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.75
    assert np.mean([s < 0.3 for s in good]) > 0.9


def test_insults_with_letters_put_in(labelled):
    train = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    machine = toxicity.train([r[1] for r in train], [r[2] for r in train])
    clean = machine.scores(["then the onion erand that", None, "", "  "])
    for said in ("you idiot", "you i-d-i-o-t", "you idioot", "you i d i o t", "you m.o.r.o.n"):
        assert machine.scores([said])[0] > clean.max()


def test_toxicity_of_odd_rows_and_without_labels(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(0, 1), (8, 0), (11, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    same = toxicity.toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert same.select("score").distinct().count() == 1
    assert toxicity.toxicity(none, labels).count() == 0


def test_quality_held_out(spark, labelled):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = labels.where("doc_id % 3 <> 0")
    rows = {r.doc_id: r for r in cotraining.quality(docs, part).select("doc_id", "quality_score", "quality_keep").collect()}
    held = [(rows[i].quality_keep, q) for i, _, _, q in labelled if i % 3 == 0]
    assert np.mean([k for k, q in held if q]) > 0.97 and np.mean([not k for k, q in held if not q]) > 0.8


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(0, 1), (8, 1), (11, 0), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = cotraining.quality(odd, labels)
    assert rows.count() == len(odd_rows) and rows.where("quality_score is null or not quality_score between 0 and 1").count() == 0
    assert rows.groupBy("text", "lang", "source").agg({"quality_score": "min", "*": "count"}).count() > 0
    assert cotraining.quality(odd, labels.limit(0)).where("quality_keep").count() == len(odd_rows)
    assert cotraining.quality(none, labels).count() == 0


def test_views_hand_labels_over():
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 10)
    make = lambda t, k: (t[:, None] * 2 - 1) * np.ones(k) + rng.normal(0, 0.7, (len(t), k))
    hidden = rng.integers(0, 2, 400)
    models = cotraining.cotrain(make(y, 4), make(y, 3), y, make(hidden, 4), make(hidden, 3))
    test = rng.integers(0, 2, 500)
    for model, k in zip(models, (4, 3), strict=True):
        assert np.mean((model.logit(make(test, k)) > 0) == test) > 0.9
    assert cotraining.cotrain(make(y, 4), make(y, 3), np.ones(20), make(hidden, 4), make(hidden, 3)) is None


def test_toxicity_ranks_held_out_documents(spark):
    """AUC over the held-out quarter of a larger table; no word has a score but by the machine."""
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).where("held_out").select("doc_id", "score").collect()}
    known = duckdb.sql(f"SELECT doc_id, toxic FROM '{where}/labels.parquet' WHERE toxic IS NOT NULL").fetchall()
    bad, good = [found[i] for i, t in known if t and i in found], [found[i] for i, t in known if not t and i in found]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= 0.95
    assert np.mean([g < 0.3 for g in good]) > 0.97 and np.mean([b >= 0.3 for b in bad]) > 0.85


def test_a_words_value_is_its_kernel_sum(labelled):
    """The trained machine has no values of its own for known words."""
    train = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 4 != 2][:150]
    machine = toxicity.train([r[1] for r in train], [r[2] for r in train])
    words = sorted({w for r in train[:40] for w in r[1].lower().split() if w.isalpha() and len(w) < 20})[:200]
    index, weight = toxicity.subsequences(words, max(map(len, words)))
    assert np.allclose(machine.values(words), (machine.weights[index] * weight).sum(axis=1) + machine.bias, atol=1e-4)
    assert np.allclose([machine.largest([w])[0] for w in words[:50]], machine.values(words[:50]))


def test_samples_have_one_row_an_id(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i % 3} of", "en", "s", 9) for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, None, None)], "doc_id long, toxic int, quality int")
    assert len(toxicity.training_rows(docs, labels)[0]) <= 2
    rows, others, share = cotraining._sample(docs, labels, 10, 10)
    assert len(rows) == 2 and len(others) == 1 and share == 0.5
    long = spark.createDataFrame([(0, "x " * toxicity.TRAIN_CHARS), (1, "ok")], "doc_id long, text string")
    assert all(len(r["_text"]) <= toxicity.TRAIN_CHARS for r in toxicity.training_rows(long, labels)[0])


def test_views_share_no_feature_and_mostly_agree(spark, labelled):
    content, metadata = cotraining.views("some plain words\nin two lines", 30, "en", "s1")
    same, other = cotraining.views("xxxx yyyyy zzzzz\nqq rrr sssss", 30, "en", "s1")
    assert np.array_equal(metadata, other) and not np.array_equal(content, same)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = cotraining.quality(docs, labels).selectExpr("avg(if((content_score >= 0.5) = (metadata_score >= 0.5), 1, 0)) agree").first()
    assert scored.agree > 0.8


def test_quality_keeps_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(0, 1), (8, 1), (11, 0), (6, 0)], "doc_id long, quality int")
    found = cotraining.quality(odd, labels)
    assert found.columns == [c for c in odd.columns if c not in cotraining.SCORES] + list(cotraining.SCORES)
    assert {(r._logits, r.r, r.z) for r in found.collect()} == {(0.1, 2, "z")}
