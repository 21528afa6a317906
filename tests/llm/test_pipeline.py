"""The pipeline stage by stage against brute force on the smallest documents."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from quillgrid.llm import linededup, mixing
from test_copies import plain_near
from test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage returned, written and read again, as the driver does it."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_documents_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    for docs in stages[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_documents(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert all(after[i] == before[i] for i in after)
    assert sum(i in after for i, q in labels.items() if q) >= 0.97 * sum(labels.values())


def test_lines_are_those_of_an_earlier_document(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert before.keys() == after.keys()
    held = defaultdict(set)
    for i, r in before.items():
        for line in r.text.split("\n"):
            held[line].add(i)
    for i, r in before.items():
        gone = Counter(r.text.split("\n")) - Counter(after[i].text.split("\n"))
        assert all(min(held[line]) < i for line in gone)
    assert linededup.MIN_BLOCK_WORDS == 5


def test_one_of_each_group_stays(stages):
    near = plain_near([(r.doc_id, r.text) for r in stages[2].collect()])
    assert sorted(rows(stages[3])) == sorted({c for _, _, c in near})


def test_mix_repeats_documents(stages):
    before, after = rows(stages[3]), stages[4].collect()
    copies = Counter(r.doc_id for r in after)
    assert set(copies) <= set(before) and set(copies.values()) <= {1, 2}
    plan = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert copies == Counter({i: n for i, n in plan.items() if n})


def test_packing_holds_every_copy(stages):
    texts, copies = {r.doc_id: r.text for r in stages[4].collect()}, Counter(r.doc_id for r in stages[4].collect())
    packed, once, seen = stages[5].collect(), [], Counter()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    offsets = defaultdict(list)
    for r in packed:
        offsets[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id, r.piece] += 1
        if seen[r.doc_id, r.piece] == 1:
            once.append(r.asDict() | {"sequence_id": len(once), "offset": 0})
    for own in offsets.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    check_packing([type("Row", (), r) for r in once], texts, 4096)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_an_empty_table(spark, sf, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd, sf).collect()
    wanted = {r.doc_id for r in odd.select("doc_id").collect()}
    assert {r.doc_id for r in found} <= wanted and len(found) > 0
    if name != "best_fit_packing":
        assert stage(spark, odd, sf).columns == stage(spark, none, sf).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    else:
        assert {r.doc_id for r in found} == wanted
    assert stage(spark, none, sf).count() == 0


def test_all_stages_in_a_row_on_odd_rows(spark, sf, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.where("length > 4096 or offset + length > 4096").count() == 0
