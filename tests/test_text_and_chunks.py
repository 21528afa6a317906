import re

import pytest
from pyspark.sql import functions as F
from quillgrid.functions import text as X
from quillgrid.operators import chunking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, "RAG is useful—really useful!", X.tokens(F.col("t"))) == ["RAG", "is", "useful", "—", "really", "useful", "!"]
    assert one(spark, " \n\t", X.token_count(F.col("t"))) == 0 and one(spark, None, X.token_count(F.col("t"))) == 0


def test_folding_and_white_space(spark):
    assert one(spark, "Straße STRASSE", X.terms(F.col("t"))) == ["strasse", "strasse"]
    assert one(spark, "Straße ǅ", X.casefold(F.col("t"))) == "strasse ǆ"
    assert one(spark, "  a  b\n\tc ", X.normalize(F.col("t"))) == "a b c"
    assert one(spark, "_ a_b é! x", X.rerank_terms(F.col("t"))) == ["a_b", "é", "x"]
    assert len(one(spark, "word " * 40, X.title(F.col("t")))) == 80


def test_small_functions(spark):
    assert one(spark, "see [2], [1] and [2] not [x]", X.citation_ids(F.col("t"))) == [1, 2]
    assert one(spark, "one two  three", X.truncate_tokens(F.col("t"), F.lit(2))) == "one two"
    assert one(spark, "one two  three", X.truncate_tokens(F.col("t"), F.lit(3))) == "one two  three"
    assert one(spark, "/a/b/Notes.MD", X.suffix(F.col("t"))) == ".md" and one(spark, "/a/b/Notes.MD", X.basename(F.col("t"))) == "Notes.MD"
    assert one(spark, 'a"b\\c', X.escape_label(F.col("t"))) == 'a\\"b\\\\c'
    assert one(spark, "ok-1.2", X.safe_label(F.col("t"))) and not one(spark, "no blank", X.safe_label(F.col("t")))
    assert one(spark, "", X.prompt(F.col("t"), F.lit(" q? "))).endswith("(No relevant context was retrieved.)\n\nQuestion:\nq?")
    vector = one(spark, "alpha", X.embed_deterministic(8)(F.col("t")))
    assert len(vector) == 8 and all(-1 <= v <= 1 for v in vector)
    assert one(spark, "x", X.ratio(F.lit(1.0), F.lit(0.0))) == 0


def rows(spark, text, size, overlap, make=chunking.chunk_fixed):
    return make(spark.createDataFrame([("d", text)], "id string, body string"), "id", "body", size, overlap).orderBy("position").collect()


def test_fixed_windows(spark):
    text = "one two three four five six seven eight"
    found = rows(spark, text, 4, 1)
    assert [(r.token_start, r.token_end, r.token_count) for r in found] == [(0, 4, 4), (3, 7, 4), (6, 8, 2)]
    assert all(text[r.char_start : r.char_end] == r.text for r in found)
    greek = rows(spark, "άλφα βήτα γάμμα δέλτα έψιλον", 3, 1)
    assert [(r.char_start, r.char_end) for r in greek] == [(0, 15), (10, 28)]
    assert rows(spark, " \n", 4, 1) == []
    assert chunking.chunk_fixed(spark.createDataFrame([(None,)], "body string").withColumn("id", F.lit(1)), "id", "body").count() == 0


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, -1), (5, 5), (5, 6)])
def test_invalid_windows(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_window(size, overlap)


def test_recursive_keeps_sections_together(spark):
    text = "# Alpha\none two three four\n\n# Beta\nfive six seven"
    found = rows(spark, text, 7, 2, chunking.chunk_recursive)
    assert any("# Beta\nfive six seven" in r.text for r in found) and all(r.token_count <= 7 for r in found)
    assert found[1].token_start == found[0].token_end - 2
    assert all(text[r.char_start : r.char_end] == r.text for r in found)


def test_recursive_falls_back_to_tokens(spark):
    found = rows(spark, "a b c d e f g h i j", 4, 1, chunking.chunk_recursive)
    assert all(r.token_count <= 4 for r in found) and found[-1].token_end == 10
    assert all(b.token_start == a.token_end - 1 for a, b in zip(found, found[1:], strict=False))


def test_rollup_and_stats(spark):
    docs = spark.createDataFrame([("d", "a b c d e"), ("e", "")], "id string, body string")
    made = chunking.chunk_fixed(docs, "id", "body", 3, 1)
    assert {(r.id, r.chunk_count, r.token_count) for r in chunking.document_rollup(docs, made, "id").collect()} == {("d", 2, 5), ("e", 0, 0)}
    twenty = spark.range(1, 21).select(F.col("id").cast("int").alias("token_count"))
    stats = chunking.chunk_stats(twenty).first()
    assert (stats.p95_tokens, stats.median_tokens, stats.tokens) == (19, 10.5, 210)


def test_casefold_of_all_characters(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 64]) for i in range(0, len(every), 64)] + ["ΑΣ ΟΔΥΣΣΕΥΣ", "ﬁŉſ İ", "", None]  # a sigma at the end
    texts += every[:0x600] + every[0x1000:0x2200] + every[0xA000 : 0xA000 + 0xC00]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.casefold(F.col("t")).alias("f")).collect()
    assert [r.t for r in rows if r.f != (None if r.t is None else r.t.casefold())] == []
    assert not any(re.search(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.ODD), c) is None for c in X.folds()[0] | X.folds()[1] if ord(c) > 0x17E)


def test_terms_are_folded_after_they_are_cut(spark):
    texts = ["Ǩǰ İstanbul ŉa", "ΌΔΟΣ ﬁn", "Ünïcode Straße", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.terms(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [None if r.t is None else [w.casefold() for w in re.findall(r"\w+", r.t)] for r in rows]


def test_recursive_chunks_come_in_bounded_batches(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    plain = chunking._recursive

    def watched(batches, size, overlap):
        for batch in batches:
            if batch["text"].str.len().sum() > 6 << 20:
                sizes.add(1)
            yield from plain(iter([batch]), size, overlap)

    monkeypatch.setattr(chunking, "_recursive", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("words and more. "), 2500).alias("text"))
    assert chunking.chunk_recursive(docs, "id", "text").select("id").distinct().count() == 400
    assert sizes.value == 0
