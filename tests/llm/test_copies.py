"""SimHash near-dedup, components and line dedup against brute force."""

import random
from collections import Counter

import duckdb
import xxhash
from pyspark.sql import functions as F
from quillgrid.llm import linededup, simhash
from quillgrid.llm.graph import connected_components


def plain_fingerprint(text):
    tokens = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_near(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    known = sorted({p for _, p in prints})
    roots = components(known, [(a, b) for k, a in enumerate(known) for b in known[k + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return Counter((i, f"{p:016x}", least.get(roots[p])) for i, p in prints)


def found_near(df):
    found = simhash.near_duplicates(df)
    return Counter(tuple(r) for r in found.select("doc_id", simhash.hexadecimal(found.fp), "component_id").collect())


def test_near_duplicates_on_documents(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert found_near(spark.read.parquet(f"{sf}/documents.parquet")) == plain_near(rows)


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    assert found_near(odd) == plain_near([r[:2] for r in odd_rows])
    assert simhash.near_duplicates(none).count() == 0


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for c in centres for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    wanted = {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found == wanted


def test_keep_one_leaves_a_document_of_each_group(odd):
    kept = [r.doc_id for r in simhash.keep_one(odd).select("doc_id").collect()]
    assert {0, 3, 6, 8} <= set(kept) and not {1, 2, 4, 5} & set(kept)


def test_keep_one_judges_each_row_in_its_own_group(spark):
    rows = [(4, ""), (11, None), (11, "a long text of its own"), (None, ""), (None, "another text without any id here"), (7, "third one")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in kept} == {rows[0], rows[2], rows[4], rows[5]} and len(kept) == 4


def test_components_of_random_graphs_and_a_chain(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == components({n for p in real for n in p}, real)


def test_patience_keeps_order_and_blocks_need_words():
    a, b = [1, 2, 3, 4, 5, 9, 9], [7, 2, 3, 8, 5, 9, 9, 1]
    matches = linededup.patience(a, b)
    assert [a[i] for i, _ in matches] == [2, 3, 5, 9, 9]
    assert all(i < k and j < m for (i, j), (k, m) in zip(matches, matches[1:], strict=False))
    assert linededup.blocks(matches, [4, 2, 2, 4, 1, 1, 1], 4) == [1, 2]
    assert linededup.patience([1] * 5, [1] * 3) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([], [1]) == []


def test_lines_go_from_the_later_document_only(spark):
    passage = ["a shared passage of more words", "goes on for a second line", "and ends with a third"]
    early = ["own first line of the early one", *passage, "own last line here too"]
    later = ["quite another line of its own", *passage, "tail"]
    both = [(5, "\n".join(later)), (2, "\n".join(early)), (9, "\n".join(early)), (7, "nothing shared in here\ntail")]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(both, "doc_id long, text string")).collect()}
    assert found[2].text == both[1][1] and found[2].lines_deleted == 0
    assert found[5].text == "quite another line of its own\ntail" and found[5].lines_deleted == 3
    assert found[9].text == "" and found[9].lines_deleted == 5
    assert found[7].text == both[3][1]  # one short line is no block


def plain_lines(rows):
    """Every document against every earlier one."""
    size = lambda line: len(line.split())
    out = {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for k, other in rows:
            if k < i:
                earlier = other.split("\n")
                names = {x: n for n, x in enumerate([*lines, *earlier])}
                gone |= set(linededup.blocks(linededup.patience([names[x] for x in lines], [names[x] for x in earlier]), [size(x) for x in lines], 5))
                gone |= set(range(len(lines))) if other == text else set()
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_lines_go_by_any_earlier_holder(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{i}x{j}" for j in range(i % 8)) for i in range(25)]
    rows = [(i, "\n".join([f"own {i}", *rng.choices(pool, k=rng.randint(1, 15))])) for i in range(70)]
    shared = [f"line {i} of more than five words" for i in range(20)]
    rows += [(100 + i, "\n".join(rng.sample(shared, 20))) for i in range(40)] + [(200, "\n".join(["mine", *shared, *shared])), (201, "mine\n" + rows[3][1])]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == plain_lines(rows)


def test_short_lines_scripts_without_blanks_and_short_copies_go(spark):
    menu = "\n".join(f"dish{i} sauce{i}" for i in range(30))
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    thai = "".join(chr(0x0E01 + i % 40) for i in range(40))
    rows = [(1, "top of one\n" + menu), (2, "head of another\n" + menu + "\nend"), (3, "one\n" + han), (4, "two\n" + han), (5, "one\n" + thai), (6, "two\n" + thai), (7, "just two"), (8, "just two"), (9, "a\nb\nc"), (10, "a\nb\nd"), (11, ""), (12, "")]
    found = {r.doc_id: (r.text, r.lines_deleted) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2] == ("head of another\nend", 30) and found[4] == ("two", 1) and found[6] == ("two", 1) and found[8] == ("", 1)
    assert all(found[i] == (t, 0) for i, t in rows if i in (1, 3, 5, 7, 9, 10, 11, 12))


def test_line_dedup_of_odd_rows(odd, odd_rows, none):
    found = linededup.dedup_lines(odd).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    text = dict((r[0], r[1]) for r in odd_rows if r[1] is not None)
    assert by_id[0].text == text[0] and by_id[1].text == "" and by_id[3].text is None and by_id[8].text == text[8]
    assert by_id[9].text == "more words at the end" and by_id[10].text == text[10]
    assert [r.text for r in found if r.doc_id is None and r.text is not None] == [""]  # null is later than any other
    assert linededup.dedup_lines(none).count() == 0


def test_blocks_shared_by_later_documents_go(spark):
    """Documents 0 and 1 hold one line each of a block of six words that only 2 and 3 hold whole."""
    rows = [(0, "own zero\none two three"), (1, "own one\nfour five six"), (2, "head of two\none two three\nfour five six"), (3, "another head\none two three\nfour five six\nend")]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: rows[0][1], 1: rows[1][1], 2: rows[2][1], 3: "another head\nend"} == plain_lines(rows)


def test_very_many_lines_and_a_common_window(spark):
    body = [f"line number {i} of a very long document" for i in range(60_000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["new first line of the second one", *body, "and its last"]))]
    rng = random.Random(8)
    common = ["this passage stands in every document here", "and goes on for another line"]
    rows += [(100 + i, "\n".join([f"title {i}", *common, f"own words of number {i} only {rng.random()}"])) for i in range(400)]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found[2].text == "new first line of the second one\nand its last" and found[2].lines_deleted == 60_000
    assert found[100].lines_deleted == 0 and all(found[100 + i].lines_deleted == 2 for i in range(1, 400))


def test_extra_columns_pass_near_dedup(odd):
    assert simhash.keep_one(odd).columns == odd.columns
    assert [c for c in linededup.dedup_lines(odd).columns if c != "lines_before"] == [c for c in odd.columns if c != "lines_deleted"] + ["lines_deleted"]
    kept = linededup.dedup_lines(odd).where("doc_id = 6").first()
    assert (kept._rid, kept._gone, kept.r, kept.lines, kept["a b"]) == ("r", 1, 2, 3, 6)


def test_nothing_that_grows_with_the_fingerprints_is_broadcast(spark):
    rows = spark.range(3000).select((F.xxhash64("id")).alias("fp")).union(spark.range(3000).select(F.xxhash64("id").bitwiseXOR(F.lit(1)).alias("fp")))
    found = simhash.links(rows.repartition(4))
    assert found.count() == 3000
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
