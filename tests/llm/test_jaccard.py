"""Jaccard components against all pairs in plain Python, and the bounds of signature trees."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quillgrid.llm import queries, sigtree

BLANKS = b" \t\n\r\x0b\x0c"


def shingle_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({b: " " for b in BLANKS}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """rows: (doc_id, text); one answer a row."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in sigtree.similar_components(docs).collect())


def test_query_equals_all_pairs_and_its_sql(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op13_ngram_jaccard(spark, sf).collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted((str(d), n, str(c)) for d, n, c in con.sql(queries.oracle_sql()["op13_ngram_jaccard"]).fetchall()) == got


def test_odd_rows_and_no_rows(odd, none):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []


def near(rng, words, share):
    return " ".join(rng.choice(["zeta", "eta", "theta"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_groups_of_near_copies_chains_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "LEAF", 8)  # many leaf nodes to a tree
    monkeypatch.setattr(sigtree, "HELD", 16)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage, rows = " ".join(word() for _ in range(60)), []
    for size in (8, 40, 160):
        base = [word() for _ in range(size)]
        rows += [near(rng, base, 0.02) for _ in range(60)]  # about the limit: some link, some by others only
    rows += [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(40):
        chain = chain[2:] + [word(), word()]
        rows.append(" ".join(chain))
    rows += ["same Text here now", "SAME text\there\nnow", "same text here", "a b c d e", "A B C D E", "a b c d e f"] + [rows[0]] * 20
    rng.shuffle(rows)
    given = list(enumerate(rows))
    assert found(spark.createDataFrame(given, "doc_id long, text string").repartition(5)) == brute(given)


def test_tokens_meet_without_a_filter_of_fixed_size_and_one_walk_is_enough(spark, monkeypatch):
    rng, sieved, walks, walked = random.Random(5), [], [], sigtree.candidates
    rows = [(10 * g + i, near(rng, [f"g{g}w{w}" for w in range(90)], 0.012)) for g in range(6) for i in range(8)]
    keep = sigtree._sieved
    monkeypatch.setattr(sigtree, "_sieved", lambda df, key, wanted: sieved.append(key) or keep(df, key, wanted))
    monkeypatch.setattr(sigtree, "candidates", lambda *a: walks.append(a[-1]) or walked(*a))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert "token" not in sieved and len(walks) == 1


def test_trees_stand_for_the_tokens_that_the_same_classes_share(spark):
    classes = spark.createDataFrame([(1, 9, [5, 6, 7, 8]), (2, 9, [5, 6, 9]), (3, 8, [7, 10]), (4, 1, [])], "cls long, n long, prefix array<long>")
    trees = {}
    for r in sigtree.shared_tokens(classes).collect():
        trees.setdefault(r.tree, []).append((r.cls, r.n, r.weight))
    assert sorted(map(sorted, trees.values())) == [[(1, 9, 1), (3, 8, 1)], [(1, 9, 2), (2, 9, 2)]]


def test_pairs_that_a_walk_held_back_are_verified_later(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "TAKE", 1)
    monkeypatch.setattr(sigtree, "LEAF", 4)
    rng = random.Random(3)
    base = [f"b{w}" for w in range(60)]
    rows = [(i, near(rng, base, 0.025)) for i in range(70)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_sets_at_the_limit_link(spark):
    # n and n + m tokens of which n are common: similarity n / (n + m), linked at four fifths exactly
    rows = []
    for k, (n, m) in enumerate([(4, 1), (7, 2), (8, 2), (40, 10), (39, 10), (400, 100), (399, 100), (4000, 1000), (3999, 1000)]):
        words = [f"w{k}x{i}" for i in range(n + m + 4)]
        rows += [(2 * k, " ".join(words[: n + 4])), (2 * k + 1, " ".join(words))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and len({c for _, _, c in got}) == 9 + 4


def test_prefixes_of_like_sets_meet():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 64)
    for n in (1, 2, 4, 5, 6, 9, 10, 50, 333):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            lost = int(rng.integers(0, len(a) // 5 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert len(np.intersect1d(sigtree.prefix(a, counts), sigtree.prefix(b, counts)))


@pytest.mark.parametrize("seed", range(4))
def test_walks_lose_no_link_and_skip_components(seed):
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])) for b in bases for _ in range(9)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    comp = rng.integers(0, 40, len(sets))
    maps = [sigtree.signature(s).tobytes() for s in sets]

    def nodes(at):
        return sigtree.Nodes(at, comp[at], np.array([len(sets[i]) for i in at]), [maps[i] for i in at], min(len(m) // 8 for m in maps))

    def like(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)

    at, looked = np.arange(len(sets)), []
    whole = nodes(at)
    x, y, bound = sigtree.walk(whole, whole, looked)
    pairs = {tuple(sorted(p)) for p in zip(whole.cls[x].tolist(), whole.cls[y].tolist(), strict=True)}
    assert len(pairs) == len(x) and all(comp[i] != comp[j] for i, j in pairs)
    assert all(b >= len(np.intersect1d(sets[whole.cls[i]], sets[whole.cls[j]])) for i, j, b in zip(x, y, bound, strict=True))
    assert {(i, j) for j in at for i in range(j) if like(i, j) and comp[i] != comp[j]} <= pairs
    assert len(pairs) < len(sets) * (len(sets) - 1) / 4
    left, right = nodes(at[:50]), nodes(at[50:])
    x, y, _ = sigtree.walk(left, right)
    crossed = set(zip(left.cls[x].tolist(), right.cls[y].tolist(), strict=True))
    assert {(i, j) for i in at[:50] for j in at[50:] if like(i, j) and comp[i] != comp[j]} <= crossed


def test_a_tree_of_one_component_is_left_at_its_root():
    tokens = np.arange(40, dtype=np.uint64) << np.uint64(20)
    same = sigtree.Nodes(np.arange(64), np.zeros(64, np.int64), np.full(64, 40), [sigtree.signature(tokens).tobytes()] * 64, 2)
    looked = []
    assert len(sigtree.walk(same, same, looked)[0]) == 0 and sum(looked) == 1


def test_members_that_share_too_late_are_left_and_no_pair_is_lost():
    """By sizes alone most members of chance trees stayed, and their signatures were fetched: more than the input grew."""
    rng = np.random.default_rng(4)
    rows = sorted((int(t), int(n), int(rng.integers(0, n // 5 + 1)), i) for i, (t, n) in enumerate(zip(rng.integers(0, 300, 900), rng.integers(20, 60, 900), strict=True)))
    table = pa.table({"tree": [r[0] for r in rows], "cls": [r[3] for r in rows], "comp": [r[3] for r in rows], "n": [r[1] for r in rows], "at": pa.array([r[2] for r in rows], pa.int32())})
    wanted, by_size = set(), set()
    for i, a in enumerate(rows):
        for b in (b for b in rows[i + 1 :] if b[0] == a[0] and 5 * a[1] >= 4 * b[1]):
            by_size |= {a[3], b[3]}
            if 9 * min(a[1] - a[2], b[1] - b[2]) >= 4 * (a[1] + b[1]):
                wanted |= {a[3], b[3]}
    for size in (900, 7, 1):
        kept = {c for batch in sigtree._met_by_size(iter(table.to_batches(max_chunksize=size))) for c in batch.column("cls").to_pylist()}
        assert wanted <= kept and len(kept) < 0.8 * len(by_size)
