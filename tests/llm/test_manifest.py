"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from quillgrid.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def paths(digests, fanout=3):
    """(root, path of (before, after) of each leaf)."""
    found, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % fanout
            found[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], found


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *paths([leaf(r) for r in own]))
    root, above = paths([trees[s][1] for s in order])
    out = []
    for s, outer in zip(order, above, strict=True):
        own, subroot, inner = trees[s]
        for r, path in zip(own, inner, strict=True):
            whole = path + outer
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if bad else leaf(r)
            for a, b in whole:
                now = h(a, now, b)
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in whole)), now, now == root))
    return out


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def made(docs):
    return merkle.manifest(docs, merkle.without_newlines()).select(*COLUMNS).collect()


def test_query_equals_the_plain_tree_and_its_sql(spark, sf):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf}/documents.parquet'").fetchall()]
    found = queries.op12_merkle_manifest(spark, sf).select(*COLUMNS).collect()
    assert plain(found) == plain(brute(rows))
    assert {r.verified for r in found} == {True, False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert plain(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_merkle_manifest']})").fetchall()) == plain(found)


def test_odd_rows_and_no_rows(odd, none):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert plain(made(odd)) == plain(brute(rows))
    assert made(none) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_buckets_of_few_levels_make_the_same_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle.climb, "__defaults__", (3, 2))  # buckets of nine nodes: several rounds of buckets
    rows = [(i * 7 % 100, "hot" if i % 5 else f"s{i}", None, i, f"line {i}\nmore") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert plain(made(docs)) == plain(brute(rows))


def test_places_of_a_hot_group_over_many_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 70).cast("string"))).alias("g"), (5000 - F.col("id")).alias("v"))
    got = merkle.in_place(rows, "g", ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    assert len(got) == 5000
    for own in by.values():
        own.sort(key=lambda r: r.v)
        assert [r.place for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def test_a_changed_row_alone_fails(spark):
    rows = [(i, "s", "en", 3, f"t{i}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, F.when(F.col("doc_id") == 4, "other").otherwise(F.col("text"))).collect()
    assert {r.doc_id for r in found if not r.verified} == {4}


def test_paths_are_neither_shuffled_nor_written(spark):
    """Paths joined to rows by their place were a shuffle of many times the rows, as soon as they weren't broadcast."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("a").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = merkle.manifest(docs, F.col("text"))
        assert made.where("verified").count() == 3000
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(grp#\d+, place#", plan)
