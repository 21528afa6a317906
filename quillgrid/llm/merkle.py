"""A Merkle manifest of a dataset: a leaf a row, a tree a source, a tree over the sources, a proof a row, and its check.

Rows get their places in their source from ranges in order: the place in the range, plus what earlier ranges hold of the source.
Places are cut into aligned buckets of FANOUT ** LEVELS rows, which are whole subtrees, whatever lies beside them. In an executor
DuckDB takes a bucket as an Arrow table and computes its levels: ordered string_agg over runs of FANOUT nodes, sha256 of each
run, and for each node the text left and right of it in its run. Spark takes the buckets' roots as the nodes of the next tree,
by the same buckets, until one is left of each source; sources' roots make the last tree. Then each bucket meets the one path from
its root outwards and is climbed again, for the paths of its rows: these are many times the rows, so they are neither shuffled nor
written, but folded where they are made. Digests are lowercase hex text throughout, also where they are hashed.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize

FANOUT = 3
LEVELS = 7  # of a bucket: up to 2,187 nodes
_PATH = "array<struct<before: string, after: string>>"
_SQL: list = []  # the connection of a worker process

def _connection() -> duckdb.DuckDBPyConnection:
    if not _SQL:
        _SQL.append(duckdb.connect(config={"threads": 1, "memory_limit": "256MB"}))
    return _SQL[0]

def climb_bucket(bucket: pa.Table, fanout: int = FANOUT, levels: int = LEVELS) -> pa.Table:
    """grp, place, path (siblings before and after, from the node upwards) and top, the bucket's root, of each node.

    bucket: grp, n (nodes of the whole group), bucket, place and digest. A group that fits one bucket climbs to its one root,
    any other bucket by all its levels."""
    sql = _connection()
    n, low = bucket["n"][0].as_py(), bucket["bucket"][0].as_py() * fanout**levels
    rise, left = 0, n
    while left > 1 and rise < levels:
        rise, left = rise + 1, -(-left // fanout)
    sql.register("bucket", bucket)
    sql.execute(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT place - {low} AS i, digest FROM bucket")
    sql.execute("CREATE OR REPLACE TEMP TABLE paths AS SELECT i AS place, i, []::STRUCT(before VARCHAR, after VARCHAR)[] AS path FROM nodes")
    for _ in range(rise):
        sql.execute(f"""CREATE OR REPLACE TEMP TABLE sides AS SELECT i, digest,
            coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY i // {fanout} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY i // {fanout} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes""")
        sql.execute(f"CREATE OR REPLACE TEMP TABLE paths AS SELECT p.place, p.i // {fanout} AS i, list_append(p.path, {{'before': s.before, 'after': s.after}}) AS path FROM paths p JOIN sides s ON p.i = s.i")
        sql.execute(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT i // {fanout} AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM nodes GROUP BY i // {fanout}")
    ((top,),) = sql.execute("SELECT any_value(digest) FROM nodes").fetchall()
    made = sql.sql(f"SELECT place + {low} AS place, path FROM paths ORDER BY place").to_arrow_table()
    sql.unregister("bucket")
    same = [pa.array([v] * len(made), t) for v, t in ((bucket["grp"][0].as_py(), pa.string()), (bucket["bucket"][0].as_py(), pa.int64()), (top, pa.string()))]
    path = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"grp": same[0], "bucket": same[1], "place": made["place"].cast(pa.int64()), "path": made["path"].cast(path), "top": same[2]})

def _top(bucket: pa.Table, fanout: int, levels: int) -> pa.Table:
    return climb_bucket(bucket, fanout, levels).slice(0, 1).select(["grp", "bucket", "top"]).append_column("n", bucket["n"].slice(0, 1))

def _inner(bucket: pa.Table, above: pa.Table, fanout: int, levels: int, names: list[str]) -> pa.Table:
    """The rows of a bucket with their paths to its root, and the columns ``names`` of its one row of ``above``."""
    bucket = bucket.sort_by("place")
    made = bucket.append_column("path", climb_bucket(bucket, fanout, levels)["path"])
    for name in names:
        made = made.append_column(name, above[name].take(pa.array([0] * len(made))))
    return made

def buckets(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with the number of their bucket."""
    return nodes.withColumn("bucket", F.expr(f"place div {fanout**levels}L"))

def tops(cut: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, bucket, top, n) of each bucket, written; n: nodes of the group. cut: nodes (grp, n, place, digest) with their bucket."""
    def top_of(bucket: pa.Table) -> pa.Table:
        return _top(bucket, fanout, levels)

    return materialize(cut.select("grp", "n", "bucket", "place", "digest").groupBy("grp", "bucket").applyInArrow(top_of, "grp string, bucket long, top string, n long"), "merkle")

def within(cut: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``cut`` with ``path``, that of each node to its bucket's root, and what ``above`` has of its bucket (a row each)."""
    names = [c for c in above.columns if c not in ("grp", "bucket")]
    schema = T.StructType([*cut.schema.fields, T.StructField("path", T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))), *[above.schema[c] for c in names]])

    def inner_of(bucket: pa.Table, outside: pa.Table) -> pa.Table:
        return _inner(bucket, outside, fanout, levels, names)

    return cut.groupBy("grp", "bucket").cogroup(above.groupBy("grp", "bucket")).applyInArrow(inner_of, schema)

def outwards(roots: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, bucket, outer, root) of buckets (``tops``): the path of each from its root to that of its group."""
    if roots.where("bucket > 0").isEmpty():
        return roots.select("grp", "bucket", F.array().cast(_PATH).alias("outer"), F.col("top").alias("root"))
    counted = roots.groupBy("grp").agg(F.count("*").alias("n"))
    above = climb(roots.select("grp", F.col("bucket").alias("place"), F.col("top").alias("digest")).join(counted, "grp"), fanout, levels)
    return above.select("grp", F.col("place").alias("bucket"), F.col("path").alias("outer"), "root")

def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(grp, place, path, root) of nodes (grp, n, place, digest): the whole path of each to the root of its group."""
    cut = buckets(nodes, fanout, levels)
    met = within(cut, outwards(tops(cut, fanout, levels), fanout, levels), fanout, levels)
    return met.select("grp", "place", F.concat("path", "outer").alias("path"), "root")

def in_place(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in the order given) in their group and ``n``, the group's number of rows; written.

    Ranges hold about equal numbers of rows, however large a group; a row a range and group is counted over."""
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, *order).sortWithinPartitions(by, *order)
    at = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_range", F.shiftrightunsigned("_at", 33))
    runs = at.groupBy("_range", F.col(by).alias("_by")).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_by")
    earlier = F.coalesce(F.sum("_count").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col("_range").alias("_r"), "_by", "_first", earlier.alias("_earlier"), F.sum("_count").over(group).alias("n"))
    met = at.join(starts, (at["_range"] == starts["_r"]) & (at[by] == starts["_by"]))
    return met.withColumn("place", F.col("_at") - F.col("_first") + F.col("_earlier")).select(*rows.columns, "place", "n")

def part(value: Column) -> Column:
    """How a value enters a leaf: '-' for null, else its length in UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(part, values)), 256)

def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings of its path give."""
    return F.aggregate(path, digest, lambda now, step: F.sha2(F.concat(step["before"], now, step["after"]), 256))

def manifest(docs: DataFrame, tampered: Column, doc_id: str = "doc_id", source: str = "source", text: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    ``tampered`` is the text as found later (a column over ``docs``); folded_root is the root that it gives with the row's
    original siblings, verified whether that is the original root. Leaves of a source are in the order of doc_id (null first),
    those of one doc_id in the order of their leaves; sources by their bytes, null first; an empty source is not null. A run of
    one node is hashed like any other, a tree of one node is that node. Equal rows give equal leaves and follow one another; each
    has the proof of its own place. An empty table gives no rows. Columns not named in ``columns`` are not read."""
    parts = [F.col(c) for c in columns]
    later = [tampered if c == text else F.col(c) for c in columns]
    original = leaf(*parts)
    # the text is hashed a second time only where it differs
    again = F.when(tampered.eqNullSafe(F.col(text)), F.lit(None).cast("string")).otherwise(leaf(*later))
    group = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))  # null sorts first
    leaves = bounded_batches(docs).select(group.alias("grp"), F.col(doc_id).alias("doc_id"), original.alias("leaf"), again.alias("later"))
    placed = materialize(in_place(leaves, "grp", ["doc_id", "leaf"]), "leaves")
    shape = climb.__defaults__  # fanout, levels
    cut = buckets(placed.withColumnRenamed("leaf", "digest"), *shape)
    inner = materialize(outwards(tops(cut, *shape), *shape), "outwards")
    subroots = inner.groupBy("grp").agg(F.first("root").alias("digest"))
    top = in_place(subroots.select(F.lit("all").alias("of"), "grp", "digest"), "of", ["grp"])
    last = climb(top.select(F.col("of").alias("grp"), "n", "place", "digest")).select("place", F.col("path").alias("last"), "root")
    sources = top.join(last, "place").select("grp", F.col("digest").alias("subroot"), "last", "root")
    above = inner.select("grp", "bucket", "outer").join(sources, "grp").select("grp", "bucket", F.concat("outer", "last").alias("outer"), "subroot", "root")
    siblings = lambda path: F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")
    met = within(cut, above, *shape).withColumn("whole", F.concat("path", "outer")).withColumnRenamed("digest", "leaf")
    folded = fold(F.coalesce("later", "leaf"), F.col("whole"))
    return met.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("whole")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

def without_newlines(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The tampering that the manifest's query checks: of rows whose decimal doc_id has an even CRC-32, newlines are deleted."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
