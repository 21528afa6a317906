"""SimHash near-duplicates over all documents, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two bits, one
segment differs in at most one bit. The index holds each segment as it is and with one bit deleted (a wildcard);
equality joins on these variants propose pairs and the bits decide. Three kinds of key cover every pair once or twice:

* high segment equal, low segments differ in one or two bits: one of three parts of the low segment is equal too;
* low segment equal, high segments differ in one or two bits: likewise;
* high segments differ in one bit, low segments in one: the high segment without that bit, and the equal half of the low.

So a key fixes at least 42 bits, the rows of the index are 70 for each different fingerprint, and a fingerprint has at
most 2,080 others within two bits: neither rows nor links grow with the square of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize
from quillgrid.llm.graph import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
_AT_ONCE = 255 * 64  # hashes whose bits are unpacked together


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; null and texts without words give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    n = max(1, len(tokens) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _AT_ONCE):
        part = hashes[start : start + _AT_ONCE]
        # eight one-byte counters to a lane, added 255 rows at a time so that none overflows
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        ones += np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _printed(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column("text")), dtype=np.uint64, count=len(batch))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made.view(np.int64))], [*kept, "fp"])


def with_fingerprint(rows: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` with their column ``text`` replaced by its fingerprint ``fp`` as a signed long (the same 64 bits)."""
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("fp", T.LongType())])
    return bounded_batches(rows).mapInArrow(partial(_printed, words=words, seed=seed), schema)


def _cut(bits: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))


def _key(tag: int, *parts: tuple[Column, int]) -> Column:
    key = F.lit(tag).cast("long")
    for value, width in parts:
        key = F.shiftleft(key, width).bitwiseOR(value)
    return key


def variant_keys(fp: Column) -> Column:
    """The array of a fingerprint's index keys. The top bits of a key are its kind (0-2 high equal, 3-5 low equal, 6-69 one bit of high deleted)."""
    high, low = _cut(fp, 32, 32), _cut(fp, 0, 32)
    parts = ((0, 11), (11, 11), (22, 10))
    keys = [_key(j, (high, 32), (_cut(low, at, width), 16)) for j, (at, width) in enumerate(parts)]
    keys += [_key(3 + j, (low, 32), (_cut(high, at, width), 16)) for j, (at, width) in enumerate(parts)]
    for i in range(32):
        without = high.bitwiseAND(F.lit(((1 << 32) - 1) & ~(1 << i)))
        keys += [_key(6 + 2 * i + half, (without, 32), (_cut(low, 16 * half, 16), 16)) for half in (0, 1)]
    return F.array(*keys)


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints of the column that differ in one or two bits."""
    known = fingerprints.select(F.col(fp).alias("f")).where("f is not null").distinct()
    # small until each becomes 70 rows: partitions whose number is given aren't merged by size before that, and a key of
    # their own keeps this exchange apart from the one of the distinct
    spread = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("f"))
    index = spread.select("f", F.explode(variant_keys(F.col("f"))).alias("key"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    kind = F.shiftrightunsigned(F.col("key"), 48)
    deleted = F.when(kind >= 6, F.expr("shiftleft(1L, cast(32 + shiftright(shiftrightunsigned(key, 48) - 6, 1) as int))")).otherwise(F.lit(0).cast("long"))
    other = index.select(F.col("f").alias("b"), "key")
    # a pair is taken only where the deleted bit is one that differs, else it would come once for each bit that could be deleted
    near = (F.col("a") < F.col("b")) & (F.bit_count(differs) <= MAX_BITS) & (differs.bitwiseAND(deleted) == deleted)
    # by sort and merge always: each side is 70 rows a fingerprint, which the size that Spark has measured ahead of the explode doesn't say
    return index.select(F.col("f").alias("a"), "key").join(other.hint("merge"), "key").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable over links.

    Null text and text without words have fingerprint 0 and are linked like any other. Rows with the same text share
    their fingerprint and component; a repeated row gives a repeated row. A null doc_id stays null and gets the component
    of its fingerprint, which is null only if no row there has a doc_id. An empty table gives no rows. Other columns,
    whatever their names, are not read."""
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    return _grouped(prints).select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    """Rows with doc_id and fp, and the component_id of each."""
    roots = connected_components(links(prints))
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "prints")
    # written, so that joins deal both sides out themselves and the rows of a giant component or a frequent text can be split
    named = materialize(each.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_print = materialize(each.join(named.hint("merge"), "root").select("fp", "component_id"), "prints")
    return prints.join(by_print.hint("merge"), "fp")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays of each near-duplicate group: the one with the smallest doc_id.

    Repeated rows of that doc_id in the group stay together; rows of one doc_id with texts of different groups are judged
    each in its own group. A group without any doc_id stays whole."""
    text_hash = F.coalesce(F.md5(F.col(text)), F.lit("-"))
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), text_hash.alias("hash"), F.col(text).alias("text"))), "fingerprints")
    found = _grouped(prints).where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    stays = materialize(found.select("doc_id", "hash").distinct(), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")  # so that no column's name meets those of this join
    rows = docs.select(row, F.col(doc_id).alias("own"), text_hash.alias("own_hash"))
    met = rows.join(stays.hint("merge"), rows.own.eqNullSafe(stays.doc_id) & (rows.own_hash == stays["hash"]), "left_semi")
    return met.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
