"""Line deduplication by pairwise alignment.

Only a block of enough words can be deleted, so documents that overlap are found through the hashes of windows: the
shortest runs of lines, from each line on and up to each line, that reach these words. A line of enough words is its own
window. Every block that two documents share holds a window around each of its lines, so no length of line is left out.
A pair is aligned by patience diff over its lines, and aligned common blocks of enough words are deleted from the later
document. Exact copies of an earlier text, of any length, lose all their lines at once and pair with nothing.

A rare window (at most RARE holders) pairs each holder with every earlier one. A later holder of a frequent window is paired
with the earliest, then, in rounds, with its next earlier holders, four times as many in each round as before, as long as a
line of the window is left. So what goes is what alignment with every earlier document would delete, while pairs of
frequent windows grow with the square only where alignment keeps failing.

Words are runs between blanks; in scripts that are written without blanks, each ideograph or kana is a word, and each four
characters of Thai, Lao, Tibetan, Burmese or Khmer.

Earlier and later are by doc_id, null last, then by a hash of the row. Lines, texts and rows are compared by 128-bit hashes;
windows only propose pairs. Only hashes are exchanged; texts move once, to meet their deletions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize

MIN_BLOCK_WORDS = 5  # an aligned block of fewer words stays
RARE = 4  # holders of a window that are all paired at once
ROUND_GROWTH = 4  # each round tries this many times the holders of the round before
_IDEOGRAPHS, _ABUGIDAS = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_IDEOGRAPHS}{_ABUGIDAS}]")
_WORD = re.compile(rf"[^\x20\x09-\x0D{_IDEOGRAPHS}{_ABUGIDAS}]+|[{_IDEOGRAPHS}]|[{_ABUGIDAS}]{{1,4}}")
_HASH = 16  # bytes of a line's hash
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def _anchors(a: list, b: list, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Lines that are unique on both sides in these ranges, in the longest run that rises on both; where none is unique, the k-th of one side counts as the k-th of the other."""
    ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
    where = {h: j for j, h in enumerate(b[j0:j1], j0) if cb[h] == 1 and ca.get(h) == 1}
    if where:
        pairs = [(i, where[h]) for i, h in enumerate(a[i0:i1], i0) if h in where]
    else:
        seen_b: Counter = Counter()
        nth = {}
        for j in range(j0, j1):
            nth[b[j], seen_b[b[j]]] = j
            seen_b[b[j]] += 1
        seen_a: Counter = Counter()
        pairs = []
        for i in range(i0, i1):
            if (j := nth.get((a[i], seen_a[a[i]]))) is not None:
                pairs.append((i, j))
            seen_a[a[i]] += 1
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            last.append(n)
        else:
            tails[at], last[at] = j, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, rising on both sides."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        anchors = _anchors(a, b, i0, i1, j0, j1)
        if not anchors:
            continue
        found += anchors
        edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        open_ += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(found)


def blocks(matches: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Places of the first side in runs that go on on both sides and have at least ``least`` words."""
    out, run = [], []
    for i, j in [*matches, (-9, -9)]:
        if run and (i, j) == (run[-1][0] + 1, run[-1][1] + 1):
            run.append((i, j))
            continue
        if sum(words[x] for x, _ in run) >= least:
            out += [x for x, _ in run]
        run = [(i, j)]
    return out


def windows(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends): the shortest runs of lines that begin or end at each line and have at least ``least`` words.

    A key is a polynomial over the run's line hashes modulo 2^64: equal runs have equal keys wherever they stand."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if sums[-1] < least:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    ends = np.searchsorted(sums, sums[:-1] + least, "left")
    starts = np.searchsorted(sums, sums[1:] - least, "right") - 1
    runs = np.concatenate([np.arange(n) * (n + 1) + ends, starts * (n + 1) + np.arange(1, n + 1)])
    runs = np.unique(runs[np.concatenate([ends <= n, starts >= 0])])
    starts, ends = runs // (n + 1), runs % (n + 1)
    powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    totals = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes.view(np.uint64) * powers)])
    return ((totals[ends] - totals[starts]) * inverse[starts]).view(np.int64), starts, ends


def _lines(text: str | None) -> tuple[bytes, list[int], bytes | None]:
    """(hashes, words, copy): of each line its hash and number of words; copy is the hash of a text that isn't empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    if _UNSPACED.search(text or ""):
        words = [len(_WORD.findall(x)) for x in text.split("\n")]
    else:
        words = [len(x.split()) for x in lines]  # of bytes: the six ASCII blanks only
    return b"".join(map(xxhash.xxh3_128_digest, lines)), words, xxhash.xxh3_128_digest(data) if data else None


def _read_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_lines(x) for x in batch.column("text").to_pylist()]
        cut = [windows(np.frombuffer(h, dtype="<i8")[::2], np.array(w, dtype=np.int64), least) for h, w, _ in found]
        parts = [[np.array(w, dtype=np.int32) for _, w, _ in found], *([x[k] for x in cut] for k in range(3))]
        lists = []
        for part, kind in zip(parts, (np.int32, np.int64, np.int32, np.int32), strict=True):
            offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).astype(kind) if part else np.zeros(0, dtype=kind))))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array([c for _, _, c in found], pa.binary()), pa.array([h for h, _, _ in found], pa.binary()), *lists], ["rid", "id", "copy", "hashes", "words", "keys", "starts", "ends"])


def _names(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + _HASH] for i in range(0, len(hashes), _HASH)]


def _rows_of(rids: list[bytes], values: list, kind: pa.DataType, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(values, kind)], ["rid", name])


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, lines = [], []
        for rid, later, words, earlier in zip(*(batch.column(c).to_pylist() for c in ("rid", "later", "words", "earlier")), strict=True):
            lost = blocks(patience(_names(later), _names(earlier)), words, least)
            rids += [rid] * len(lost)
            lines += lost
        yield _rows_of(rids, lines, pa.int32(), "line")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, hashes = [], []
        for row in range(len(batch)):
            keys, starts, ends = (batch.column(c)[row].values.to_numpy() for c in ("keys", "starts", "ends"))
            gone = np.zeros(ends.max() + 1, dtype=np.int64)
            if (lines := batch.column("lines")[row]).is_valid:
                lines = lines.values.to_numpy()
                gone[lines[lines < len(gone)]] = 1
            sums = np.concatenate([[0], np.cumsum(gone)])
            left = np.unique(keys[sums[ends] - sums[starts] < ends - starts]).tolist()
            rids += [batch.column("rid")[row].as_py()] * len(left)
            hashes += left
        yield _rows_of(rids, hashes, pa.int64(), "hash")


def _row_id(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.coalesce(F.md5(text), F.lit("-")))))


def _read(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(rid, place, copy, hashes, words, keys, starts, ends) of each different row; place orders them."""
    rows = bounded_batches(docs).select(_row_id(F.col(doc_id), F.col(text)).alias("rid"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("copy", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    read = rows.mapInArrow(partial(_read_lines, least=least), schema).dropDuplicates(["rid"])
    return materialize(read.select("rid", F.struct(F.col("id").isNull(), "id", "rid").alias("place"), *schema.names[2:]), "lines")


def _ranked(holders: DataFrame) -> DataFrame:
    """(rid, hash, at): the rank, from 0, of each holder of a window. A frequent window's holders lie in several ranges of a sort,
    so that no task has them all; each range counts on from those before it."""
    ranges = materialize(holders.repartitionByRange("hash", "place").withColumn("part", F.spark_partition_id()), "holders")
    counts = ranges.groupBy("hash", "part").agg(F.count("*").alias("n"))
    before = counts.select("hash", "part", (F.sum("n").over(Window.partitionBy("hash").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("hash", "part").orderBy("place"))
    return materialize(ranges.join(before, ["hash", "part"]).select("rid", "hash", (F.col("before") + inside - 1).alias("at")), "ranked")


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(rid, lines): for each row (by hash of doc_id and text) that loses any, the places of the lines it loses."""
    each = _read(docs, doc_id, text, min_block_words)
    # written and read again, so that the joins below deal both sides out themselves and a frequent key's rows can be split
    twins = materialize(each.where("copy is not null").groupBy("copy").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select("copy", F.col("first.rid").alias("early")), "first-copies")
    copies = materialize(each.select("rid", "copy", F.size("words").alias("n")).join(twins, "copy").where("rid <> early").select("rid", "n"), "copies")
    held = each.join(copies, "rid", "left_anti").select("rid", "place", F.explode(F.array_distinct("keys")).alias("hash"))
    first = materialize(held.groupBy("hash").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select("hash", "n", F.col("first.rid").alias("early")), "first-holders")
    rare = held.join(first.where(F.col("n") <= RARE).select("hash"), "hash").groupBy("hash").agg(F.sort_array(F.collect_list("place")).alias("p"))
    every = F.expr("flatten(transform(sequence(1, size(p) - 1), k -> transform(slice(p, 1, k), e -> struct(p[k].rid as rid, e.rid as early))))")
    frequent = held.select("rid", "hash").join(first.where(F.col("n") > RARE), "hash").where("rid <> early").select("rid", "early")
    tried = materialize(rare.select(F.explode(every).alias("x")).select("x.*").unionByName(frequent).distinct(), "pairs")
    lost = materialize(_lost(tried, each, min_block_words), "lost")
    todo = _untried(each, tried, lost).join(first.where(F.col("n") > RARE), "hash").where("rid <> early").select("rid", "hash")
    todo = materialize(todo, "untried")
    ranked = _ranked(held.join(todo.select("hash").distinct(), "hash", "left_semi"))
    todo = materialize(todo.join(ranked, ["rid", "hash"]).where("at > 1"), "untried")
    begin, many = 1, ROUND_GROWTH
    while not todo.isEmpty():
        each_try = todo.select("rid", "hash", F.explode(F.sequence(F.lit(begin), F.least(F.lit(begin + many), "at") - 1)).alias("at"))
        pairs = each_try.join(ranked.withColumnRenamed("rid", "early"), ["hash", "at"]).select("rid", "early").distinct()
        pairs = materialize(pairs.join(tried, ["rid", "early"], "left_anti"), "pairs")
        lost, tried = lost.unionByName(materialize(_lost(pairs, each, min_block_words), "lost")), tried.unionByName(pairs)
        begin, many = begin + many, many * ROUND_GROWTH
        later = todo.where(F.col("at") > begin)
        todo = materialize(later.join(_untried(each, later, lost), ["rid", "hash"], "left_semi"), "untried")
    gone = lost.groupBy("rid").agg(F.collect_set("line").alias("lines"))
    return gone.unionByName(copies.select("rid", F.sequence(F.lit(0), F.col("n") - 1).alias("lines")))


def _untried(each: DataFrame, of: DataFrame, lost: DataFrame) -> DataFrame:
    """(rid, hash): the windows of the documents in ``of`` of which a line is left."""
    met = each.join(of.select("rid").distinct(), "rid", "left_semi").where(F.size("keys") > 0)
    gone = lost.groupBy("rid").agg(F.collect_set("line").alias("lines"))
    return met.select("rid", "keys", "starts", "ends").join(gone, "rid", "left").select("rid", "keys", "starts", "ends", "lines").mapInArrow(_open, "rid binary, hash long")


def _lost(pairs: DataFrame, each: DataFrame, least: int) -> DataFrame:
    """(rid, line): what the later documents of ``pairs`` (rid, early) lose."""
    sides = each.select("rid", F.col("hashes").alias("later"), "words")
    joined = pairs.join(sides, "rid").join(each.select(F.col("rid").alias("early"), F.col("hashes").alias("earlier")), "early")
    return joined.select("rid", "later", "words", "earlier").mapInArrow(partial(_align, least=least), "rid binary, line int").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with the text of each row less the lines that an earlier document has, and lines_before, lines_deleted.

    A row that loses nothing keeps its text to the byte; an exact copy of an earlier document, however short, keeps an empty text. Rows
    that repeat doc_id and text are one document and don't delete each other's lines. Null text stays null (0 lines
    deleted). A null doc_id is later than any other. No rows: none. Columns lines_before and lines_deleted are replaced
    if ``docs`` has them; all others, whatever their names, pass unread."""
    gone = deletions(docs, doc_id, text, min_block_words).select("rid", F.col("lines").alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")  # so that no column's name meets those of this join
    met = docs.select(row, _row_id(F.col(doc_id), F.col(text)).alias("rid")).join(gone, "rid", "left")
    whole = F.col(f"r.`{text}`")
    met = met.withColumn("lines", F.split(whole, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    others = [c for c in docs.columns if c not in ("lines_before", "lines_deleted")]
    out = [F.when(F.col("gone").isNull(), whole).otherwise(left).alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in others]
    return met.select(*out, F.coalesce(F.size("lines"), F.lit(0)).alias("lines_before"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_deleted"))
