"""Documents whose sets of word shingles have a Jaccard similarity of at least 80 %, joined over signature trees.

A document's set is that of its distinct 5-word shingles, by 64-bit hashes; documents of equal sets are one class, joined once.
Two classes that link share a token among the rarest fifth of each, in any order of all tokens that both keep (``prefix``). The
order here is by how often tokens occur, counted over all documents in a table of fixed size (tokens share its counters, so
the order is a guess at rarity; the result doesn't hang on it). So each token that two classes have in their prefixes is a
tree: its members, sorted by size and cut into leaf nodes of at most LEAF. A member's signature is a bitmap of its tokens; a
node holds the OR of its members' bitmaps, the range of their sizes and that of their components. Two nodes are traversed
together, downwards from their roots: of one member each, no more tokens can be common than bits that both bitmaps have, and
tokens that share a bit; where that is less than their sizes need, or the sizes are too far apart, or all members already are
one component, the pair of nodes is left. Pairs of members that remain are verified by their whole sets.

Tokens meet in one shuffle, where those of one class only are left; tokens of the same members are one tree, of that weight.
Two classes have no more tokens in common than follow the first of these in the order, itself included. So where a tree's first
token stands late in a member's prefix, only smaller members can be its partners there (``partner_size``): members that have none
are left before their signatures are fetched. A pair that links is found in the tree of its first common token.
Only components are asked for. First each class is compared with the heads of the trees that it shares most with (a tree's head
is the member that shares most tokens at all), so that large groups of near copies become one component without their pairs;
then trees whose members are one component are dropped. Walks give the best pairs of each member, TAKE, 8 TAKE, 64 TAKE, ... in
rounds; between rounds what was linked becomes one component. A round that gave all pairs of its walks is the last: mostly the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_batches, materialize
from quillgrid.llm.graph import connected_components

WORDS = 5
LIKE = (4, 5)  # a similarity of 80 %
COUNTERS = 1 << 18  # of the table of token frequencies
BITS = 1 << 14  # of a signature, at most
LEAF = 256  # members of a leaf node
HELD = 8192  # pairs of one class that are verified in a task
SIEVE = 1 << 23  # bits of a filter that goes ahead of a join
FEW = 10_000  # pairs of leaf nodes whose numbers may be broadcast
TAKE = 16  # pairs of a member that the first walk gives
PAIRS = 4096  # pairs of nodes that are looked at together
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; with fewer words that of the whole sequence; without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not tokens:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    k = min(words, len(tokens))
    made = np.full(len(tokens) - k + 1, k, np.uint64)
    for i in range(k):
        made = (made ^ (made >> np.uint64(29))) * _ODD[i % len(_ODD)] + hashed[i : len(tokens) - k + 1 + i]
    made = (made ^ (made >> np.uint64(32))) * _ODD[1]
    made = np.sort(made ^ (made >> np.uint64(29)))
    return made[np.concatenate([[True], made[1:] != made[:-1]])]


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(int.from_bytes(whole[i : i + 8], "little", signed=True) for i in (0, 8))


_COUNTED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_COUNTED_SQL = "doc_id long, h1 long, h2 long, n long, part int, counts binary"
_PART = 1 << 14  # counters of a row


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row a document with its set's identity and size; at last the task's counters, some to a row."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        ids = []
        for text in batch.column("text"):
            tokens = shingles(text.as_py(), words)
            np.add.at(counts, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            ids.append((*_identity(tokens), len(tokens)))
        h1, h2, n = (pa.array(c, pa.int64()) for c in (zip(*ids, strict=True) if ids else ([], [], [])))
        none = pa.nulls(len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), h1, h2, n, none.cast(pa.int32()), none.cast(pa.binary())], schema=_COUNTED)
    for i, some in enumerate(counts.reshape(-1, min(_PART, COUNTERS))):
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([i], pa.int32()), pa.array([some.tobytes()], pa.binary())], schema=_COUNTED)


def _summed(rows: pa.Table) -> pa.Table:
    total = np.zeros(min(_PART, COUNTERS), np.int64)
    for batch in rows["counts"].to_pylist():
        total += np.frombuffer(batch, np.int64)
    return pa.table({"part": rows["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def prefix_length(n: int) -> int:
    """So many tokens of a set of n, in an order that is the same for all, that any set like it has one of its own prefix among them."""
    return n - -(-LIKE[0] * n // LIKE[1]) + 1 if n else 0


def prefix(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the order of how often tokens are met."""
    order = np.lexsort((tokens, counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return tokens[order[: prefix_length(len(tokens))]]


def partner_size(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest set that one of n tokens can be like, if the first token in common is its at-th, from 0, in the order."""
    return ((LIKE[0] + LIKE[1]) * (n - at)) // LIKE[0] - n


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens, of a power of two of bits, eight for each token at least while that is at most BITS."""
    width = min(BITS, max(64, 1 << (8 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[((tokens >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _packed(bitmap: np.ndarray) -> bytes:
    """A bitmap as it is kept and shuffled: seven of eight bits are 0, so Huffman's codes nearly halve it."""
    made = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return made.compress(bitmap.tobytes()) + made.flush()


def _unpacked(packed: bytes | pa.Buffer) -> bytes:
    return zlib.decompress(packed, -15)


def _prefixed(batches: Iterator[pa.RecordBatch], words: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py(), words) for t in batch.column("text")]
        first = [prefix(s, counts) for s in sets]
        ids = [_identity(s) for s in sets]
        values = pa.array(np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array([i for i, _ in ids], pa.int64()), pa.array([i for _, i in ids], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array([_packed(signature(s)) for s in sets], pa.binary())], ["key", "doc_id", "h1", "h2", "n", "prefix", "bitmap"])


def _whole(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py(), words) for t in batch.column("text")]
        same = np.array([_identity(s) == (a, b) for s, a, b in zip(sets, batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)], dtype=bool)
        at = np.flatnonzero(same)
        yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(at)), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["cls", "tokens"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether two sets are alike, by all their tokens."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(a) + len(b) - len(np.union1d(a, b)) if len(a) and len(b) else 0
            good.append(common > 0 and LIKE[1] * common >= LIKE[0] * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])


class Nodes:
    """A binary tree over the members of a leaf node: level 0 holds the members, each level above the ORs of two nodes."""

    def __init__(self, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, bitmaps: list[bytes], words: int):
        order = np.lexsort((cls, n, comp))  # members of a component lie together, so that nodes of one are left early
        self.cls = cls[order]
        bits = np.empty((len(cls), words), np.uint64)
        for at, i in enumerate(order.tolist()):
            own = np.frombuffer(bitmaps[i], np.uint64)
            bits[at] = np.bitwise_or.reduce(own.reshape(-1, words), axis=0)  # wider ones are folded onto the narrowest
        excess = n[order] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n[order], n[order], excess, comp[order], comp[order])]
        while len(self.levels[-1][0]) > 1:
            bits, small, large, excess, first, last = self.levels[-1]
            starts = np.arange(0, len(bits), 2)
            over = lambda f, x: f.reduceat(x, starts, axis=0)
            self.levels.append((over(np.bitwise_or, bits), over(np.minimum, small), over(np.maximum, large), over(np.maximum, excess), over(np.minimum, first), over(np.maximum, last)))


def walk(a: Nodes, b: Nodes, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member of a, member of b, most tokens they can have in common) of the pairs that may link; each pair of one tree once.

    ``seen`` gets the number of node pairs looked at on each level."""
    same, (num, den) = a is b, LIKE
    level = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        keep, bound = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        if seen is not None:
            seen.append(len(i))
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            fits = (den * la[2][x] >= num * lb[1][y]) & (den * lb[2][y] >= num * la[1][x])
            fits &= (la[4][x] != la[5][x]) | (lb[4][y] != lb[5][y]) | (la[4][x] != lb[4][y])
            some = np.flatnonzero(fits)
            x, y = x[some], y[some]
            most = np.bitwise_count(la[0][x] & lb[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(la[3][x], lb[3][y])
            good = most * (num + den) >= num * (la[1][x] + lb[1][y])
            keep[at + some[good]], bound[at + some[good]] = True, most[good]
        i, j, bound = i[keep], j[keep], bound[keep]
        if level == 0:
            return i, j, bound
        level -= 1
        sizes = [len(t.levels[level][0]) if level < len(t.levels) else 0 for t in (a, b)]
        down = [np.stack([2 * k, 2 * k + 1]) if size else np.stack([k, k + (1 << 62)]) for k, size in ((i, sizes[0]), (j, sizes[1]))]
        x, y = (np.concatenate(c) for c in zip(*((down[0][p], down[1][q]) for p in (0, 1) for q in (0, 1)), strict=True))
        real = (x < (sizes[0] or 1 << 62)) & (y < (sizes[1] or 1 << 62))
        if same:
            real &= (x < y) if level == 0 else (x <= y)
        i, j = x[real], y[real]


def _met_by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by tree and size those that may have a partner there; and the first and last of the range.

    A larger partner isn't smaller than the next member, a smaller one not larger than the one before; and no partner of a member
    is larger than its ``partner_size``, of which the largest so far is kept."""
    num, den = LIKE
    held, before, reach = None, True, 0  # the last row waits for the next; whether it has a smaller partner; how far those of its tree reach
    unknown = None  # the tree that the range begins with: what earlier ranges hold of it isn't known
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not rows or not len(rows[0]):
            continue
        tree, n, at = (rows[0].column(c).to_numpy() for c in ("tree", "n", "at"))
        most = partner_size(n, at)
        if held is None:
            unknown = tree[0]
        else:
            most[0] = max(most[0], reach)
        starts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        so_far = np.concatenate([np.maximum.accumulate(part) for part in np.split(most, starts[1:])]) if len(starts) < len(tree) else most
        same = tree[1:] == tree[:-1]
        smaller = same & (den * n[:-1] >= num * n[1:]) & ((so_far[:-1] >= n[1:]) | (tree[1:] == unknown))
        larger = same & (n[1:] <= partner_size(n, at)[:-1])
        left, right = np.concatenate([[before], smaller]), np.concatenate([larger, [False]])
        yield rows[0].slice(0, len(tree) - 1).filter(pa.array((left | right)[:-1], pa.bool_()))
        held, before, reach = rows[0].slice(len(tree) - 1), bool(left[-1]), int(so_far[-1])
    if held is not None:
        yield held


def _numbered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Members sorted by tree and size with the number of their leaf node, of one tree and at most ``limit`` members."""
    number, last, place = TaskContext.get().partitionId() << 36, None, 0
    for batch in batches:
        if not len(batch):
            continue
        tree = batch.column("tree").to_numpy()
        starts = np.flatnonzero(np.concatenate([[tree[0] != last], tree[1:] != tree[:-1]]))
        at = np.arange(len(tree)) + place
        firsts = np.searchsorted(starts, np.arange(len(tree)), side="right")
        at = np.where(firsts > 0, np.arange(len(tree)) - starts[firsts - 1], at) if len(starts) else at
        leaf = number + np.cumsum(at % limit == 0)
        number, last, place = int(leaf[-1]), tree[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("tree", "cls", "comp", "n"))], ["leaf", "tree", "cls", "comp", "n"])


def _places(member: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The place, from 0, of each pair among those of its member, the most tokens in common first."""
    order = np.lexsort((-bound, member))
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(member[order]) != 0])) if len(member) else np.empty(0, np.int64)
    places = np.empty(len(member), np.int64)
    places[order] = np.arange(len(member)) - np.repeat(firsts, np.diff(np.append(firsts, len(member))))
    return places


def _met(batches: Iterator[pa.RecordBatch], other: bool, take: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of classes: of each leaf node within itself, or of a leaf node and an ``other``. Pairs are given that are
    one of the ``take`` best of a member; ``more``: whether there are others."""
    for batch in batches:
        for row in batch.to_pylist():
            sides = [{k: row[s + k] for k in ("cls", "comp", "n", "bitmaps")} for s in (("", "o_") if other else ("",))]
            for side in sides:
                side["bitmaps"] = [_unpacked(m) for m in side["bitmaps"]]
            words = min(len(m) // 8 for s in sides for m in s["bitmaps"])
            trees = [Nodes(*(np.array(s[k], np.int64) for k in ("cls", "comp", "n")), s["bitmaps"], words) for s in sides]
            i, j, bound = walk(trees[0], trees[-1])
            if len(i):
                a, b = trees[0].cls[i], trees[-1].cls[j]
                ends, twice = np.concatenate([a, b]), np.concatenate([bound, bound])
                best = (_places(ends, twice) < take).reshape(2, -1).any(axis=0)
                more, a, b, bound = bool((~best).any()), a[best], b[best], bound[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["tree"])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bound), pa.array(np.full(len(a), more))], ["tree", "a", "b", "bound", "more"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps and sizes let them be alike."""
    num, den = LIKE
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            (m, a), (n, b) = ((v["n"].as_py(), np.frombuffer(_unpacked(v["bitmap"].as_buffer()), np.uint64)) for v in (x, y))
            words = min(len(a), len(b))
            a, b = (np.bitwise_or.reduce(v.reshape(-1, words), axis=0) for v in (a, b))
            ones = [int(np.bitwise_count(v).sum()) for v in (a, b, a & b)]
            good.append((num + den) * min(ones[2] + min(m - ones[0], n - ones[1]), m, n) >= num * (m + n))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])


def _paired(pairs: DataFrame, held: DataFrame, value: Column) -> DataFrame:
    """(a, b, x, y): the pairs with ``value`` of each of their classes. A class of many pairs meets them in several tasks, HELD each."""
    fan = pairs.groupBy(F.col("a").alias("one")).agg(F.ceil(F.count("*") / HELD).alias("shares"))
    dealt = pairs.join(fan, pairs.a == fan.one).select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    shared = held.select(F.col("cls").alias("one"), value.alias("x")).join(fan, "one").select("one", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("part"))
    half = dealt.join(shared, (dealt.a == shared.one) & (dealt.share == shared.part)).select("a", "b", "x")
    return half.join(held.select(F.col("cls").alias("two"), value.alias("y")), F.col("b") == F.col("two")).select("a", "b", "x", "y")


def _sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose long ``key`` isn't one of ``wanted``'s: a filter of SIEVE bits, one row whatever the
    number of keys. It spares a shuffle of rows that a join would drop; the join must follow."""
    word, bit = F.expr(f"pmod({key}, {SIEVE}L) div 64"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64L) as int))")
    marked = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    full = wanted.sparkSession.range(SIEVE // 64).withColumnRenamed("id", "word").join(marked, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    sieve = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("sieve"))
    return rows.crossJoin(F.broadcast(sieve)).where(F.get("sieve", word.cast("int")).bitwiseAND(bit) != 0).select(*rows.columns)


def _token_sets(given: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the classes of ``pairs``, cut from one text of each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = materialize(classes.join(ends, "cls").select("cls", "key", "h1", "h2"), "wanted")
    texts = _sieved(given.select("key", "text"), "key", wanted).groupBy("key").agg(F.first("text").alias("text"))  # rows may be repeated
    return materialize(texts.join(wanted, "key").select("cls", "h1", "h2", "text").mapInArrow(partial(_whole, words=words), "cls long, tokens binary"), "sets")


def _verify(pairs: DataFrame, given: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(a, b) of the pairs that link, by whole sets."""
    sets = _token_sets(given, classes, pairs, words)
    return _paired(pairs, sets, F.col("tokens")).mapInArrow(_verified, "a long, b long, linked boolean").where("linked").select("a", "b")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))


def _tagged(rows: DataFrame, comps: DataFrame, cls: str = "cls", comp: str = "comp") -> DataFrame:
    """``rows`` with the component of each class; a class without links is its own."""
    named = comps.select(F.col("cls").alias(cls), F.col("comp").alias(comp))
    return rows.join(named, cls, "left").withColumn(comp, F.coalesce(comp, cls))


def shared_tokens(classes: DataFrame) -> DataFrame:
    """(tree, cls, n, weight, at): the members of each tree. A tree stands for ``weight`` tokens, shared by the same classes; the
    first of them is the at-th of the member's prefix.

    classes: cls, n, prefix. Tokens are shuffled once; that a token has one class only shows where its rows have met."""
    tokens = classes.select("cls", F.posexplode("prefix").alias("at", "token"))
    met = Window.partitionBy("token")
    known = {"many": F.count("*").over(met), "x1": F.bit_xor(F.xxhash64("cls")).over(met), "x2": F.bit_xor(F.xxhash64("cls", F.lit(1))).over(met)}
    trees = tokens.withColumns(known).where("many > 1").groupBy(F.xxhash64("many", "x1", "x2").alias("tree"), "cls").agg(F.count("*").alias("weight"), F.min("at").alias("at"))
    return trees.join(classes.select("cls", "n"), "cls").select("tree", "cls", "n", "weight", "at")


def candidates(members: DataFrame, comps: DataFrame, classes: DataFrame, take: int) -> DataFrame:
    """(tree, a, b, bound, more): pairs of classes of different components that the trees let through, the ``take`` best of each
    class in a walk; ``more``: whether the walk has others. members: tree, cls, n, at."""
    whole = Window.partitionBy("tree")
    tagged = _tagged(members.select("tree", "cls", "n", "at"), comps).withColumns({"first": F.min("comp").over(whole), "last": F.max("comp").over(whole)})
    own = materialize(tagged.where("first < last").select("tree", "cls", "comp", "n", "at"), "members")
    order = ["tree", "n", "cls"]
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitting = own.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_met_by_size, "tree long, cls long, comp long, n long, at int")
    numbered = materialize(fitting.mapInArrow(partial(_numbered, limit=LEAF), "leaf long, tree long, cls long, comp long, n long"), "numbered")
    figures = [f(c).alias(name) for f, c, name in ((F.first, "tree", "tree"), (F.min, "n", "small"), (F.max, "n", "large"), (F.min, "comp", "first"), (F.max, "comp", "last"))]
    body = ("cls", "comp", "n", "bitmaps")
    signed = numbered.join(classes.select("cls", "bitmap"), "cls").groupBy("leaf").agg(*figures, F.collect_list(F.struct("cls", "comp", "n", F.col("bitmap").alias("bitmaps"))).alias("m"))  # LEAF at most
    leaves = materialize(signed.select("leaf", "tree", "small", "large", "first", "last", *[F.col(f"m.{c}").alias(c) for c in body]), "leaves")
    made = "tree long, a long, b long, bound long, more boolean"
    inner = leaves.where("first < last").mapInArrow(partial(_met, other=False, take=take), made)
    # pairs of leaf nodes of one tree, by their ranges of sizes and components first; then their members
    names = leaves.select("tree", "leaf", "small", "large", "first", "last")
    other = names.select("tree", *[F.col(c).alias(f"o_{c}") for c in ("leaf", "small", "large", "first", "last")])
    num, den = LIKE
    near = (F.col("leaf") < F.col("o_leaf")) & (den * F.col("large") >= num * F.col("o_small")) & (den * F.col("o_large") >= num * F.col("small"))
    apart = (F.col("first") != F.col("last")) | (F.col("o_first") != F.col("o_last")) | (F.col("first") != F.col("o_first"))
    pairs = materialize(names.join(other, "tree").where(near & apart).select("leaf", "o_leaf"), "leaf-pairs")
    many = pairs.count()
    if not many:
        return materialize(inner, "candidates")
    ends = pairs.select(F.explode(F.array("leaf", "o_leaf")).alias("leaf")).distinct()
    if many <= FEW:  # of most trees there is one leaf node only
        leaves = leaves.join(F.broadcast(ends), "leaf", "left_semi")
    left, right = leaves.select("leaf", "tree", *body), leaves.select(F.col("leaf").alias("o_leaf"), *[F.col(c).alias(f"o_{c}") for c in body])
    outer = pairs.join(left, "leaf").join(right, "o_leaf").mapInArrow(partial(_met, other=True, take=take), made)
    return materialize(inner.unionByName(outer), "candidates")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Null texts and texts without words have no shingles and link with nothing, also not with one another: their component is
    their own doc_id. A component is that of the smallest doc_id in it. Repeated rows give repeated rows; rows of one doc_id with
    different texts are judged each by its own. A null doc_id stays null and gets the component of what it links with, which is
    null where no row there has a doc_id. An empty table gives no rows. Other columns, whatever their names, are not read."""
    given = bounded_batches(docs).select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = materialize(given.select("doc_id", "text").mapInArrow(partial(_counted, words=words), _COUNTED_SQL), "counted")
    rows = counted.where("part is null").select("doc_id", "h1", "h2", "n")
    parts = counted.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_summed, "part int, counts binary")
    counts = np.zeros((-(-COUNTERS // _PART), min(_PART, COUNTERS)), np.int64)
    for r in parts.collect():  # COUNTERS numbers
        counts[r.part] = np.frombuffer(r.counts, np.int64)
    prefixed = given.mapInArrow(partial(_prefixed, words=words, counts=counts.ravel()), "key long, doc_id long, h1 long, h2 long, n long, prefix array<long>, bitmap binary")
    each = prefixed.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "bitmap")])
    classes = materialize(each.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = materialize(shared_tokens(classes), "shared")
    # each class with the heads of the trees that it shares most with: what others were copied from has most tokens shared
    ranked = members.join(members.groupBy("cls").agg(F.sum("weight").alias("held")), "cls")
    heads = ranked.groupBy("tree").agg(F.max(F.struct("held", -F.col("cls"), "n", "at")).alias("head")).select("tree", (-F.col("head.col2")).alias("head"), F.col("head.n").alias("head_n"), F.col("head.at").alias("head_at"))
    num, both = LIKE[0], sum(LIKE)
    fits = both * F.least(F.col("n") - F.col("at"), F.col("head_n") - F.col("head_at")) >= num * (F.col("n") + F.col("head_n"))  # in the tree of their first common token
    stars = members.join(heads, "tree").where("cls <> head").groupBy("head", "cls").agg(F.sum("weight").alias("many"), F.bool_or(fits).alias("fits")).where("fits")
    best = Window.partitionBy("cls").orderBy(F.desc("many"), "head")
    most = stars.withColumn("at", F.row_number().over(best)).where("at <= 2").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    hopeful = _paired(materialize(most, "stars"), classes, F.struct("n", "bitmap")).mapInArrow(_plausible, "a long, b long, linked boolean").where("linked").select("a", "b")
    hopeful = materialize(hopeful, "stars")
    found = materialize(_verify(hopeful, given, classes, words), "links")
    comps = _components(found)
    # the best pairs of each class first: what they link, the next walk leaves
    tried, take, own = hopeful.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), TAKE, members
    while True:
        met = candidates(own, comps, classes, take)
        place = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("bound"), "a", "b"))
        open_ = met.groupBy("a", "b").agg(F.max("bound").alias("bound")).join(tried, ["a", "b"], "left_anti").withColumns({"at_a": place("a"), "at_b": place("b")})
        judged = materialize(open_.select("a", "b", ((F.col("at_a") <= take) | (F.col("at_b") <= take)).alias("chosen")), "open")
        chosen, later = judged.where("chosen").select("a", "b"), not judged.where("not chosen").isEmpty()
        if not chosen.isEmpty():
            found = materialize(found.unionByName(_verify(chosen, given, classes, words)), "links")
            comps = _components(found)
        more = met if later else met.where("more")
        if more.isEmpty():
            break  # each pair that a walk let through was verified
        tried = materialize(tried.unionByName(chosen), "tried")
        own = own.join(more.select("tree").distinct(), "tree", "left_semi")  # other trees had no pair left
        take *= 8
    placed = materialize(_tagged(classes.select("h1", "h2", "cls", "least"), comps), "placed")
    by_set = placed.join(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("h1", "h2", "component_id")
    full = rows.where("n > 0").join(by_set, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)
