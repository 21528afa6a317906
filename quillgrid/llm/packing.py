"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document is the ids of its text and an end id; one longer than a sequence is cut into full pieces and a rest. Full
pieces are sequences of their own. The others are dealt by hash into shards of a bounded number of pieces; each shard is
packed by several islands. An island keeps a small population of packings (lists of bins), seeded by best fit over falling
and over shaken lengths. Crossover injects well-filled bins of one parent into the other whole, takes out the bins that now
hold something twice, opens the loosest, lets displaced pieces change places with shorter ones of bins that have room, and
best-fits the rest, longest first. Between epochs each island's elite migrates to the next island of its shard, by an
equality join.

A shard evolves until it uses no more bins than its tokens need and its free space lies in the few loosest bins. Those are
then opened, and their pieces are packed again together with those of other shards, level by level, until one shard is left:
so the tokens that don't fill a sequence are rounded up once, not once a shard.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_batches, materialize
from quillgrid.llm.encoding import END_ID, clean, tokenizer_path, word_tokens

CAPACITY = 4096
SHARD_PIECES = 4000  # expected pieces of a shard
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 60  # of an epoch, at most
STALE = 15  # generations without a better packing that end an epoch
POPULATION = 6
OPENED = 8  # one in so many of a shard's pieces, at most, is packed again on the next level
WAITING = 96  # displaced pieces that are tried for exchange at once
SPARE = 1e-4  # share of a shard's capacity that may stay free in the bins that aren't opened

Bin = tuple[int, list[int]]  # tokens used, pieces
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens, end = word_tokens(path), np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows, columns = [], ([], [], [], [])
        for row, ids in enumerate(tokens.encode_all(map(clean, batch.column("text").to_pylist()))):
            data = memoryview(ids.astype("<u4").tobytes() + end)
            for piece, start in enumerate(range(0, len(ids) + 1, capacity)):
                own = data[4 * start : 4 * (start + capacity)]
                rows.append(row)
                for column, value in zip(columns, (piece, start, len(own) // 4, zlib.crc32(own)), strict=True):
                    column.append(value)
        made = [pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text is empty: one piece, the end id."""
    read = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(partial(_cut, path=tokenizer_path(tokenizer), capacity=capacity), PIECES)


class Bins:
    """Bins under construction: what is left in each, sorted, for best fit."""

    def __init__(self, capacity: int, start: list[Bin] = ()):
        self.capacity, self.bins, self.used = capacity, [list(b) for _, b in start], [used for used, _ in start]
        self.left = sorted((capacity - used, k) for k, used in enumerate(self.used) if used < capacity)

    def fit(self, item: int, length: int) -> None:
        at = bisect_left(self.left, (length, -1))
        if at == len(self.left):
            left, k = self.capacity, len(self.bins)
            self.bins.append([])
            self.used.append(0)
        else:
            left, k = self.left.pop(at)
        self.bins[k].append(item)
        self.used[k] += length
        if left > length:
            insort(self.left, (left - length, k))

    def made(self) -> list[Bin]:
        return list(zip(self.used, self.bins, strict=True))


def best_fit(order: list[int], lengths: list[int], capacity: int) -> list[Bin]:
    packed = Bins(capacity)
    for i in order:
        packed.fit(i, lengths[i])
    return packed.made()


def bound(lengths: list[int], capacity: int) -> int:
    return math.ceil(sum(lengths) / capacity)


def loosest(bins: list[Bin], pieces: int, capacity: int) -> int:
    """How many bins, the loosest first, are opened for the next level: those with room, that hold ``pieces`` pieces at most."""
    held, n = 0, 0
    for used, items in bins:
        held += len(items)
        if used == capacity or held > pieces:
            break
        n += 1
    return n


def rating(bins: list[Bin], lengths: list[int], capacity: int) -> tuple[int, int, int]:
    """Less is better: bins, what stays free outside the loosest ones, and minus the sum of squared fills."""
    bins = sorted(bins, key=lambda b: b[0])
    n = loosest(bins, len(lengths) // OPENED, capacity)
    return len(bins), sum(capacity - used for used, _ in bins[n:]), -sum(used * used for used, _ in bins)


def settled(rated: tuple[int, int, int], lengths: list[int], capacity: int) -> bool:
    least = bound(lengths, capacity)
    return rated[0] <= least and rated[1] <= SPARE * least * capacity


def _closest(waiting: list[tuple[int, int]], room: int) -> tuple[int, tuple[int, ...]]:
    """(length, places) of the one or two of ``waiting`` (rising) that come nearest to ``room`` without going beyond."""
    k = bisect_right(waiting, (room, math.inf)) - 1
    best, places = (waiting[k][0], (k,)) if k >= 0 else (0, ())
    low, high = 0, k
    while low < high and best < room:
        both = waiting[low][0] + waiting[high][0]
        if both > room:
            high -= 1
        else:
            if both > best:
                best, places = both, (low, high)
            low += 1
    return best, places


def _exchange(bins: list[Bin], loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> tuple[list[Bin], list[int]]:
    """Displaced pieces, one or two at a time, take the places of shorter ones in bins with room, by the swap that fills a bin most."""
    loose = sorted(loose) if len(loose) <= WAITING else rng.sample(sorted(loose), len(loose))
    waiting, out = sorted((lengths[i], i) for i in loose[:WAITING]), []
    for used, items in bins:
        if waiting and used < capacity:
            gain, best = 0, None
            for at, i in enumerate(items):
                length, places = _closest(waiting, lengths[i] + capacity - used)
                if length - lengths[i] > gain:
                    gain, best = length - lengths[i], (at, places)
            if best is not None:
                at, places = best
                i, items = items[at], [*items[:at], *(waiting[k][1] for k in places), *items[at + 1 :]]
                for k in reversed(places):
                    waiting.pop(k)
                insort(waiting, (lengths[i], i))
                used += gain
        out.append((used, items))
    return out, [i for _, i in waiting] + loose[WAITING:]


def crossover(taker: list[Bin], giver: list[Bin], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Well-filled bins of ``giver`` go whole into ``taker``; its bins that share a piece with them, and its loosest, are opened and their pieces find new places."""
    full = [b for b in giver if b[0] >= 0.99 * capacity]
    chosen = rng.sample(full, min(len(full), max(1, len(giver) // rng.choice((4, 8, 16)))))
    inside = {i for _, b in chosen for i in b}
    kept = sorted((b for b in taker if inside.isdisjoint(b[1])), key=lambda b: b[0])
    opened = min(len(kept), max(2, len(taker) // rng.choice((12, 25, 50))))
    if len(kept) > opened and rng.random() < 0.5:  # and one that is well filled
        kept.insert(0, kept.pop(rng.randrange(opened, len(kept))))
        opened += 1
    loose = [i for _, b in taker if not inside.isdisjoint(b) for i in b if i not in inside] + [i for _, b in kept[:opened] for i in b]
    stay, loose = _exchange(kept[opened:], loose, lengths, capacity, rng)
    child = Bins(capacity, chosen + stay)
    for i in sorted(loose, key=lambda i: (-lengths[i] * rng.uniform(0.95, 1.0), i)):
        child.fit(i, lengths[i])
    return child.made()


def evolve(population: list[list[Bin]], lengths: list[int], capacity: int, generations: int, rng: random.Random) -> list[list[Bin]]:
    """The population after some generations, best first, without equal ratings; it ends early when the best is settled or stays the same for long."""
    rated = sorted(((rating(p, lengths, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    count, best, same = len(rated), rated[0][0], 0
    for _ in range(generations):
        same = 0 if rated[0][0] < best else same + 1
        best = rated[0][0]
        if settled(best, lengths, capacity) or same > STALE:
            break
        for _ in range(2):
            (_, _, a), (_, _, b) = rng.choice(rated[: max(2, len(rated) // 2)]), rng.choice(rated)
            child = crossover(a, b, lengths, capacity, rng)
            count += 1
            rated.append((rating(child, lengths, capacity), count, child))
        rated = sorted({r[0]: r for r in sorted(rated, key=lambda x: x[:2], reverse=True)}.values(), key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in rated]


def seeds(lengths: list[int], capacity: int, rng: random.Random) -> list[list[Bin]]:
    """First packings of falling lengths: best fit by falling length, alone if it is settled, and by lengths shaken ever more."""
    first = best_fit(list(range(len(lengths))), lengths, capacity)
    if settled(rating(first, lengths, capacity), lengths, capacity):
        return [first]
    shaken = (sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(low, 1.0)) for low in (0.9, 0.8, 0.6))
    return [first, *(best_fit(order, lengths, capacity) for order in shaken)]


def _genome(bins: list[Bin], n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for k, (_, b) in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(genome: bytes, lengths: list[int]) -> list[Bin]:
    of = np.frombuffer(genome, dtype="<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return [(sum(lengths[i] for i in b), b) for b in bins]


STATE = "shard long, island int, items binary, lengths binary, genomes array<binary>, rated array<long>, generations int, done boolean"


def _state(shard: int, island: int, items: bytes, lengths: list[int], population: list[list[Bin]], capacity: int, generations: int) -> dict:
    rated = rating(population[0], lengths, capacity)
    return {"shard": shard, "island": island, "items": items, "lengths": np.array(lengths, dtype="<i4").tobytes(), "genomes": [_genome(b, len(lengths)) for b in population], "rated": list(rated), "generations": generations, "done": settled(rated, lengths, capacity)}


def _found(shard: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A row for each island of a shard, after its first epoch; one row, if a seed settles it."""
    shard = shard.sort_values(["length", "item"], ascending=[False, True])
    lengths, number = shard["length"].tolist(), int(shard["shard"].iloc[0])
    rows = []
    for island in range(ISLANDS):
        rng = random.Random(f"{number} {island}")
        population = seeds(lengths, capacity, rng)
        alone = len(population) == 1
        if not alone:
            population = evolve(population, lengths, capacity, GENERATIONS, rng)
        rows.append(_state(number, island, shard["item"].to_numpy("<i8").tobytes(), lengths, population, capacity, 0 if alone else 1))
        if rows[-1]["done"]:
            break
    return pd.DataFrame(rows)


def _epoch(batches: Iterator[pd.DataFrame], epoch: int, capacity: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            lengths = np.frombuffer(row["lengths"], dtype="<i4").tolist()
            population = [_bins(g, lengths) for g in [*row["genomes"], *([] if row["migrant"] is None else [row["migrant"]])]]
            best = evolve(population, lengths, capacity, GENERATIONS, random.Random(f"{row['shard']} {row['island']} {epoch}"))
            yield pd.DataFrame([_state(row["shard"], row["island"], row["items"], lengths, best, capacity, row["generations"] + 1)])


def _placed(batches: Iterator[pd.DataFrame], level: int, last: bool, capacity: int) -> Iterator[pd.DataFrame]:
    """(item, length, sequence_id, offset); sequence_id is null for pieces of bins that are opened for the next level."""
    for batch in batches:
        for shard, items, lengths, genomes in zip(batch["shard"], batch["items"], batch["lengths"], batch["genomes"], strict=True):
            items, lengths = np.frombuffer(items, dtype="<i8"), np.frombuffer(lengths, dtype="<i4").tolist()
            bins = sorted(_bins(genomes[0], lengths), key=lambda b: b[0])
            n = 0 if last else loosest(bins, len(lengths) // OPENED, capacity)
            order = np.array([i for _, b in bins for i in b], dtype=np.int64)
            sizes = np.array(lengths, dtype=np.int64)[order]
            starts = np.repeat(np.cumsum([0, *(used for used, _ in bins)])[:-1], [len(b) for _, b in bins])
            bin_of = np.repeat(np.arange(len(bins)), [len(b) for _, b in bins])
            ids = pd.array((np.int64(level) << 56) + (np.int64(shard) << 28) + bin_of, dtype="Int64")
            ids[bin_of < n] = pd.NA
            yield pd.DataFrame({"item": items[order], "length": sizes, "sequence_id": ids, "offset": np.cumsum(sizes) - sizes - starts})


def _pack_level(items: DataFrame, shards: int, level: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(placed, islands): rows of :func:`_placed`, and the last state of each island."""
    spark = items.sparkSession
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), "item", "length")
    state = materialize(dealt.groupBy("shard").applyInPandas(partial(_found, capacity=capacity), STATE), f"packing-{level}-0")
    for epoch in range(1, EPOCHS):
        open_ = state.join(state.where("done").select("shard"), "shard", "left_anti")
        if open_.isEmpty():
            break
        elite = open_.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.get("genomes", F.lit(0)).alias("migrant"))
        width = max(spark.sparkContext.defaultParallelism, min(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        evolved = open_.join(elite, ["shard", "island"], "left").repartition(width, "shard", "island").mapInPandas(partial(_epoch, epoch=epoch, capacity=capacity), STATE)
        state = materialize(evolved.unionByName(state.join(open_.select("shard").distinct(), "shard", "left_anti")), f"packing-{level}-{epoch}")
    best = state.groupBy("shard").agg(F.min(F.struct("rated", "island")).alias("best")).select("shard", "best.island")
    last = shards == 1
    placed = state.join(best, ["shard", "island"]).select("shard", "items", "lengths", "genomes").mapInPandas(partial(_placed, level=level, last=last, capacity=capacity), "item long, length long, sequence_id long, offset long")
    return materialize(placed, f"placed-{level}"), state


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, report: list | None = None) -> DataFrame:
    """(item, sequence_id, offset) for rows (item long and unique, length long <= capacity).

    ``report`` gets a row (level, shards, shards that evolved, epochs) a level."""
    names = ("item", "sequence_id", "offset")
    out = items.where(F.col("length") == capacity).select("item", (F.col("item") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = items.where(F.col("length") < capacity), 0
    n = rest.count()
    while n:
        shards = max(1, round(n / shard_pieces))
        placed, state = _pack_level(rest, shards, level, capacity)
        if report is not None:
            report.append((level, shards, *state.agg(F.count_distinct(F.when(F.col("generations") > 0, F.col("shard"))), F.max("generations")).first()))
        out = out.unionByName(placed.where("sequence_id is not null").select(*names))
        rest, level = placed.where("sequence_id is null").select("item", "length"), level + 1
        n = 0 if shards == 1 else rest.count()
    return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    Null or blank text gives one piece of one id. A null doc_id stays null; repeated rows are packed each by itself; an
    empty table gives no rows. Texts are read once; what is packed are lengths."""
    cut = pieces(docs, doc_id, text, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id())
    kept = materialize(cut, "pieces")
    return kept.join(pack(kept.select("item", "length"), capacity), "item").drop("item")
