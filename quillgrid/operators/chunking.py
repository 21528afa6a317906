"""Token windows over documents (W1) and structure-aware chunks (W2, W3, W11), with exact character offsets."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.sources.tables import bounded_batches

SIZE, OVERLAP = 200, 20


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")


def chunk_fixed(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, position, token_start, token_end, token_count, char_start, char_end, text), a row a window. Native throughout.

    A text is cut into tiles (a token with the white space before it) once; a window's own tiles, joined, give its text
    and length, so what is handed on is little more than the text, however long it is."""
    check_window(size, overlap)
    step = size - overlap
    cut = docs.select(F.col(key).alias(key), X.tiles(F.col(text)).alias("_tiles")).withColumn("_n", F.size("_tiles")).where("_n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / F.lit(step))).cast("int")
    joined = lambda a, n: F.array_join(F.slice("_tiles", a + 1, n), "")
    sizes = F.transform(F.sequence(F.lit(0), last), lambda p: F.length(joined(p * step, F.lit(step))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    before = F.aggregate(sizes, start, lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["before"], a["total"]).alias("before")))["before"]
    pieces = F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(p.alias("position"), joined(p * step, F.lit(size)).alias("piece")))
    windows = F.zip_with(pieces, before, lambda w, b: F.struct(w["position"].alias("position"), w["piece"].alias("piece"), b.alias("before")))
    rows = cut.select(key, "_n", F.explode(windows).alias("_w")).select(key, "_n", "_w.*")
    gap = F.length(F.regexp_extract("piece", rf"^{X.SPACE}*", 0))
    rows = rows.withColumns({"token_start": F.col("position") * step, "token_end": F.least(F.col("position") * step + size, F.col("_n")), "_gap": gap})
    return rows.select(key, "position", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("token_count"), (F.col("before") + F.col("_gap")).alias("char_start"), (F.col("before") + F.length("piece")).alias("char_end"), F.expr("substring(piece, _gap + 1)").alias("text"))


_TOKEN = re.compile(r"\w+|[^\w\s]")
# The patterns of places where a text may be cut, best first (heading, blank line, sentence, line).
_LEVELS = [
    re.compile(r"(?m)(?=^#{1,6}[ \t]+\S)"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"(?<=[.!?])(?:[ \t]+|\n+)"),
    re.compile(r"\n+"),
]


def _cuts(text: str, starts: list[int]) -> list[list[int]]:
    levels = []
    for pattern in _LEVELS:
        places = {bisect_left(starts, m.end()) for m in pattern.finditer(text)}
        levels.append(sorted(p for p in places if 0 < p < len(starts)))
    return levels


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(token_start, token_end, char_start, char_end) of each chunk of a text."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    levels, budget, units = _cuts(text, [s for s, _ in spans]), size - overlap, []
    open_ = [(0, len(spans), 0)]
    while open_:
        a, b, level = open_.pop()
        if b - a <= budget:
            units.append((a, b))
        elif level == len(levels):
            units += [(p, min(p + budget, b)) for p in range(a, b, budget)]
        else:
            points = [a, *(p for p in levels[level] if a < p < b), b]
            open_ += [(p, q, level + 1) for p, q in reversed(list(zip(points, points[1:], strict=False)))]
    chunks, (first, last) = [], units[0]
    for _, end in units[1:]:
        if end - first > size:
            chunks.append((first, last))
            first = max(0, last - overlap)
        last = end
    chunks.append((first, last))
    return [(a, b, spans[a][0], spans[b - 1][1]) for a, b in chunks]


def _recursive(batches: Iterator[pd.DataFrame], size: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, n, a, b, b - a, c, d, text[c:d]) for key, text in zip(batch["key"], batch["text"], strict=True) if isinstance(text, str) for n, (a, b, c, d) in enumerate(recursive_spans(text, size, overlap))]
        yield pd.DataFrame(rows, columns=["key", "position", "token_start", "token_end", "token_count", "char_start", "char_end", "text"])


def chunk_recursive(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """As :func:`chunk_fixed`, cut at headings, paragraphs, sentences and lines where they fit."""
    check_window(size, overlap)
    kind = docs.schema[key].dataType.simpleString()
    made = bounded_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(partial(_recursive, size=size, overlap=overlap), f"key {kind}, position int, token_start int, token_end int, token_count int, char_start int, char_end int, text string")
    return made.withColumnRenamed("key", key)


def document_rollup(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """A2: chunk_count and token_count (the largest token_end) of every document; 0 without chunks."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.max("token_end").alias("token_count"))
    return docs.join(counts, key, "left").select(key, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("token_count", F.lit(0)).alias("token_count"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Sizes of chunks; p95 is the nearest rank."""
    n = F.col("token_count")
    return chunks.agg(F.count("*").alias("chunks"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean_tokens"), F.median(n).cast("double").alias("median_tokens"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY token_count)").cast("long").alias("p95_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))
