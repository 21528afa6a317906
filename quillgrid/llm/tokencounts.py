"""Token counts by section, attributed over offsets.

A whole document is encoded once. Its tokens are spans that tile the text (a byte-level vocabulary loses nothing), its
sections are spans too; a search over the sorted bounds joins the two. A token that crosses a section's bound goes by a
stated rule: to the section that holds most of its bytes, the earlier one of equals (``majority``), or to the one that
holds its first byte (``start``). So the sections of a document always add up to the document's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_batches
from quillgrid.llm.encoding import byte_tokens, clean, tokenizer_path

RULES = ("majority", "start")
OUT = "key long, section int, start long, n_chars long, n_tokens long, n_crossing long"


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a bound; both sorted ends tile the same bytes from 0."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    own, crossing = first.copy(), np.flatnonzero(last > first)
    if rule == "majority":
        for t in crossing:
            bounds = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [token_ends[t]]])
            own[t] = first[t] + int(np.argmax(np.diff(bounds)))
    n = len(section_ends)
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def sections_of(text: str, separator: str = "\n") -> list[str]:
    """A section ends behind its separator; the last has none. An empty text is one empty section."""
    parts = text.split(separator)
    return [p + separator for p in parts[:-1]] + parts[-1:]


def _count(batches: Iterator[pa.RecordBatch], path: str, fields: list[str] | None, rule: str) -> Iterator[pa.RecordBatch]:
    tokens = byte_tokens(path)
    for batch in batches:
        if fields is None:
            cut = [sections_of(clean(x)) for x in batch.column("text").to_pylist()]
        else:
            cut = [[clean(x) for x in row] for row in zip(*(batch.column(f).to_pylist() for f in fields), strict=True)]
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for row, (parts, ids) in enumerate(zip(cut, tokens.encode_all(map("".join, cut)), strict=True)):
            n = len(parts)
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n)
            ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts), dtype=np.int64, count=n))
            counts, crossing = attribute(np.cumsum(tokens.lengths[ids]), ends, rule) if len(ids) else (np.zeros(n, int), np.zeros(n, int))
            for column, values in zip(columns, (np.full(n, row), np.arange(n), np.cumsum(sizes) - sizes, sizes, counts[:n], crossing[:n]), strict=True):
                column.append(values)
        if cut:
            row, section, *rest = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(section, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)], ["key", "section", "start", "n_chars", "n_tokens", "n_crossing"])


def token_counts(docs: DataFrame, key: str, text: str | None = None, fields: list[str] | None = None, tokenizer: str = "byte_bpe_50k.tiktoken", rule: str = "majority") -> DataFrame:
    """(key, section, start, n_chars, n_tokens, n_crossing) for each line of ``text``, or for each of ``fields`` taken as one
    document in a row. start and n_chars are in characters.

    Null text or field counts as empty. An empty text is one section without tokens. A null key stays null, a repeated row
    gives repeated rows, an empty table none. Texts are encoded whole, whatever their length. Other columns are not read."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if (text is None) == (fields is None):
        raise ValueError("give text or fields")
    names = None if fields is None else [f"f{i}" for i in range(len(fields))]
    columns = [F.col(text).alias("text")] if fields is None else [F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)]
    return bounded_batches(docs).select(F.col(key).cast("long").alias("key"), *columns).mapInArrow(partial(_count, path=tokenizer_path(tokenizer), fields=names, rule=rule), OUT)
