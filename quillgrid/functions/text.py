"""Text functions as native columns: tokens with offsets, terms, folding, white space, JSON and citation patterns."""

from __future__ import annotations

import functools
import hashlib
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes that agree with Python's re on str: \w and \s.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\p{{IsWhite_Space}}\x1c-\x1f]"


def tokens(text: Column) -> Column:
    """words, and each other visible character by itself."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """A1. Null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def tiles(text: Column) -> Column:
    """Tokens with the white space before each: joined they give the text up to the end of its last token."""
    return F.regexp_extract_all(text, F.lit(rf"({SPACE}*)({TOKEN})"), F.lit(0))


#: Characters that lower case, sharp s and micro sign apart, may leave unlike Python's fold. What isn't listed is Latin letters up to
#: U+017E but one, and the large ranges without case (Hebrew to Myanmar, Hangul, Ethiopic, Indic, ideographs and kana, emoji).
ODD = r"[^\x{0}-\x{148}\x{14A}-\x{17E}\x{590}-\x{109F}\x{1100}-\x{139F}\x{1400}-\x{1C7F}\x{2000}-\x{20FF}\x{2E80}-\x{A63F}\x{AC00}-\x{FAFF}\x{FE00}-\x{FF20}\x{1F000}-\x{10FFFF}]"


@functools.cache
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """The characters that fold to one other character, and those that fold to several, by Python's own tables."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def _casefold_latin(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))


def _casefold_any(text: Column) -> Column:
    """F3 by the whole table. What folds to several characters goes first; no fold has a character that folds."""
    one, several = folds()
    pairs = F.array(*[F.array(F.lit(c), F.lit(f)) for c, f in several.items()])
    spread = F.when(text.rlike(f"[{''.join(several)}]"), F.aggregate(pairs, text, lambda t, p: F.replace(t, p[0], p[1]))).otherwise(text)
    return F.translate(spread, "".join(one), "".join(one.values()))


def casefold(text: Column) -> Column:
    """as Python folds. Texts without characters that need the table are put in lower case, sharp s as ss, the micro sign as mu."""
    return F.when(text.rlike(ODD), _casefold_any(text)).otherwise(_casefold_latin(text))


def _folded(text: Column, pattern: str) -> Column:
    """All matches, folded. Folding the whole text first is cheaper, and the same where no letter folds to a letter and a mark."""
    each = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _casefold_any)
    return F.when(text.rlike(ODD) | F.contains(text, F.lit("İ")), each).otherwise(F.regexp_extract_all(_casefold_latin(text), F.lit(pattern), F.lit(0)))


def terms(text: Column) -> Column:
    """folded words in order."""
    return _folded(text, rf"{WORD}+")


def term_count(text: Column) -> Column:
    """How many there are; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"{WORD}+")), F.lit(0))


def rerank_terms(text: Column) -> Column:
    """the different folded tokens that have a letter or digit."""
    return F.array_distinct(_folded(text, rf"_*[\p{{L}}\p{{N}}]{WORD}*"))


def normalize(text: Column) -> Column:
    """runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""), rf"{SPACE}+", " ")


def dedup_key(text: Column) -> Column:
    """F5."""
    return casefold(normalize(text))


def title(text: Column, length: int = 80) -> Column:
    """F6."""
    return F.left(normalize(text), F.lit(length))


def truncate_tokens(text: Column, n: Column) -> Column:
    """the text up to the end of its n-th token; whole if it has no more."""
    cut = F.substring(text, F.lit(1), F.length(F.array_join(F.slice(tiles(text), F.lit(1), F.greatest(n, F.lit(0))), "")))
    return F.when(token_count(text) <= n, text).otherwise(cut)


def citation_ids(answer: Column) -> Column:
    """different numbers in brackets, rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def header(number: Column, filename: Column, media_type: Column, position: Column, metadata_json: Column) -> Column:
    """F8."""
    return F.format_string("[%d] Source: %s; media_type=%s; position=%d; metadata=%s", number, filename, media_type, position, metadata_json)


def query_id(query: Column) -> Column:
    """F23."""
    return F.left(F.sha2(normalize(query), 256), F.lit(16))


def ratio(numerator: Column, denominator: Column) -> Column:
    """F26."""
    return F.round(F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)), 6)


def escape_label(value: Column) -> Column:
    """F21."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def safe_label(value: Column, longest: int = 128) -> Column:
    """F28."""
    return value.rlike("^[A-Za-z0-9._-]+$") & (F.length(value) <= longest)


def suffix(path: Column) -> Column:
    """lower-case suffix with its dot, empty if none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def prompt(context: Column, question: Column) -> Column:
    """the user turn that grounds a question in its context."""
    # The wording of the turn.
    lead = "Use the following retrieved context to answer the question."
    nothing = "(No relevant context was retrieved.)"
    strip = F.regexp_replace(question, rf"^{SPACE}+|{SPACE}+$", "")
    return F.concat(F.lit(lead + "\n\nContext:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit(nothing)), F.lit("\n\nQuestion:\n"), strip)


def embed_deterministic(dimension: int):
    """A vector from SHAKE-256 of the text, each byte b as (b - 127.5) / 127.5."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [(b - 127.5) / 127.5 for b in hashlib.shake_256(x.encode()).digest(dimension)])

    return embed


def usable_vector(vector: Column, dimension: int) -> Column:
    """F16."""
    return (F.size(vector) == dimension) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
