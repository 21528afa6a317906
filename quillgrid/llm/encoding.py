"""Whole-text encoding with public tokenizer files, cached by white-space separated unit.

Both tokenizers split a text before they merge, and never across the blank between two units; so the ids of a text are
the ids of its units in a row. Units repeat, so a bounded dictionary in each worker holds their ids. Texts outside the
characters and blanks for which this was shown to hold take the plain way, the tokenizer over the whole text: the ids
are always those of the tokenizer.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np

CACHE_UNITS = 400_000  # units held by a worker; when full the dictionary starts anew
END_ID = 1

#: Blanks of one kind only, no combining or case-variable characters: normalising such a text is done character by character.
_ODD_WORD = re.compile("[^\t\n\r -~¡-ÿĀ-įı-ňŊ-ž‐-‧€]|<\\|")
#: For blank-prefixed units: a blank that is followed by another, or that ends the text; and blanks other than space and newline.
_ODD_BLANK = re.compile(r"[^\S \n]")


def _odd_byte(text: str) -> bool:
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_BLANK.search(text) is not None


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; its folder is found by import or, if that fails, in QUILLGRID_TOKENIZERS or /opt/tokenizers."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(os.environ.get("QUILLGRID_TOKENIZERS", "/opt/tokenizers"), name)


def _byte_letters() -> dict[int, str]:
    """Byte-level models name each byte by a letter: printable bytes by themselves, the others by letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin a piece with letters


class _Known(dict):
    """Units made at the first look-up; a full dictionary starts anew between texts."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = self.make(unit)
        return found

    def trim(self) -> None:
        if len(self) > CACHE_UNITS:
            self.clear()


class WordTokens:
    """ids of ``word_bpe_49k.json``-like files (lower case, white space dropped), as uint16."""

    dtype = np.dtype("<u2")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units, self.marks = _Known(self._unit), _Known(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, letters: str) -> bytes:
        """Of lower-case letters only: one piece for the model, without the other steps."""
        piece = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_LETTERS)
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        word = unit.rstrip(_MARKS)
        if not word.isalpha():
            return self._whole(unit)
        return self._word(word) if len(word) == len(unit) else self._word(word) + self.marks[unit[len(word) :]]

    def encode_all(self, texts: Iterable[str]) -> Iterable[np.ndarray]:
        of = self.units.__getitem__
        for text in texts:
            self.units.trim()
            self.marks.trim()
            yield np.frombuffer(self._whole(text) if _ODD_WORD.search(text) else b"".join(map(of, text.lower().split())), dtype=self.dtype)


class ByteTokens:
    """ids of ``byte_bpe_50k.tiktoken``-like files (byte level, lossless), as uint16; ``lengths`` has each id's bytes."""

    dtype = np.dtype("<u2")

    def __init__(self, path: str, pattern: str | None = None):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.units = _Known(lambda unit: self._ids(" " + unit))
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)

    def _ids(self, text: str) -> bytes:
        return array("H", self.encoding.encode_ordinary(text)).tobytes()

    def encode_all(self, texts: Iterable[str]) -> Iterable[np.ndarray]:
        """A text's first unit is encoded as it is, each later one with the blank before it."""
        of = self.units.__getitem__
        for text in texts:
            self.units.trim()
            if _odd_byte(text):
                yield np.frombuffer(self._ids(text), dtype=self.dtype)
            else:
                first, *rest = text.split(" ")
                yield np.frombuffer(self._ids(first) + b"".join(map(of, rest)), dtype=self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    return WordTokens(path)


@cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def clean(text: str | None) -> str:
    """Null is the empty text."""
    return text if isinstance(text, str) else ""
