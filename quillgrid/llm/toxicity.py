"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the subsequences of three letters they share, gaps allowed: a subsequence counts
DECAY ** (letters skipped), up to MAX_GAP skipped ones; word starts and ends are letters of their own. Insults with
letters put in or left out so keep most of what they share with the plain form; characters that aren't letters are
dropped, and runs of single letters are read as one word as well.

Training is on sentences of labelled documents. A sentence of a clean document has no insulting word; a document that
is toxic has at least one in some sentence, its witness. Witnesses and machine are fitted in turn. The machine is linear
in Nystroem features: kernel values to landmark words, whitened by the landmarks' own kernel matrix. As each kernel value
is a sum over subsequences, the fitted machine folds into one weight a subsequence, so that scoring a word costs one table
look-up for each of its subsequences, with exactly the value the landmarks would give.

A document's score is a logistic curve over its most insulting word; its labels, language, source and id are no input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches

DECAY = 0.6
MAX_GAP = 2
LETTERS = 64  # codes: 0 none, 1-26 a-z, 27-61 all others by remainder, 62 start, 63 end
PIECE = 24  # letters of a word that are compared at once; longer ones are read in overlapping pieces
LANDMARKS = 640
TRAIN_TOXIC = 1200  # documents that the machine is fitted on, the first by a hash of their id
TRAIN_CLEAN = 4000
TRAIN_CHARS = 20_000  # documents with more characters aren't in the sample, so that it is bounded in bytes too
NEGATIVES = 4_000
ROUNDS = 5
COST = 10.0
HARD = 4.0  # what a clean word that the machine took for an insult weighs, to another clean word's 1
CACHE_WORDS = 300_000
THRESHOLD = 0.3

_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _offsets() -> tuple[np.ndarray, np.ndarray]:
    """Of a subsequence that starts at 0: the places of its second and third letter, and its weight."""
    places = [(j, k) for k in range(2, MAX_GAP + 3) for j in range(1, k)]
    return np.array(places), np.array([DECAY ** (k - 2) for _, k in places], dtype=np.float32)


_PLACES, _WEIGHTS = _offsets()


def letters_of(word: str) -> str:
    return "".join(filter(str.isalpha, word))


def units(text: str) -> set[str]:
    """The different words of a lower-case text, and what is spelled letter by letter in it."""
    found = set(text.split())
    if _SPELLED.search(text):
        found.update("".join(m.group().split()) for m in _SPELLED.finditer(text))
    return found


def pieces_of(letters: str) -> list[str]:
    if len(letters) <= PIECE:
        return [letters]
    return [letters[i : i + PIECE] for i in range(0, len(letters) - PIECE // 2, PIECE // 2)]


def codes(words: list[str], width: int) -> np.ndarray:
    """A row of letter codes a word, with start and end, 0 behind."""
    joined = "".join("\x02" + w + "\x03" + "\x00" * (width - len(w)) for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width + 2)
    out = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 35)
    out[points == 0], out[points == 2], out[points == 3] = 0, 62, 63
    return out.astype(np.int32)


def subsequences(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of each word's subsequences, weight 0 where a word has ended; scaled by the word's length."""
    c = codes(words, width)
    n = c.shape[1]
    padded = np.pad(c, ((0, 0), (0, MAX_GAP + 2)))
    index = np.concatenate([padded[:, :n] * LETTERS * LETTERS + padded[:, j : j + n] * LETTERS + padded[:, k : k + n] for j, k in _PLACES], axis=1)
    alive = np.concatenate([padded[:, k : k + n] > 0 for _, k in _PLACES], axis=1)
    weight = np.repeat(_WEIGHTS, n)[None, :] * alive
    norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
    return index, (weight / np.maximum(norm, 1e-6)).astype(np.float32)


@dataclass
class Landmarks:
    """Landmark words by the subsequences that occur in them: place[index] is a row of ``columns``, row 0 is for all others."""

    place: np.ndarray
    index: np.ndarray
    columns: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        index, weight = subsequences(words, max(map(len, words)))
        used = np.unique(index[weight > 0])
        place = np.zeros(LETTERS**3, dtype=np.int32)
        place[used] = np.arange(1, len(used) + 1)
        columns = np.zeros((len(used) + 1, len(words)), dtype=np.float32)
        for j in range(len(words)):
            np.add.at(columns[:, j], place[index[j][weight[j] > 0]], weight[j][weight[j] > 0])
        return Landmarks(place, used, columns)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Values of words (of one piece each) against the landmarks."""
        out = np.empty((len(words), self.columns.shape[1]), dtype=np.float32)
        for at in range(0, len(words), 128):
            part = words[at : at + 128]
            index, weight = subsequences(part, max(map(len, part)))
            out[at : at + 128] = np.matmul(weight[:, None, :], self.columns[self.place[index]])[:, 0]
        return out

    def fold(self, alpha: np.ndarray) -> np.ndarray:
        """One weight a subsequence for the sum of ``alpha`` times the landmarks' values."""
        out = np.zeros(LETTERS**3, dtype=np.float32)
        out[self.index] = (self.columns @ alpha.astype(np.float32))[1:]
        return out


@dataclass
class Machine:
    """A fitted machine: one weight a subsequence, a bias, and the curve from the largest value to a score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    middle: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word of letters; longer than a piece: the largest of its pieces'."""
        parts = [(i, p) for i, w in enumerate(words) for p in pieces_of(w)]
        out = np.full(len(words), -np.inf, dtype=np.float64)
        by_width: dict[int, list[tuple[int, str]]] = {}
        for i, p in parts:
            by_width.setdefault(-(-len(p) // 4) * 4, []).append((i, p))
        for width, own in by_width.items():
            for at in range(0, len(own), 2048):
                some = own[at : at + 2048]
                index, weight = subsequences([p for _, p in some], width)
                np.maximum.at(out, [i for i, _ in some], (self.weights[index] * weight).sum(axis=1) + self.bias)
        return out

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The value of each text's most insulting word; the bias alone (a word that shares nothing) where there is none."""
        found = [units(x.lower()) if isinstance(x, str) else set() for x in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*found).difference(self.known))
        if new:
            self.known.update(zip(new, self.values([letters_of(w) for w in new]).tolist(), strict=True))
        return np.array([max(map(self.known.__getitem__, ws), default=self.bias) for ws in found])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (self.largest(texts) - self.middle), -30, 30)))


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the primal; a last column of ones is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    last = None
    for _ in range(steps):
        active = y * (x @ w) < 1
        if last is not None and (active == last).all():
            break
        last = active
        xa, ca = x[active], cost[active]
        xa *= np.sqrt(ca)[:, None].astype(x.dtype)
        full = np.linalg.solve(keep + 2 * (xa.T @ xa).astype(np.float64), 2 * xa.T @ (np.sqrt(ca) * y[active]))
        # halve the step until the objective falls
        loss = lambda v: v @ keep @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        step, here = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * (full - w)) > here:
            step /= 2
        w = w + step * (full - w)
    return w[:-1], float(w[-1])


def _explaining(docs: list[np.ndarray], y: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> list[int]:
    """First witnesses: words of toxic documents that are all but absent from clean ones, taken greedily, the one in most
    toxic documents first, each only if it explains documents that those before it don't; at last the likeliest word of the rest."""
    n_clean, n_toxic = max(1, int((y == 0).sum())), max(1, int(y.sum()))
    odds = (toxic + 0.01) / n_toxic / ((clean + 0.5) / n_clean)
    likely = (toxic >= 2) & (clean <= 0.02 * toxic)
    where: dict[int, list[int]] = {}
    for d in np.flatnonzero(y):
        for w in docs[d][likely[docs[d]]].tolist():
            where.setdefault(w, []).append(int(d))
    chosen, done = [], set()
    for w in sorted(where, key=lambda w: (-len(where[w]), w)):
        own = set(where[w])
        # a word in many toxic documents and no clean one is hardly there by chance; a rarer one must explain what is left
        if (len(own) >= 5 and odds[w] > 30) or len(own - done) >= max(2, 0.4 * len(own)):
            chosen.append(w)
            done |= own
    if not chosen:
        chosen = sorted({int(docs[d][np.argmax(odds[docs[d]])]) for d in np.flatnonzero(y) if len(docs[d])})
    return chosen[:2000]


def train(texts: list[str | None], toxic: list[int], share: float | None = None, seed: int = 17) -> Machine:
    """Fit on whole labelled texts; ``share`` is the toxic share of all labelled documents, the sample's own if not given. Without a toxic or a clean text, or without words, every score is the toxic share."""
    rng = np.random.default_rng(seed)
    y = np.array([int(bool(t)) for t in toxic])
    # words by number; of each document the words of its sentences
    number: dict[str, int] = {}
    sentences: list[list[np.ndarray]] = []
    for text in texts:
        own = [{p for u in units(s) if (w := letters_of(u)) for p in pieces_of(w)} for s in _SENTENCE.split((text or "").lower())]
        sentences.append([np.array(sorted(number.setdefault(w, len(number)) for w in sorted(s)), dtype=np.int32) for s in own if s])
    docs = [np.unique(np.concatenate(s)) if s else np.zeros(0, dtype=np.int32) for s in sentences]
    if len(y) == 0 or y.min() == y.max() or not any(len(d) for d, t in zip(docs, y, strict=True) if t):
        share = float(y.mean()) if len(y) else 0.0
        return Machine(np.zeros(LETTERS**3, dtype=np.float32), 0.0, 1.0, -float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    names = list(number)
    n_clean, n_toxic = int((y == 0).sum()), int(y.sum())
    in_clean, in_toxic = (np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t == v] or [np.zeros(0, dtype=np.int32)]), minlength=len(names)) for v in (0, 1))
    positive = _explaining(docs, y, in_clean, in_toxic)
    clean_words = np.flatnonzero(in_clean)
    often = clean_words[np.lexsort((clean_words, -in_clean[clean_words]))][: NEGATIVES // 2]
    negative = sorted((set(often.tolist()) | set(rng.choice(clean_words, min(len(clean_words), NEGATIVES), replace=False).tolist())) - set(positive))
    hard: list[int] = []
    machine = basis = None
    for turn in range(ROUNDS):
        if turn < ROUNDS - 1:
            # landmarks: insults, the clean words most like them so far, and any others
            third = LANDMARKS // 3
            first = positive[:third] + [w for w in hard[:third] if w not in set(positive)]
            chosen = first + [negative[i] for i in sorted(rng.choice(len(negative), min(len(negative), LANDMARKS - len(first)), replace=False))]
            basis = Landmarks.of([names[w] for w in chosen])
            values, vectors = np.linalg.eigh((basis.columns.T @ basis.columns).astype(np.float64))
            whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
        x = (basis.kernel([names[w] for w in positive + negative]) @ whiten).astype(np.float32)
        labels = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        seen = np.concatenate([np.log1p(in_toxic[positive]), np.where(np.isin(negative, hard), HARD, 1.0)])
        seen[: len(positive)] *= 0.5 * len(negative) / max(1e-9, seen[: len(positive)].sum())
        v, bias = _linear_svm(x, labels, COST * seen / 2)
        del x
        machine = Machine(basis.fold(whiten @ v), bias)
        value = np.concatenate([machine.values(names[at : at + 20_000]) for at in range(0, len(names), 20_000)])
        # a witness for each toxic document: the most insulting word of its most insulting sentence
        best = [max(s, key=lambda ws: value[ws].max()) for s, t in zip(sentences, y, strict=True) if t and s]
        witnesses = {int(ws[np.argmax(value[ws])]) for ws in best}
        surely = set(np.flatnonzero((in_clean == 0) & (in_toxic >= 5) & (value > 0)).tolist())
        positive = sorted({w for w in witnesses if not in_clean[w] and value[w] > 0} | surely | {w for w in positive if value[w] > 0}, key=lambda w: (-in_toxic[w], w))[:3000] or positive
        close = clean_words[value[clean_words] > -0.9]
        hard = [w for w in close[np.lexsort((close, -value[close]))].tolist() if w not in set(positive)][:NEGATIVES]
        negative = sorted((set(negative) | set(hard)) - set(positive))
    # the curve is fitted on toxic documents and on every second clean one
    clean = np.flatnonzero(y == 0)
    used = np.sort(np.concatenate([np.flatnonzero(y), clean[1::2] if len(clean) > 1 else clean]))
    top, goals = np.concatenate([machine.largest([texts[d] for d in used[at : at + 500]]) for at in range(0, len(used), 500)]), y[used]
    machine.known.clear()
    # clean documents weigh as in all labelled documents, not as in the sample
    odds = (1 - share) / share if share and share < 1 else n_clean / n_toxic
    cost = np.where(goals == 1, 1.0, odds * (goals == 1).sum() / max(1, (goals == 0).sum()))
    # logistic curve over the largest value (Platt), with a fixed small ridge
    a, b = 1.0, 0.0
    goal = np.where(goals == 1, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        g = np.array([(cost * (p - goal) * top).sum() + 1e-3 * a, (cost * (p - goal)).sum()])
        r = cost * p * (1 - p) + 1e-9
        h = np.array([[(r * top * top).sum() + 1e-3, (r * top).sum()], [(r * top).sum(), r.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(1e-9, abs(da), abs(db)))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    a = max(a, 1e-3)
    machine.slope, machine.middle = float(a), float(-b / a)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_toxic: int = TRAIN_TOXIC, max_clean: int = TRAIN_CLEAN) -> tuple[list, float | None]:
    """Rows and toxic share: a bounded sample of labelled documents outside the held-out quarter, the first by a hash of
    the id, one row an id (of rows that repeat it, the least text), and the share of all such labels."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic")).where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        some = known.where((F.col("_toxic") > 0) == bool(value)).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    # at most max_toxic + max_clean ids: a bounded side
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.coalesce(F.length("_text"), F.lit(0)) <= TRAIN_CHARS).join(F.broadcast(chosen), "_id")
    share = known.agg(F.avg((F.col("_toxic") > 0).cast("double"))).first()[0]
    return joined.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).collect(), share


def score_documents(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``: whole texts, one pass, no shuffle.

    Null and blank texts have no word and get the score of one that shares nothing with an insult. Repeated rows and
    equal texts score alike; a null doc_id is never held out; other columns are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(np.concatenate([own.scores(texts.iloc[i : i + 200].tolist()) for i in range(0, len(texts), 200)]) if len(texts) else np.zeros(0))

    scored = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, share = training_rows(docs, labels)
    rows.sort(key=lambda r: r["_id"])
    machine = train([r["_text"] for r in rows], [r["_toxic"] for r in rows], share)
    return score_documents(docs, machine)
