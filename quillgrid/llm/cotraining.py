"""Quality classifier by co-training.

Two views of a document that share no feature: its content (hashed byte trigrams of the text) and its page metadata (language,
source, and the numbers of its characters, lines and words; which characters they are it doesn't see). A logistic classifier for each view
starts from the labelled sample. In each round a classifier labels the unlabelled documents it is surest of, good and bad,
for the other one to learn from. At last each view is calibrated on labelled documents it hasn't learned from, and a document's
score is the logistic mean of both, each weighing what its calibration gives it. Fitting uses a bounded sample; every
document is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches

CONTENT = 2048  # hashed trigrams
SAMPLE = 1500  # labelled documents of each class, the first by a hash of the id
POOL = 3000  # unlabelled documents that the views label for each other
ROUNDS = 4
RIDGE = (1e-5, 1e-4)  # of the content and of the metadata view, whose few features say much where they are seldom
SURE = 20  # documents of each class that a view hands over in a round
THRESHOLD = 0.35  # what is rejected is gone, so doubtful documents stay
#: Measures of a page on soft steps: (name, first step, width, steps).
_MEASURES = (("log2 characters", 4.0, 1.0, 16), ("log2 characters a line", 3.0, 0.75, 16), ("log2 lines", 0.0, 0.75, 16), ("characters a word", 3.0, 0.4, 20))
_HASHED = 64  # places of language and source
METADATA = sum(n for *_, n in _MEASURES) + 1 + _HASHED


def content_view(data: np.ndarray) -> np.ndarray:
    """Damped, normed counts of hashed trigrams of bytes."""
    out = np.zeros(CONTENT, dtype=np.float32)
    if len(data) >= 3:
        for at in range(0, len(data) - 2, 1 << 20):
            x = data[at : at + (1 << 20) + 2].astype(np.uint32)
            hashed = ((x[:-2] * 65_599 + x[1:-1]) * 65_599 + x[2:]) * np.uint32(2_654_435_761) >> np.uint32(21)
            out += np.bincount(hashed, minlength=CONTENT).astype(np.float32)
        out = np.log1p(out)
        out /= max(1e-9, float(np.linalg.norm(out)))
    return out


def metadata_view(n_chars: int | None, n_lines: int, n_words: int, lang: str | None, source: str | None) -> np.ndarray:
    """Measures of length on soft steps, null n_chars a feature of its own; language and source fall into hashed places."""
    size = max(1, n_chars or 0)
    values = (np.log2(size), np.log2(size / n_lines), np.log2(n_lines), size / max(1, n_words))
    soft = [np.exp(-(((np.clip(v, low, low + width * (n - 1)) - low) / width - np.arange(n)) ** 2)) for v, (_, low, width, n) in zip(values, _MEASURES, strict=True)]
    out = np.concatenate([*soft, np.zeros(1 + _HASHED)]).astype(np.float32)
    out[-1 - _HASHED] = n_chars is None
    for value in (("lang", lang), ("source", source)):
        out[len(out) - _HASHED + zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % _HASHED] += 0.3
    return out


def views(text: str | None, n_chars: int | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return content_view(np.frombuffer(raw, dtype=np.uint8)), metadata_view(n_chars, raw.count(b"\n") + 1, len(raw.split()), lang, source)


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 300) -> Logistic:
        """By accelerated gradient steps; the bad, which are fewer, weigh up to half of what the good do."""
        good, bad = max(1, (y > 0).sum()), max(1, (y == 0).sum())
        cost = np.where(y > 0, 1 / good, max(1 / good, 0.5 / bad) if bad < good else 1 / bad) / 2
        rate = 1.0 / (0.25 * float(np.einsum("ij,ij->i", x, x).max() + 1) + ridge)
        w, b = np.zeros(x.shape[1]), 0.0
        vw, vb, t = w, b, 1.0
        for _ in range(steps):
            gap = cost * (1 / (1 + np.exp(-np.clip(x @ vw.astype(x.dtype) + vb, -30, 30))) - y)
            nw, nb = vw - rate * (x.T @ gap.astype(x.dtype) + ridge * vw), vb - rate * gap.sum()
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = nw, nb, nt
        return Logistic(w.astype(np.float32), float(b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float = 0.5) -> None:
        """A logistic curve over the margin; classes weigh as among all labels, of which ``share`` are good."""
        m, a, b = self.margin(x).astype(np.float64), 1.0, 0.0
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
        cost = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            r, gap = cost * p * (1 - p) + 1e-9, cost * (p - goal)
            h = np.array([[(r * m * m).sum() + 1e-2, (r * m).sum()], [(r * m).sum(), r.sum() + 1e-2]])
            da, db = np.linalg.solve(h, [(gap * m).sum(), gap.sum()])
            scale = min(1.0, 5.0 / max(1e-9, abs(da), abs(db)))
            a, b = a - scale * da, b - scale * db
        self.slope, self.shift = max(1e-3, float(a)), float(b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -12, 12)


def cotrain(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_metadata: np.ndarray, share: float = 0.5) -> tuple[Logistic, Logistic] | None:
    """The two calibrated classifiers; None where the sample lacks a class. Every third labelled document only calibrates."""
    if len(y) == 0 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 3 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    both, pools = [content, metadata], [pool_content, pool_metadata]
    given: list[dict[int, int]] = [{}, {}]  # pool document -> label, for each view to learn from
    made: list[Logistic] = []
    for turn in range(ROUNDS + 1):
        made = []
        for v in (0, 1):
            extra = sorted(given[v])
            x = np.vstack([both[v][~held], pools[v][extra]]) if extra else both[v][~held]
            made.append(Logistic.fit(x, np.concatenate([y[~held], [given[v][k] for k in extra]]), RIDGE[v]))
        if turn == ROUNDS or not len(pools[0]):
            break
        for v in (0, 1):
            margin = made[v].margin(pools[v])
            order = np.argsort(margin, kind="stable")
            most = min(SURE, len(order) // 20)
            fresh = lambda ks, v=v: [int(k) for k in ks if int(k) not in given[1 - v]][:most]
            bad, good = fresh(order[margin[order] < -1]), fresh(order[::-1][margin[order[::-1]] > 1])
            given[1 - v] |= dict.fromkeys(bad, 0) | dict.fromkeys(good, 1)
    for v in (0, 1):
        check = held if held.any() else np.ones(len(y), dtype=bool)
        made[v].calibrate(both[v][check], y[check], share)
    return made[0], made[1]


_FIELDS = ("text", "n_chars", "lang", "source")


def _views_of(*columns: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    some = lambda x: None if x is None or x != x else x
    return [views(*map(some, row)) for row in zip(*columns, strict=True)]


def _fields(docs: DataFrame, prefix: str = "") -> list:
    """The columns that the views read; n_chars as double, which pandas holds null or not."""
    return [F.col(prefix + c).cast("double" if c == "n_chars" else "string").alias(c) for c in _FIELDS]


def _sample(docs: DataFrame, labels: DataFrame, size: int, pool: int) -> tuple[list, list, float]:
    """Views of a bounded labelled sample and of a bounded pool, one row an id (of rows that repeat it, the least views), in
    half precision; only these reach the driver, and the
    share of good ones among all labels."""

    @F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())]))
    def both(text: pd.Series, n_chars: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        made = _views_of(text, n_chars, lang, source)
        return pd.DataFrame({"content": [c.astype(np.float16).tobytes() for c, _ in made], "metadata": [m.astype(np.float16).tobytes() for _, m in made]})

    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_y > 0").orderBy(*by_hash).limit(size).union(known.where("_y = 0").orderBy(*by_hash).limit(size))
    read = bounded_batches(docs).select(F.col("doc_id").alias("_id"), *_fields(docs))
    labelled = read.join(F.broadcast(chosen), "_id")  # at most 2 * size ids
    unlabelled = read.join(known.select("_id"), "_id", "left_anti").select("_id").where("_id is not null").distinct().orderBy(*by_hash).limit(pool)
    others = read.join(F.broadcast(unlabelled.withColumn("_y", F.lit(None).cast("int"))), "_id")
    one = lambda rows: rows.select("_id", "_y", both(*_FIELDS).alias("v")).groupBy("_id").agg(F.min("_y").alias("_y"), F.min("v").alias("v")).collect()
    return one(labelled), one(others), known.agg(F.avg((F.col("_y") > 0).cast("double"))).first()[0] or 0.5


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, pool: int = POOL) -> tuple[Logistic, Logistic] | None:
    rows, others, share = _sample(docs, labels, size, pool)
    rows, others = (sorted(x, key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"])) for x in (rows, others))
    stack = lambda rs, f, n: np.array([np.frombuffer(r.v[f], dtype=np.float16) for r in rs], dtype=np.float32).reshape(-1, n)
    y = np.array([int(r["_y"] > 0) for r in rows])
    return cotrain(stack(rows, "content", CONTENT), stack(rows, "metadata", METADATA), y, stack(others, "content", CONTENT), stack(others, "metadata", METADATA), share)


SCORES = ("content_score", "metadata_score", "quality_score", "quality_keep")


def with_quality(docs: DataFrame, models: tuple[Logistic, Logistic] | None) -> DataFrame:
    """``docs`` with content_score, metadata_score, quality_score (0 to 1) and quality_keep. No models: all scores 1."""
    others = [c for c in docs.columns if c not in SCORES]
    if models is None:
        return docs.select(*[F.col(f"`{c}`") for c in others], *[F.lit(1.0).alias(c) for c in SCORES[:3]], F.lit(True).alias("quality_keep"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("content double, metadata double")
    def logits(text: pd.Series, n_chars: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        content, metadata = shared.value
        made = _views_of(text, n_chars, lang, source)
        return pd.DataFrame({"content": [float(content.logit(c)) for c, _ in made], "metadata": [float(metadata.logit(m)) for _, m in made]}, dtype="float64")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")  # so that no column's name meets those made here
    scored = bounded_batches(docs).select(row).select("r", logits(*_fields(docs, "r.")).alias("z"))
    curve = lambda x: 1 / (1 + F.exp(-x))
    mean = curve((F.col("z.content") + F.col("z.metadata")) / 2)
    return scored.select(*[F.col(f"r.`{c}`").alias(c) for c in others], curve(F.col("z.content")).alias("content_score"), curve(F.col("z.metadata")).alias("metadata_score"), mean.alias("quality_score"), (mean >= THRESHOLD).alias("quality_keep"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its scores. Null text counts as empty, null n_chars, lang or source as values of their own;
    repeated rows score alike; score columns that ``docs`` brings are replaced, all others pass whatever their names; an
    empty table gives no rows; labels without one of the classes keep everything."""
    return with_quality(docs, fit(docs, labels))
