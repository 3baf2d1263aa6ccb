"""A quality classifier learned from positive and unlabelled text.

Trusted positives are the rows with label 1 outside the held-out fold; every row outside that fold, label unseen, is the
unlabelled sample. A linear model over features of the text minimises the non-negative unbiased risk with the logistic
loss: prior * mean over positives of l(f) + max(0, mean over unlabelled of l(-f) - prior * mean over positives of l(-f)).
With that loss the unbiased risk is convex, and a Newton step needs sums over all rows only: each step is one Spark
aggregation over the written features, and just the summed gradient and Hessian (their size is set by the features)
reach the driver. A step that makes the estimated risk on negatives negative is halved until it isn't; so is the last
one, and where halving does not help the weights before it stay.

The class prior is estimated from all rows too: of a first model's scores, the least ratio of the unlabelled share above
a threshold to the positives' share above it, each with its confidence margin.

Features: shares of the pairs of byte classes, repetition of words, word triples and lines, and lengths. The text is
read once; labels, lang, source and id are no features.

Defined cases: a null text counts as empty; an empty text gets the score its features give; a null label, or rows of
labels that disagree, make no trusted positive; a null id is never held out; repeated rows are scored alike; with no
positives at all, scores are the prior 0.5. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, summed, table, word_bounds, word_hashes, written

FOLDS, THRESHOLD, RIDGE, STEPS, HALVINGS, BINS = 5, 0.3, 0.1, 8, 5, 400
CLASSES = [b" ", b"\n\r", b"\t\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#$%&*+~^=@\\/_<>", b"()[]{}\"'`:;-", bytes(range(128, 256))]
CLASS = np.full(256, len(CLASSES), dtype=np.intp)
for _i, _group in enumerate(CLASSES):
    CLASS[list(_group)] = _i
N_CLASS = len(CLASSES) + 1


def _repeats(keys: np.ndarray) -> list[float]:
    """Share of distinct keys, share of the commonest, share equal to their predecessor."""
    if not len(keys):
        return [1.0, 0.0, 0.0]
    _, counts = np.unique(keys, return_counts=True)
    return [len(counts) / len(keys), counts.max() / len(keys) if len(keys) > 1 else 0.0, float((keys[1:] == keys[:-1]).mean()) if len(keys) > 1 else 0.0]


def features(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kind = CLASS[data]
    pairs = np.bincount(kind[:-1] * N_CLASS + kind[1:], minlength=N_CLASS * N_CLASS) / max(1, len(data) - 1)
    singles = np.bincount(kind, minlength=N_CLASS) / max(1, len(data))
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(7) + words[2:] * np.uint64(31) if len(words) > 2 else words[:0]
    breaks = np.flatnonzero(data == 10)
    lines = np.add.reduceat(np.r_[words, np.uint64(0)], np.unique(np.searchsorted(starts, np.r_[0, breaks]))) if len(words) else words
    size = (ends - starts).mean() if len(words) else 0.0
    more = [*_repeats(words), *_repeats(mix64(triples)), *_repeats(lines)[:2], np.log1p(len(words)) / 10, size / 10, np.log1p(size), len(breaks) / max(1, len(words))]
    return np.concatenate([np.sqrt(pairs), np.sqrt(singles), more, [1.0]]).astype(np.float32)


N_FEATURES = len(features("a"))


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [features(t).astype(np.float16).tobytes() for t in pdf["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, x binary")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["x"]), dtype=np.float16).reshape(len(pdf), N_FEATURES).astype(np.float64)


class PuModel:
    """scale: what features are divided by; w: weights, the last the intercept's; prior: share of positives."""

    def __init__(self, scale: np.ndarray, mean: np.ndarray):
        self.scale, self.mean, self.w, self.prior = scale, mean, np.zeros(len(scale)), 0.5

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        return (_matrix(pdf) - self.mean) / self.scale

    def logits(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.clip(self(pdf) @ self.w, -60, 60)

    def risk(self, rows: DataFrame, m: Moments) -> tuple[float, float, np.ndarray, np.ndarray]:
        """In one pass: the risk on positives, that on negatives (which may be below 0), and the gradient and Hessian of
        their sum."""
        d = len(self.w)

        def part(pdf: pd.DataFrame) -> np.ndarray:
            x, p = self(pdf), pdf["positive"].to_numpy(dtype=bool)
            f = np.clip(x @ self.w, -60, 60)
            s, loss = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)
            return np.concatenate([[loss.sum(), loss[p].sum(), f[p].sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

        sums = summed(rows, part, 3 + d + d * d)
        positive = self.prior * (sums[1] - sums[2]) / m.n_positive  # l(f) = l(-f) - f
        negative = sums[0] / m.n - self.prior * sums[1] / m.n_positive
        gradient = sums[3 : 3 + d] / m.n - self.prior * (m.sum_positive / m.n_positive - self.mean) / self.scale
        return positive, negative, gradient, sums[3 + d :].reshape(d, d) / m.n

    def newton(self, rows: DataFrame, m: Moments, steps: int) -> None:
        """Steps from weights of a risk on negatives of 0 or more (such as the first ones, 0) to others of that kind."""
        ridge = np.full(len(self.w), RIDGE)
        ridge[-1] = 1e-9
        last = self.w.copy()
        for _ in range(steps):
            _, negative, gradient, hessian = self.risk(rows, m)
            if negative < 0:
                self.w = (self.w + last) / 2
                continue
            last = self.w.copy()
            step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * self.w)
            self.w = self.w - step * min(1.0, 20 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-3:
                break
        for _ in range(HALVINGS):  # the last step has not been checked yet
            if self.risk(rows, m)[1] >= 0:
                return
            self.w = (self.w + last) / 2
        self.w = last

    def estimate_prior(self, rows: DataFrame, m: Moments, delta: float = 0.1, gamma: float = 0.01) -> None:
        def histogram(pdf: pd.DataFrame) -> np.ndarray:
            cell = np.minimum((BINS / (1 + np.exp(-self.logits(pdf)))).astype(int), BINS - 1)
            return np.concatenate([np.bincount(c, minlength=BINS) for c in (cell, cell[pdf["positive"].to_numpy(dtype=bool)])]).astype(float)

        counts = summed(rows, histogram, 2 * BINS)
        above = [np.cumsum(own[::-1]) / n for own, n in ((counts[:BINS], m.n), (counts[BINS:], m.n_positive))]
        margin = np.sqrt(np.log(4 / delta) / 2 / m.n) + np.sqrt(np.log(4 / delta) / 2 / m.n_positive)
        usable = above[1] > 0.05
        upper = (above[0] + (1 + gamma) * margin)[usable] / above[1][usable]
        best = int(np.argmin(upper))
        self.prior = float(np.clip(above[0][usable][best] / above[1][usable][best], 0.01, 0.99))


@dataclass
class Moments:
    """Of all rows: n, and sums of the features and of their squares; of the positives: n_positive, sum_positive."""

    n: float
    n_positive: float
    total: np.ndarray
    squares: np.ndarray
    sum_positive: np.ndarray


def moments(rows: DataFrame) -> Moments:
    d = N_FEATURES

    def part(pdf: pd.DataFrame) -> np.ndarray:
        x, p = _matrix(pdf), pdf["positive"].to_numpy(dtype=bool)
        return np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x * x).sum(axis=0), x[p].sum(axis=0)])

    sums = summed(rows, part, 2 + 3 * d)
    return Moments(sums[0], sums[1], *np.split(sums[2:], 3))


def fit(rows: DataFrame) -> PuModel | None:
    """rows: x, positive (boolean); all of them are the unlabelled sample. None if there are no positives."""
    m = moments(rows)
    if not m.n_positive:
        return None
    mean = m.total / m.n
    scale = np.sqrt(np.maximum(m.squares / m.n - mean**2, 0))
    still = scale < 1e-3
    mean[-1], scale[still] = 0, 1.0
    model = PuModel(scale, mean)
    model.newton(rows, m, 3)
    model.estimate_prior(rows, m)
    model.w = np.zeros(N_FEATURES)  # where the risk on negatives is above 0, whatever the prior
    model.newton(rows, m, STEPS)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, class_prior."""
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    trusted = trusted.agg(F.coalesce(F.min(F.coalesce(F.col(label_col), F.lit(0))) == 1, F.lit(False)).alias("good"))
    rows = feature_table(docs, id_col, text_col).join(trusted, "doc_id", "left")
    out = held_out(F.col("doc_id"))
    rows = written(rows.select("doc_id", "x", out.alias("held_out"), (F.coalesce("good", F.lit(False)) & ~out).alias("positive")), "features")
    model = fit(rows.where(~F.col("held_out")).select("x", "positive"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = 1 / (1 + np.exp(-model.logits(pdf))) if model and len(pdf) else np.full(len(pdf), 0.5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32), "class_prior": model.prior if model else 0.5})

    return rows.select("doc_id", "held_out", "x").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, class_prior double")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
