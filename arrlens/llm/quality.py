"""Quality classifier: Bradley-Terry ranking of documents.

Each preference pair is a document labelled good over one labelled bad. The
score of a document is linear in its features, and P(a preferred to b) =
sigmoid(score(a) - score(b)): logistic loss on feature differences. A document
passes if its score is above the quantile of the training scores that the
share of bad rows gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, in_slices, labelled_sample, table

SAMPLE_ROWS = 16_000      # labelled rows the model is fitted on, at most about
PAIRS_PER_ROW = 12        # good rows that each bad row is compared with, and the reverse
THRESHOLD = 0.7
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*!|@^~<>{}[]\\=_+"
_STOPS = b".,;:?"
NAMES = ("log_words", "repeat", "distinct", "symbols", "upper", "digits", "stops", "word_length", "line_repeat",
         "long_words", "symbol_words", "single")


def features(text: str | None) -> list[float]:
    """Shares of the whole text, each as log(share + 0.01) next to the share itself."""
    raw = (text or "").encode()
    words = raw.split()
    n, chars = max(len(words), 1), max(len(raw), 1)
    kinds = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda letters: len(raw) - len(raw.translate(None, letters))
    shares = (
        sum(map(eq, words, words[1:])) / n,
        len(kinds) / n,
        count(_SYMBOLS) / chars,
        count(_UPPER) / chars,
        count(_DIGITS) / chars,
        count(_STOPS) / n,
        min(chars / n / 20, 2.0),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(w) > 24 for w in kinds) / max(len(kinds), 1),
        sum(not w[-1:].isalnum() and w[-1:] in b"#$%&*!|@^~" for w in kinds) / max(len(kinds), 1),
        float(len(words) < 2),
    )
    out = [math.log1p(len(words)), float(not words)]
    for s in shares:
        out += [s, math.log(s + 0.01)]
    return out


WIDTH = len(features(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float       # score at the quantile; maps to THRESHOLD
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the ranking score; THRESHOLD exactly at the cut."""
        s = ((x - self.mean) / self.scale) @ self.weights
        z = (s - self.cut) / self.spread + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def pair_numbers(n_good: int, n_bad: int, pairs_per_row: int = PAIRS_PER_ROW) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the good and the bad row of each pair. The stride has no factor in common
    with the number of bad rows, so every row is reached; where the pairs would begin
    to repeat, the bad rows move on by one."""
    k = np.arange(max(n_good, n_bad) * pairs_per_row)
    stride = next(s for s in range(7919, 7919 + n_bad) if math.gcd(s, n_bad) == 1)
    return k % n_good, (k * stride + k // math.lcm(n_good, n_bad)) % n_bad


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, l2: float = 1.0) -> Model:
    """Newton steps on the pairs' logistic loss. Every row of either class is
    in ``pairs_per_row`` pairs with evenly spread rows of the other one."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if len(good) and len(bad):
        a, b = pair_numbers(len(good), len(bad), pairs_per_row)
        d = z[good[a]] - z[bad[b]]
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))
            g = d.T @ p - l2 * w
            h = (d * (p * (1 - p))[:, None]).T @ d + l2 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
    s = ((x - mean) / scale) @ w
    if len(good) and len(bad):
        # the quantile of the bad rows' share; halfway to the next score
        order = np.sort(s)
        at = min(max(len(bad), 1), len(order) - 1)
        cut = float((order[at - 1] + order[at]) / 2)
        spread = max(float(np.median(np.abs(s - cut))) / 3, 1e-6)
    else:
        cut, spread = (-1.0, 1.0) if len(good) else (1.0, 1.0)
    return Model(mean, scale, w, cut, spread)


def _sample_features(batches):
    for batch in in_slices(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64())), batch["label"]],
            ["x", "label"])


def _fit(batches):
    rows = sorted((r for b in batches for r in zip(b["x"].to_pylist(), b["label"].to_pylist())),
                  key=lambda r: (r[1], r[0]))  # the same pairs whatever the order of arrival
    m = fit_bradley_terry(np.array([r[0] for r in rows]).reshape(-1, WIDTH), np.array([r[1] for r in rows], dtype=int))
    out = [m.mean.tolist(), m.scale.tolist(), m.weights.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in out] +
                                     [pa.array([m.cut]), pa.array([m.spread])],
                                     ["mean", "scale", "weights", "cut", "spread"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``sample_rows`` labelled rows outside the held-out
    fold; one task works on their feature vectors. Without labelled rows, or
    with one class only, all documents get one score on that class' side."""
    sample = labelled_sample(docs, labels, "quality", 4, 2, sample_rows)
    rows = sample.mapInArrow(_sample_features, "x array<double>, label int").repartition(1)
    fitted = rows.mapInArrow(
        _fit_or_prior, "mean array<double>, scale array<double>, weights array<double>, cut double, spread double")
    r = fitted.collect()[0]
    return Model(np.array(r["mean"]), np.array(r["scale"]), np.array(r["weights"]), r["cut"], r["spread"])


def _fit_or_prior(batches):
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield from _fit(batches)
    else:
        zeros, ones = [0.0] * WIDTH, [1.0] * WIDTH
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in (zeros, ones, zeros)] +
                                         [pa.array([-1.0]), pa.array([1.0])],
                                         ["mean", "scale", "weights", "cut", "spread"])


def _values(model: Model, texts: list) -> np.ndarray:
    return model.scores(np.array([features(t) for t in texts]).reshape(-1, WIDTH))


def _scorer(model: Model):
    def score(batches):
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(_values(model, batch["text"].to_pylist()), pa.float64())],
                ["doc_id", "held_out", "score"])
    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row, the whole text scored in one narrow pass. A
    null text counts as empty; repeated rows give repeated results; a null
    doc_id stays null and is not held out; an empty table gives no rows;
    other columns are ignored."""
    rows = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    out = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keeper(model: Model, threshold: float):
    def keep(batches):
        for batch in in_slices(batches):
            yield batch.filter(pa.array(_values(model, batch["text"].to_pylist()) >= threshold))
    return keep


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    return docs.mapInArrow(_keeper(model, threshold), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
