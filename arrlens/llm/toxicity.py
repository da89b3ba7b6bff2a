"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of words and word beginnings. Training rows
that mention a group (identity terms) get counterfactual twins: in one each
term is swapped for another of the same list, in the other it is left out. The
squared change of the raw score is penalised, so that neither which group is
named nor that one is named moves a document across the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, labelled_sample, table

# Interchangeable group mentions, one list per language and number.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "gay", "lesbian", "straight",
     "bisexual", "transgender", "black", "white", "asian", "latino", "african", "european", "american", "indian",
     "chinese", "mexican", "arab", "female", "male", "disabled", "deaf", "blind", "old", "young"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "gays", "lesbians", "blacks",
     "whites", "asians", "latinos", "africans", "europeans", "americans", "indians", "mexicans", "arabs", "women",
     "men", "immigrants", "refugees", "foreigners"),
    ("christen", "muslime", "juden", "frauen", "männer", "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("chrétiens", "musulmans", "juifs", "femmes", "hommes", "étrangers", "réfugiés", "immigrés", "homosexuels"),
    ("cristianos", "musulmanes", "judíos", "mujeres", "hombres", "extranjeros", "refugiados", "inmigrantes", "gays"),
)
_SWAP = {}
for _terms in IDENTITY_TERMS:
    for _i, _t in enumerate(_terms):
        _SWAP.setdefault(_t, _terms[(_i + 1) % len(_terms)])

SAMPLE_ROWS = 16_000    # labelled rows the model is fitted on, at most about
MAX_FEATURES = 1_024    # features the model keeps
MIN_ROWS = 3            # sample rows a feature must occur in
MIN_G2 = 12.0           # and their log-likelihood ratio against chance
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def features(words: set[str]) -> set[str]:
    """Words, and the beginnings that families of derived words share."""
    out = set(words)
    for n in (4, 5, 6, 7):
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def twins(words: set[str]) -> list[set[str]]:
    """The words with every identity term exchanged, and without them; nothing
    for words without such terms."""
    if words.isdisjoint(_SWAP):
        return []
    return [{_SWAP.get(w, w) for w in words}, words - _SWAP.keys()]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias
        if text and w:
            z += sum(w[f] for f in sorted(features(words_of(text)) & w.keys()))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _count(batches):
    pos, neg = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            (pos if label else neg).update(features(words_of(text)))
    names = sorted(pos.keys() | neg.keys())
    for i in range(0, len(names), 50_000):
        part = names[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[f] for f in part], pa.int64()),
                                          pa.array([neg[f] for f in part], pa.int64())], ["feature", "pos", "neg"])


def select_features(sample: DataFrame, n_pos: int, n_neg: int, max_features: int) -> list[str]:
    """The features whose presence tells most about the class, by the
    log-likelihood ratio of their 2 x 2 counts. Counted in the tasks, added up
    after one shuffle."""
    counts = sample.mapInArrow(_count, "feature string, pos long, neg long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = F.lit(float(n_pos + n_neg))
    with_it = F.col("pos") + F.col("neg")

    def part(seen, of_class, of_feature):
        return F.when(seen > 0, seen * F.log(seen * rows / (of_feature * float(of_class)))).otherwise(0.0)

    g2 = 2 * (part(F.col("pos"), n_pos, with_it) + part(F.col("neg"), n_neg, with_it) +
              part(n_pos - F.col("pos"), n_pos, rows - with_it) + part(n_neg - F.col("neg"), n_neg, rows - with_it))
    top = (counts.where(with_it >= MIN_ROWS).select("feature", g2.alias("g2")).where(F.col("g2") >= MIN_G2)
           .orderBy(F.desc("g2"), "feature").limit(max_features))
    return sorted(r["feature"] for r in top.collect())


def _rows_of(index: dict[str, int]):
    def rows(batches):
        for batch in batches:
            texts, label = batch["text"].to_pylist(), batch["label"].to_pylist()
            numbers = lambda words: sorted(index[f] for f in features(words) & index.keys())
            words = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([numbers(w) for w in words], pa.list_(pa.int32())),
                 pa.array([[numbers(t) for t in twins(w)] for w in words], pa.list_(pa.list_(pa.int32()))),
                 pa.array(label, pa.int32())], ["own", "twins", "label"])
    return rows


def fit_logistic(rows: list[tuple[list[int], list[list[int]], int]], n_features: int, l2: float = 0.05,
                 penalty: float = 5.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Minimise the logistic loss + l2/2 |w|^2 + penalty/2 sum((w.(x' - x))^2)
    by accelerated gradient steps; the x' are the counterfactual
    twins of x."""
    def csr(lists):
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        cols = np.fromiter((j for x in lists for j in x), dtype=np.int64, count=int(lengths.sum()))
        return np.repeat(np.arange(len(lists)), lengths), cols

    y = np.array([r[2] for r in rows], dtype=float)
    ri, ci = csr([r[0] for r in rows])
    pairs = [(r[0], t) for r in rows for t in r[1]]
    gi, gj = csr([sorted(set(b) - set(a)) for a, b in pairs])
    li, lj = csr([sorted(set(a) - set(b)) for a, b in pairs])
    m = len(rows)
    di, dj = np.concatenate([gi, li]), np.concatenate([gj, lj])
    ds = np.concatenate([np.ones(len(gi)), -np.ones(len(li))])
    size = np.bincount(ri, minlength=m)
    # a bound of the curvature, so that no step size must be searched
    bound = 0.25 * (np.bincount(ci, weights=size[ri] + 1.0, minlength=n_features).max(initial=1.0)) + l2
    if len(pairs):
        width = np.bincount(di, minlength=len(pairs))
        bound += penalty * np.bincount(dj, weights=width[di].astype(float), minlength=n_features).max(initial=0.0)
    step = np.full(n_features, 1.0) / (0.25 * np.bincount(ci, weights=size[ri] + 1.0, minlength=n_features) + l2 +
                                       (bound if len(pairs) else 0.0) * np.isin(np.arange(n_features), dj))
    w, b = np.zeros(n_features), math.log((y.sum() + 1) / (m - y.sum() + 1))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = vb + np.bincount(ri, weights=vw[ci], minlength=m)
        r = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.bincount(ci, weights=r[ri], minlength=n_features) + l2 * vw
        if len(pairs):
            change = np.bincount(di, weights=ds * vw[dj], minlength=len(pairs))
            g += penalty * np.bincount(dj, weights=ds * change[di], minlength=n_features)
        nw, nb = vw - step * g, vb - r.sum() / (0.25 * (size + 1.0).sum())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def _fit(n_features: int):
    def fit(batches):
        rows = []
        for batch in batches:
            rows += zip(batch["own"].to_pylist(), batch["twins"].to_pylist(), batch["label"].to_pylist())
        rows.sort(key=lambda r: (r[2], r[0], r[1]))  # the same sums whatever the order of arrival
        b, w = fit_logistic(rows, n_features)
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([w.tolist()], pa.list_(pa.float64()))],
                                         ["bias", "weights"])
    return fit


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most about ``sample_rows`` labelled rows. One task fits the
    rows' selected feature numbers (a few dozen integers each). Without rows
    of both classes the model is the smoothed share of label 1."""
    sample = labelled_sample(docs, labels, "toxic", 3, 1, sample_rows)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((n_pos + 1) / (n_neg + 1))
    if not n_pos or not n_neg:
        return Model(prior)
    names = select_features(sample, n_pos, n_neg, max_features)
    if not names:
        return Model(prior)
    rows = sample.mapInArrow(_rows_of({f: i for i, f in enumerate(names)}),
                             "own array<int>, twins array<array<int>>, label int")
    fitted = rows.repartition(1).mapInArrow(_fit(len(names)), "bias double, weights array<double>")
    row = fitted.collect()[0]
    return Model(row["bias"], {f: w for f, w in zip(names, row["weights"]) if abs(w) > 1e-9})


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"],
                 pa.array([model.score(t) for t in batch["text"].to_pylist()], pa.float64())],
                ["doc_id", "held_out", "score"])
    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row, the whole text scored in one narrow pass. A
    null text counts as empty and gets the bias' score; repeated rows give
    repeated results; a null doc_id stays null and is not held out; an empty
    table gives no rows; other columns are ignored."""
    rows = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    out = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
