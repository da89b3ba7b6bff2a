"""Upgrade-propensity model: encoding, split, scaling, linear scorer,
additive explanations, evaluation, and the Spark ML fit.

Scoring and explaining are plain column expressions over broadcast scalars
(scaler statistics and coefficients), so they run in one narrow pass over
the accounts with no shuffle and no Python UDF. Evaluation aggregates first
(per distinct rounded score) and only then orders, so no window ever sees
raw account rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import dround
from .split import in_test

LABEL = "has_upgraded"
# The model's inputs.
NUM_FEATURES = [
    "total_usage_count", "unique_features_used", "total_usage_duration", "beta_feature_usage",
    "total_errors", "total_mrr", "total_seats", "n_subscriptions", "n_tickets",
    "avg_satisfaction", "n_escalations", "is_annual", "auto_renew",
]
CAT_FEATURES = ["plan_tier", "industry", "referral_source"]
DENSE_VALUES = 10_000  # categories that may get a column each

# Coefficients of the standardised features as published for
# the reference model (all others 0). The intercept is not published; 0.
PUBLISHED_COEFFICIENTS = {
    "total_usage_duration": 0.570,
    "total_usage_count": -0.496,
    "n_subscriptions": 0.417,
    "n_escalations": 0.220,
    "n_tickets": -0.213,
    "total_mrr": 0.194,
    "is_annual": -0.029,
    "avg_satisfaction": 0.015,
    "auto_renew": 0.000,
}
PUBLISHED_INTERCEPT = 0.0


def dummy_name(cat: str, value: str) -> str:
    """Column name of a category; a value that is more than letters, digits
    and single blanks also gets digits of its md5, so that no two values
    of a column share a name."""
    name = f"{cat}_{re.sub(r'[^0-9A-Za-z]+', '_', value)}"
    plain = re.fullmatch(r"[0-9A-Za-z]+( [0-9A-Za-z]+)*", value)
    return name if plain else f"{name}_{hashlib.md5(value.encode()).hexdigest()[:12]}"


def vocabularies(features: DataFrame, cats=CAT_FEATURES) -> dict[str, list[str]]:
    """Sorted distinct values of each categorical column, for inputs with one
    named column per value. Vocabularies of more than DENSE_VALUES values are refused:
    ``operators.sparse`` keeps them in a table and fits and scores sparse vectors."""
    long = (features.select(*cats).unpivot([], list(cats), "cat", "value")
            .where(F.col("value").isNotNull()).distinct())
    rows = long.limit(DENSE_VALUES + 1).collect()
    if len(rows) > DENSE_VALUES:
        raise ValueError(f"more than {DENSE_VALUES} categories; use operators.sparse")
    vocab: dict[str, list[str]] = {c: [] for c in cats}
    for r in rows:
        vocab[r["cat"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def feature_names(vocab: dict[str, list[str]]) -> list[str]:
    return NUM_FEATURES + [dummy_name(c, v) for c in CAT_FEATURES for v in vocab[c]]


def encoded_columns(vocab: dict[str, list[str]]) -> dict[str, Column]:
    """Model inputs as expressions over a feature table: numeric inputs with
    NULL -> 0 and booleans -> 0/1, one-hot indicators for the training
    vocabulary (an unseen or NULL value gives all zeros)."""
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in NUM_FEATURES}
    for c in CAT_FEATURES:
        for v in vocab[c]:
            cols[dummy_name(c, v)] = F.when(F.col(c) == v, 1).otherwise(0)
    return cols


def encode(features: DataFrame, vocab: dict[str, list[str]],
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Model matrix: account id, 0/1 label, inputs (see ``encoded_columns``)."""
    enc = encoded_columns(vocab)
    return features.select(F.col("account_id"), F.col(LABEL).cast("int").alias(LABEL),
                           *[F.col(k) for k in keep],
                           *[e.alias(n) for n, e in enc.items()])


def split(encoded: DataFrame, cuts: dict[int, str]) -> DataFrame:
    """Labelled rows with an ``is_test`` flag: a fifth of every class (see ``split``)."""
    return encoded.where(F.col(LABEL).isNotNull()).withColumn("is_test", in_test(cuts, LABEL))


@dataclass
class Scaler:
    """Population mean / std per feature, fitted on the training rows.

    Fitting is one global aggregate (partial per partition, one merged row);
    the 2 x n_features numbers are model parameters and are bound into the
    scoring expressions as literals, like coefficients.
    """

    names: list[str]
    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, names: list[str]) -> Scaler:
        aggs = []
        for f in names:
            aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
        row = train.agg(*aggs).first()
        return cls(names, {f: row[f"m_{f}"] for f in names}, {f: row[f"s_{f}"] for f in names})

    def z(self, f: str, x: Column | None = None) -> Column:
        """Standardised value of feature f (its input column, or ``x``); a
        zero or undefined std divides by 1."""
        sd = self.std[f]
        sd = 1.0 if sd is None or sd == 0 else sd
        m = 0.0 if self.mean[f] is None else self.mean[f]
        x = F.col(f) if x is None else x
        return (x - F.lit(float(m))) / F.lit(float(sd))

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[self.z(f).alias(f) for f in self.names])


@dataclass
class LinearModel:
    """Coefficients on standardised features and an intercept."""

    coefficients: dict[str, float] = field(default_factory=lambda: dict(PUBLISHED_COEFFICIENTS))
    intercept: float = PUBLISHED_INTERCEPT

    def active(self, names: list[str]) -> list[tuple[str, float]]:
        return [(f, self.coefficients[f]) for f in names if self.coefficients.get(f, 0.0) != 0.0]

    def logit(self, names: list[str], col=F.col) -> Column:
        """Intercept + sum of beta * z over non-zero coefficients, in feature
        order (``col`` maps a feature name to its standardised column)."""
        expr = F.lit(float(self.intercept))
        for f, b in self.active(names):
            expr = expr + F.lit(float(b)) * col(f)
        return expr

    def phi(self, f: str, col=F.col) -> Column:
        """Additive contribution of feature f: beta * (z - background mean of z).
        The background is the training set, whose standardised mean is 0."""
        return F.lit(float(self.coefficients.get(f, 0.0))) * col(f)


def probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def readiness_band(score: Column) -> Column:
    """Right-closed bands; 0 (or anything outside (0, 100]) has no band."""
    return (F.when((score > 0) & (score <= 25), "Low")
             .when((score > 25) & (score <= 50), "Medium")
             .when((score > 50) & (score <= 75), "High")
             .when((score > 75) & (score <= 100), "Very High"))


def top_reasons(model: LinearModel, names: list[str], n: int = 3, col=F.col) -> Column:
    """'feat (+0.12) | feat (-0.08) | ...' for the n largest |contribution|.

    Contributions are rounded to 6 decimals before ranking (so engines agree
    on ties); ties keep feature order. Built from array/struct functions: no
    UDF, no shuffle.
    """
    items = []
    for pos, f in enumerate(names):
        phi6 = model.phi(f, col).cast("decimal(38,6)")
        items.append(F.struct((-F.abs(phi6)).alias("k"), F.lit(pos).alias("pos"),
                              F.lit(f).alias("name"), phi6.alias("phi")))
    top = F.slice(F.sort_array(F.array(*items)), 1, n)
    text = F.transform(top, lambda s: F.concat(
        s["name"], F.lit(" ("), F.when(s["phi"] > 0, "+").otherwise("-"),
        F.round(F.abs(s["phi"]), 2).cast("decimal(38,2)").cast("string"), F.lit(")")))
    return F.array_join(text, " | ")


# --------------------------------------------------------------------------
# evaluation over a frame with columns (label, score)
# --------------------------------------------------------------------------
def score_histogram(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives / negatives per distinct score (the only input evaluation
    needs; its size is bounded by the score's rounding, not by rows)."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"))


def auc(scored: DataFrame, label: str = LABEL, score: str = "probability") -> DataFrame:
    """Area under the ROC curve with ties counted one half (Mann-Whitney).

    AUC = sum over scores of pos * (neg below + neg equal / 2) / (P * N),
    accumulated in integers and divided once.
    """
    h = score_histogram(scored, label, score)
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    pairs = h.withColumn("neg_below", below).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(2 * F.col("pos") * F.col("neg_below") + F.col("pos") * F.col("neg")).alias("_u2"))
    return pairs.select("positives", "negatives",
                        dround("_u2 / (2.0D * positives * negatives)", 6).alias("auc"))


def roc_curve(scored: DataFrame, label: str = LABEL, score: str = "probability") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first, plus
    the origin (threshold NULL)."""
    h = score_histogram(scored, label, score)
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    cum = (h.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
            .withColumn("P", F.sum("pos").over(tot)).withColumn("N", F.sum("neg").over(tot)))
    pts = cum.select(F.col("score").alias("threshold"),
                     dround("fp / NULLIF(N, 0)", 6).alias("fpr"),
                     dround("tp / NULLIF(P, 0)", 6).alias("tpr"))
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def classification_report(scored: DataFrame, label: str = LABEL,
                          pred: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and
    weighted averages, from one confusion-count aggregate."""
    y, p = F.col(label), F.col(pred)
    cm = scored.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                    F.count_if((y == 0) & (p == 1)).alias("fp"),
                    F.count_if((y == 1) & (p == 0)).alias("fn"),
                    F.count_if((y == 0) & (p == 0)).alias("tn"))

    def ratio(a: str, b: str) -> str:
        return f"CAST({a} AS DOUBLE) / NULLIF({b}, 0)"

    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    s1, s0, n = "(tp + fn)", "(tn + fp)", "(tp + fp + fn + tn)"
    rows = [
        ("0", p0, r0, f0, s0),
        ("1", p1, r1, f1, s1),
        ("accuracy", "NULL", "NULL", ratio("tp + tn", n), n),
        ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
        ("weighted avg", f"(({p0}) * {s0} + ({p1}) * {s1}) / {n}",
         f"(({r0}) * {s0} + ({r1}) * {s1}) / {n}", f"(({f0}) * {s0} + ({f1}) * {s1}) / {n}", n),
    ]
    # One confusion row, expanded to the five report rows.
    structs = [F.struct(F.lit(name).alias("class_label"),
                        dround(pr, 6).alias("precision"), dround(rc, 6).alias("recall"),
                        dround(fs, 6).alias("f1_score"),
                        F.expr(sup).cast("bigint").alias("support"))
               for name, pr, rc, fs, sup in rows]
    return cm.select(F.inline(F.array(*structs)))


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights n / (2 * n_class), as a (label, n, weight) frame."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # two rows
    return per.withColumn("weight", total / (2 * F.col("n")))


def fit_logistic(train_z: DataFrame, names: list[str], label: str = LABEL,
                 max_iter: int = 1000) -> LinearModel:
    """L2 logistic regression with balanced class weights on standardised
    features, objective 1/2 |b|^2 + sum_i w_i * loss_i.

    Spark ML minimises (1/sum w) sum w_i loss_i + reg/2 |b|^2; balanced
    weights sum to n, so reg = 1/n gives the same optimum. Gradients are
    computed on the executors (treeAggregate); the driver only holds the
    coefficient vector.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[label]: r["n"] for r in train_z.groupBy(label).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("training data has a single class")
    w = F.when(F.col(label) == 1, F.lit(n / (2.0 * counts[1]))).otherwise(F.lit(n / (2.0 * counts[0])))
    data = (VectorAssembler(inputCols=names, outputCol="features")
            .transform(train_z.withColumn("w", w).withColumn("y", F.col(label).cast("double")))
            .select("features", "y", "w"))
    from ..session import materialize
    data = materialize(data)  # lineage cut before the iterative solver
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w",
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                            fitIntercept=True, maxIter=max_iter, tol=1e-10)
    m = lr.fit(data)
    return LinearModel(dict(zip(names, [float(c) for c in m.coefficients])), float(m.intercept))


def coefficient_table(spark, model: LinearModel, names: list[str]) -> DataFrame:
    rows = [(f, float(model.coefficients.get(f, 0.0))) for f in names] + [("intercept", model.intercept)]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature")

