"""Categorical inputs of any width: a dictionary table and sparse vectors.

A category value has a number in a table instead of a column of its own. An
account's model input is a sparse vector: the standardised numeric inputs and, for each
of its category values, 1 / std of that value's indicator. The mean is not subtracted
(that would fill the vector); it only moves the intercept, which carries no
penalty, so the fit has the coefficients of the dense standardised model.
Nothing here collects the dictionary or plans a column per value; the fitted
coefficients are one number per input, as in any fit of Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exact import dround_col
from ..session import materialize
from .model import CAT_FEATURES, LABEL, NUM_FEATURES, Scaler
from .split import in_test, stratified_cuts

OFFSET = len(NUM_FEATURES)   # the numeric inputs come first


def dictionary(features: DataFrame, cats=CAT_FEATURES) -> DataFrame:
    """(cat, value, idx): every category value, numbered without gaps in the order
    of the columns and their values. Values are sorted in parallel; only the row
    counts of the sorted partitions meet in one window."""
    place = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col("cat"))
    values = (features.select(*cats).unpivot([], list(cats), "cat", "value").where("value IS NOT NULL").distinct()
              .orderBy(place, "value"))
    local = materialize(values.select("cat", "value", F.spark_partition_id().alias("part"),
                                      (F.monotonically_increasing_id() % (1 << 33)).alias("row")), "dictionary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return local.join(offsets, "part").select("cat", "value", (F.col("offset") + F.col("row") + OFFSET).alias("idx"))


def vector_frame(df: DataFrame, size: int, name: str = "features") -> DataFrame:
    """``df`` with its (index, value) array column ``name`` as a sparse vector.
    A vector is stored as a struct, so writing that struct and reading it as a vector
    needs no function of Python; the written table also cuts the lineage before a solver."""
    pairs = F.array_sort(F.filter(F.col(name), lambda p: p["idx"].isNotNull() & (p["value"] != 0)))
    parts = [F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
             F.transform(pairs, lambda p: p["idx"].cast("int")).alias("indices"),
             F.transform(pairs, lambda p: p["value"]).alias("values")]
    out = df.withColumn(name, F.struct(*parts))
    schema = StructType([f if f.name != name else type(f)(name, VectorUDT()) for f in out.schema.fields])
    return materialize(out, "vectors", read_as=schema)


@dataclass
class Fitted:
    model: LogisticRegressionModel
    dense_intercept: float    # of the model on centred inputs


class SparseDesign:
    """Model inputs of a filled feature table as sparse vectors, fitted and
    scored without a column per category value."""

    def __init__(self, features: DataFrame, cats=CAT_FEATURES):
        self.features, self.cats = features, list(cats)

    @cached_property
    def labelled(self) -> DataFrame:
        cuts = stratified_cuts(self.features, LABEL)
        nums = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in NUM_FEATURES]
        return (self.features.where(F.col(LABEL).isNotNull())
                .select("account_id", F.col(LABEL).cast("int").alias(LABEL), in_test(cuts, LABEL).alias("is_test"),
                        *self.cats, *nums))

    @cached_property
    def train(self) -> DataFrame:
        return self.labelled.where(~F.col("is_test"))

    @cached_property
    def class_counts(self) -> dict[int, int]:
        return {r[LABEL]: r["n"] for r in self.train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}

    @property
    def n_train(self) -> int:
        return sum(self.class_counts.values())

    @cached_property
    def dictionary(self) -> DataFrame:
        """(cat, value, idx, n_train, mean, std): statistics of the indicators
        over the training rows; a value's share p gives mean p and variance p (1 - p)."""
        seen = (self.train.select(*self.cats).unpivot([], self.cats, "cat", "value").where("value IS NOT NULL")
                .groupBy("cat", "value").agg(F.count(F.lit(1)).alias("n_train")))
        p = F.coalesce(F.col("n_train") / F.lit(max(self.n_train, 1)), F.lit(0.0))
        sd = F.sqrt(p * (1 - p))
        return materialize(dictionary(self.features, self.cats).join(seen, ["cat", "value"], "left").select(
            "cat", "value", "idx", F.coalesce("n_train", F.lit(0)).alias("n_train"), p.alias("mean"),
            F.when(sd == 0, 1.0).otherwise(sd).alias("std")), "dictionary")

    @cached_property
    def size(self) -> int:
        return OFFSET + self.dictionary.count()

    @cached_property
    def scaler(self) -> Scaler:
        return Scaler.fit(self.train, list(NUM_FEATURES))

    @cached_property
    def vectors(self) -> DataFrame:
        """(account_id, label, is_test, features): one join per categorical column
        (not per value); AQE splits the rows of a frequent value."""
        rows = self.labelled
        for c in self.cats:
            d = self.dictionary.where(F.col("cat") == c).select(
                F.col("value").alias(c), F.struct("idx", (1 / F.col("std")).alias("value")).alias(f"{c}__pair"))
            rows = rows.join(d, c, "left")
        pair = [F.struct(F.lit(i).cast("long").alias("idx"), self.scaler.z(f).alias("value"))
                for i, f in enumerate(NUM_FEATURES)]
        pairs = F.array(*pair, *[F.struct(F.col(f"{c}__pair")["idx"].alias("idx"),
                                          F.col(f"{c}__pair")["value"].alias("value")) for c in self.cats])
        return vector_frame(rows.select("account_id", LABEL, "is_test", pairs.alias("features")), self.size)

    def weighted(self) -> DataFrame:
        """Training vectors with balanced class weights."""
        counts, n = self.class_counts, self.n_train
        if len(counts) < 2:
            raise ValueError("training data has a single class")
        w = F.when(F.col(LABEL) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
        return self.vectors.where(~F.col("is_test")).select("features", F.col(LABEL).cast("double").alias("y"),
                                                            w.alias("w"))

    def fit(self, max_iter: int = 1000) -> Fitted:
        """The objective of ``model.fit_logistic`` over the sparse vectors."""
        lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / self.n_train,
                                elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=max_iter,
                                tol=1e-12)
        m = lr.fit(self.weighted())
        shift = (self.dictionary.join(self._numbers(m.coefficients.toArray(), "b"), "idx")
                 .agg(F.sum(F.col("b") * F.col("mean") / F.col("std"))).first()[0])
        return Fitted(m, float(m.intercept) + (shift or 0.0))

    def _numbers(self, values, name: str) -> DataFrame:
        """(idx, name) of a vector over the inputs."""
        import pandas as pd
        spark = self.features.sparkSession
        return spark.createDataFrame(pd.DataFrame({"idx": range(len(values)), name: values}),
                                     f"idx long, {name} double")

    @cached_property
    def names(self) -> DataFrame:
        """(idx, feature): numeric inputs by name, category values as column=value."""
        nums = self.features.sparkSession.createDataFrame(list(enumerate(NUM_FEATURES)), "idx long, feature string")
        return nums.unionByName(self.dictionary.select("idx", F.concat_ws("=", "cat", "value").alias("feature")))

    def coefficients(self, fitted: Fitted) -> DataFrame:
        return self.names.join(self._numbers(fitted.model.coefficients.toArray(), "coefficient"), "idx").select(
            "feature", "coefficient")

    def scores(self, fitted: Fitted) -> DataFrame:
        """(account_id, label, is_test, probability) of every labelled account."""
        p = vector_to_array("probability")[1]
        return fitted.model.transform(self.vectors).select("account_id", LABEL, "is_test", p.alias("probability"))

    def gradient(self, fitted: Fitted) -> DataFrame:
        """(feature, gradient) of the penalised objective per training row at the
        fitted point: the mean of w (p - y) x, plus coefficient / n, and the
        intercept's own. One pass sums whole vectors in the tasks, for positive
        and negative residuals apart, as weights may not be negative. The objective is strictly
        convex, so the point is its minimum exactly if all are 0."""
        scored = fitted.model.transform(self.weighted())
        r = F.col("w") * (vector_to_array("probability")[1] - F.col("y"))
        rows = scored.select("features", F.greatest(r, F.lit(0.0)).alias("up"), F.greatest(-r, F.lit(0.0)).alias("down"))
        total = Summarizer.metrics("sum")
        sums = rows.agg(vector_to_array(total.summary(F.col("features"), F.col("up"))["sum"]).alias("up"),
                        vector_to_array(total.summary(F.col("features"), F.col("down"))["sum"]).alias("down"),
                        F.sum(F.col("up") - F.col("down")).alias("rest"))
        n = F.lit(float(self.n_train))
        each = sums.select(F.posexplode(F.zip_with("up", "down", lambda a, b: a - b)).alias("idx", "g"))
        own = self._numbers(fitted.model.coefficients.toArray(), "b")
        inputs = (each.join(own, "idx").join(self.names, "idx")
                  .select("feature", ((F.col("g") + F.col("b")) / n).alias("gradient")))
        return inputs.unionByName(sums.select(F.lit("intercept").alias("feature"), (F.col("rest") / n).alias("gradient")))

    def entries(self) -> DataFrame:
        """(account_id, idx, value) of the vectors' non-zero entries."""
        v = F.col("features")
        dense = self.vectors.select("account_id", F.posexplode(vector_to_array(v)).alias("idx", "value"))
        return dense.where("value <> 0").select("account_id", F.col("idx").cast("long").alias("idx"),
                                                dround_col(F.col("value"), 6).alias("value"))
