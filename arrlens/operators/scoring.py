"""Scoring run: from the account feature table to evaluated test scores and
a scored, explained expansion universe.

Everything is a lazy plan except two tiny driver round trips: the
categorical vocabulary (a few values) and, only when a model is fitted, the
coefficient vector.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import dround, dround_col
from ..sources.fixtures import Tables
from . import model as M
from . import snapshots
from ..session import TableScope, materialize, session_key
from .features import Snapshot, fill_features, raw_features
from .profile import universe_filter
from .split import stratified_cuts

OUTPUT_COLS = ["account_id", "account_name", "industry", "country", "plan_tier",
               "referral_source", "total_mrr", "total_seats", "total_usage_count",
               "unique_features_used", "avg_satisfaction", "n_escalations"]


def _z(f: str) -> str:
    return f"z__{f}"


class ScoringRun:
    """Train-set scaler + linear model applied to test rows and to the
    expansion universe of one snapshot."""

    _shared: dict = {}

    def __init__(self, t: Tables, model: M.LinearModel | None = None,
                 snap: Snapshot = Snapshot(), reference: ScoringRun | None = None,
                 raw: DataFrame | None = None):
        self.t = t
        self.scope = reference.scope if reference is not None else TableScope(t.spark)
        self._raw = raw
        self.snap = snap
        self.model = model or M.LinearModel()
        self._reference = reference

    @classmethod
    def shared(cls, t: Tables, snap: Snapshot = Snapshot()) -> ScoringRun:
        """The session's run for these source tables and snapshot.

        Like the analysis' stage chaining through a persisted feature table,
        the feature table, vocabulary and scaler are materialised once and
        every report reads them. A manifest of the source files (path, length,
        time) is part of the key: if a file is added, removed or rewritten, the next report
        builds anew, and the old run's tables go once no result uses them
        (see ``TableScope``). Frames given directly (``FrameTables``) are never shared.
        """
        if not t.sf_dir:
            return cls(t, snap=snap)
        key = (session_key(t.spark), t.sf_dir, snap)
        known = cls._shared.get(key)
        if known is None or known.t.manifest != t.manifest:
            run = cls(Tables(t.spark, t.sf_dir), snap=snap)
            run.t.manifest = t.manifest
            cls._shared[key] = run
            if known is not None:
                known.scope.release()
        return cls._shared[key]

    @classmethod
    def clear_shared(cls) -> None:
        """Start over; the runs' tables go with the last result that uses them."""
        for run in cls._shared.values():
            run.scope.release()
        cls._shared.clear()

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table of this run."""
        with self.scope:
            return materialize(df, name)

    # -- training side -------------------------------------------------------
    @cached_property
    def raw_features(self) -> DataFrame:
        """Joined per-account signals for all accounts, checkpointed once; both
        the training table and the universe table are read from it."""
        if self._raw is not None:
            return self._raw
        return self.kept(raw_features(self.t, None, self.snap), "features-raw")

    @cached_property
    def earlier(self) -> dict[int, ScoringRun]:
        """Runs as of earlier dates (by lag in days) with this run's vocabulary, scaler
        and model, all on one feature build."""
        dates = snapshots.lag_dates(self.t)
        if not dates:
            return {}
        raw = self.kept(snapshots.raw_features(self.t, dates), "features-earlier")
        return {n: ScoringRun(self.t, model=self.model, reference=self,
                              raw=raw.where(F.col("snapshot") == n).drop("snapshot")) for n in dates}

    @cached_property
    def features(self) -> DataFrame:
        """Filled training table, checkpointed: the vocabulary, the scaler fit
        and every scoring projection read it (fills computed once)."""
        return self.kept(fill_features(self.raw_features), "features")

    @cached_property
    def vocab(self) -> dict[str, list[str]]:
        if self._reference is not None:
            return self._reference.vocab
        return M.vocabularies(self.features)

    @cached_property
    def names(self) -> list[str]:
        return M.feature_names(self.vocab)

    @cached_property
    def encoded(self) -> DataFrame:
        return M.encode(self.features, self.vocab)

    @cached_property
    def labelled(self) -> DataFrame:
        return M.split(self.encoded, self.cuts)

    @cached_property
    def cuts(self) -> dict[int, str]:
        """Hash of the last test row per class (three small counts)."""
        return stratified_cuts(self.features, M.LABEL)

    @cached_property
    def train(self) -> DataFrame:
        return self.labelled.where(~F.col("is_test"))

    @cached_property
    def test(self) -> DataFrame:
        return self.labelled.where(F.col("is_test"))

    @cached_property
    def scaler(self) -> M.Scaler:
        if self._reference is not None:
            return self._reference.scaler
        return M.Scaler.fit(self.train, self.names)

    def standardized(self) -> DataFrame:
        """z-scores of every labelled account (train statistics)."""
        return self.labelled.select("account_id", M.LABEL, "is_test",
                                    *[dround_col(self.scaler.z(f), 6).alias(f"z_{f}")
                                      for f in self.names])

    def fitted(self, max_iter: int = 1000) -> M.LinearModel:
        train_z = self.scaler.transform(self.train, [M.LABEL])
        return M.fit_logistic(train_z, self.names, max_iter=max_iter)

    # -- test-set evaluation -------------------------------------------------
    def test_scores(self) -> DataFrame:
        """Test rows with logit, probability and predicted class."""
        z = {f: self.scaler.z(f) for f in self.names}
        logit = self.model.logit(self.names, lambda f: z[f])
        p = M.probability(logit)
        return self.test.select(
            "account_id", M.LABEL,
            dround_col(logit, 6).alias("logit"),
            dround_col(p, 6).alias("probability"),
            (p > 0.5).cast("int").alias("predicted"))

    def auc(self) -> DataFrame:
        return M.auc(self.test_scores())

    def roc_curve(self) -> DataFrame:
        return M.roc_curve(self.test_scores())

    def classification_report(self) -> DataFrame:
        return M.classification_report(self.test_scores())

    def contribution_summary(self) -> DataFrame:
        """Global importance on the test set: mean |contribution| per feature,
        and its direction (contribution = beta * z rises with the feature
        value when beta > 0, so the direction is the coefficient's sign)."""
        z = {f: self.scaler.z(f) for f in self.names}
        row = self.test.agg(*[F.avg(F.abs(self.model.phi(f, lambda g: z[g]))).alias(f"a_{f}")
                              for f in self.names])
        long = row.select(F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("a"),
                     F.lit(float(math.copysign(1.0, self.model.coefficients.get(f, 0.0)))
                           if self.model.coefficients.get(f, 0.0) != 0.0 else 0.0).alias("direction"))
            for f in self.names])))
        return long.select("feature", dround("a", 6).alias("mean_abs_contribution"), "direction")

    # -- expansion universe --------------------------------------------------
    @cached_property
    def universe_features(self) -> DataFrame:
        """Universe rows of the checkpointed raw table, filled with medians
        taken over the universe. Per-account signals do not depend on the
        population, so this equals rebuilding them for the universe's ids."""
        return self.kept(fill_features(self.raw_features.where(universe_filter())), "features-universe")

    @cached_property
    def universe_scored(self) -> DataFrame:
        """Universe accounts with z-scores, logit, probability, readiness
        score and band, in one projection over the feature rows."""
        enc = M.encoded_columns(self.vocab)
        u = self.universe_features
        zcols = [self.scaler.z(f, enc[f]).alias(_z(f)) for f in self.names]
        base = u.select(*OUTPUT_COLS, M.LABEL, *zcols)
        logit = self.model.logit(self.names, lambda f: F.col(_z(f)))
        p = M.probability(logit)
        return (base.withColumn("logit", logit)
                    .withColumn("upgrade_probability", dround_col(p, 6))
                    .withColumn("expansion_readiness_score", dround_col(p * 100, 1))
                    .withColumn("readiness_band", M.readiness_band(F.col("expansion_readiness_score"))))

    def readiness_score(self) -> DataFrame:
        return self.universe_scored.select("account_id", "upgrade_probability",
                                           "expansion_readiness_score")

    def readiness_bands(self) -> DataFrame:
        return self.universe_scored.select("account_id", "expansion_readiness_score",
                                           "readiness_band")

    def contributions(self) -> DataFrame:
        s = self.universe_scored
        return s.select("account_id", dround_col(F.col("logit"), 6).alias("logit"),
                        *[dround_col(self.model.phi(f, lambda g: F.col(_z(g))), 6)
                          .alias(f"phi_{f}") for f in self.names])

    def top_reasons(self) -> DataFrame:
        return self.universe_scored.select(
            "account_id", M.top_reasons(self.model, self.names, 3, lambda g: F.col(_z(g)))
            .alias("top_shap_reasons"))

    @cached_property
    def scored_accounts(self) -> DataFrame:
        """The scored output: 16 columns per universe account."""
        s = self.universe_scored
        return s.select(*OUTPUT_COLS, "upgrade_probability", "expansion_readiness_score",
                        "readiness_band",
                        M.top_reasons(self.model, self.names, 3, lambda g: F.col(_z(g)))
                        .alias("top_shap_reasons"))

    def score_distribution(self) -> DataFrame:
        return (self.universe_scored.where(F.col("readiness_band").isNotNull())
                .groupBy("readiness_band")
                .agg(F.count(F.lit(1)).alias("accounts"),
                     F.avg("expansion_readiness_score").alias("_avg"),
                     F.min("expansion_readiness_score").alias("min_score"),
                     F.max("expansion_readiness_score").alias("max_score"))
                .select("readiness_band", "accounts", dround("_avg", 1).alias("avg_score"),
                        "min_score", "max_score"))

    def top_scored(self, k: int = 10) -> DataFrame:
        return (self.scored_accounts
                .orderBy(F.desc("expansion_readiness_score"), "account_id").limit(k)
                .select("account_id", "account_name", "industry", "plan_tier", "total_mrr",
                        "expansion_readiness_score", "readiness_band", "top_shap_reasons"))

    def score_histogram(self, width: float = 5.0) -> DataFrame:
        """Counts per 5-point score bin; 100 falls in the last bin."""
        nbins = int(100 / width)
        b = F.least(F.floor(F.col("expansion_readiness_score") / width), F.lit(nbins - 1))
        return (self.universe_scored.groupBy((b * width).cast("double").alias("bin_start"))
                .agg(F.count(F.lit(1)).alias("accounts")))

    def engagement_score(self) -> DataFrame:
        """One engagement signal replacing the two collinear usage columns:
        the mean of their standardised values (train statistics)."""
        zd, zc = self.scaler.z("total_usage_duration"), self.scaler.z("total_usage_count")
        return self.labelled.select("account_id", M.LABEL,
                                    dround_col((zd + zc) / 2, 6).alias("engagement_score"))
