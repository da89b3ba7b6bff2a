"""Stratified split, wide vocabularies and the fitted point's gradient."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arrlens.operators import model as M
from arrlens.operators.scoring import ScoringRun
from arrlens.operators.sparse import OFFSET, SparseDesign, dictionary
from arrlens.operators.split import in_test, stratified_cuts
from arrlens.sources.fixtures import Tables


def in_fifth(ids_by_class):
    out = set()
    for ids in ids_by_class.values():
        order = sorted(ids, key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())
        out |= set(order[:(2 * len(ids) + 5) // 10])
    return out


@pytest.mark.parametrize("sizes", [(0, 0), (1, 0), (2, 3), (7, 1), (5000, 13), (20, 20003)])
def test_split_takes_a_fifth_of_every_class(spark, sizes):
    rows = [(i, c == 1) for c, n in enumerate(sizes) for i in range(c * 10 ** 6, c * 10 ** 6 + n)]
    df = spark.createDataFrame(rows + [(-1, None), (None, True)], "account_id bigint, has_upgraded boolean")
    got = {r.account_id for r in df.where(in_test(stratified_cuts(df, "has_upgraded"), "has_upgraded")).collect()}
    want = in_fifth({c: [i for i, y in rows if y == c] for c in (False, True)})
    assert got == want
    for c, n in enumerate(sizes):
        assert abs(sum(i // 10 ** 6 == c for i in got) - n / 5) <= 1


def test_repeated_ids_stay_together(spark):
    df = spark.createDataFrame([(i % 50, True) for i in range(500)], "account_id bigint, has_upgraded boolean")
    got = Counter(r.account_id for r in df.where(in_test(stratified_cuts(df, "has_upgraded"), "has_upgraded")).collect())
    assert len(got) == 10 and set(got.values()) == {10}


def wide_features(spark, n, values, seed=3):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({f: rng.integers(0, 100, n).astype(float) for f in M.NUM_FEATURES})
    df["is_annual"], df["auto_renew"] = rng.random(n) < .5, rng.random(n) < .5
    df.insert(0, "account_id", np.arange(n))
    df["plan_tier"] = rng.choice(["Basic", "Pro", None], n)
    df["industry"] = [f"i{k}" for k in rng.permutation(np.arange(n) % values)]
    df["referral_source"] = None
    odds = (df["total_usage_duration"] - 50) / 30 + (df["plan_tier"] == "Pro")
    df[M.LABEL] = rng.random(n) < 1 / (1 + np.exp(-odds))
    types = ", ".join(f"{c} {'bigint' if c == 'account_id' else 'boolean' if df[c].dtype == bool else 'string' if c in M.CAT_FEATURES else 'double'}"
                      for c in df.columns)
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), types)


def test_dictionary_is_dense_and_ordered(spark):
    f = wide_features(spark, 400, 37)
    rows = dictionary(f).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(OFFSET, OFFSET + len(rows)))
    assert [(r.cat, r.value) for r in rows] == (
        [("plan_tier", v) for v in ("Basic", "Pro")] + [("industry", v) for v in sorted(f"i{k}" for k in range(37))])


def test_sparse_fit_equals_dense_fit(spark, sf_dir):
    run = ScoringRun(Tables(spark, sf_dir))
    dense = run.fitted()
    design = SparseDesign(run.features)
    fitted = design.fit()
    got = {r.feature: r.coefficient for r in design.coefficients(fitted).collect()}
    plain = {M.dummy_name(*k.split("=", 1)) if "=" in k else k: v for k, v in got.items()}
    assert plain.keys() == dense.coefficients.keys()
    for k, v in plain.items():
        assert abs(v - dense.coefficients[k]) < 1e-4, k
    assert abs(fitted.dense_intercept - dense.intercept) < 1e-4
    # and so do the scores
    scored = ScoringRun(run.t, model=dense, reference=run).test_scores().select("account_id", "probability")
    both = scored.join(design.scores(fitted).withColumnRenamed("probability", "p"), "account_id")
    assert both.count() == run.test.count()
    assert both.agg(F.max(F.abs(F.col("probability") - F.col("p")))).first()[0] < 1e-4


def test_a_hundred_thousand_values_fit_and_score(spark):
    f = wide_features(spark, 120_000, 100_000)
    with pytest.raises(ValueError, match="sparse"):
        M.vocabularies(f)
    design = SparseDesign(f)
    assert design.size == OFFSET + 2 + 100_000
    fitted = design.fit(max_iter=60)
    got = {r.feature: r.coefficient for r in design.coefficients(fitted).where("feature NOT LIKE 'industry%'").collect()}
    assert got["total_usage_duration"] > 0.5 and got["plan_tier=Pro"] > 0.1
    scores = design.scores(fitted)
    assert scores.count() == 120_000
    assert scores.where("probability BETWEEN 0 AND 1").count() == 120_000


def test_gradient_is_zero_at_the_fit_and_only_there(spark):
    design = SparseDesign(wide_features(spark, 500, 9))
    fitted = design.fit()
    at = {r.feature: r.gradient for r in design.gradient(fitted).collect()}
    assert len(at) == design.size + 1 and max(map(abs, at.values())) < 1e-6
    early = design.fit(max_iter=1)
    # brute force at another point
    rows = design.weighted().collect()
    x = np.array([r.features.toArray() for r in rows])
    y, w = np.array([r.y for r in rows]), np.array([r.w for r in rows])
    b = early.model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ b + early.model.intercept)))
    want = (x.T @ (w * (p - y)) + b) / len(y)
    got = {r.feature: r.gradient for r in design.gradient(early).collect()}
    names = {r.idx: r.feature for r in design.names.collect()}
    assert max(abs(got[names[i]] - g) for i, g in enumerate(want)) < 1e-9
    assert abs(got["intercept"] - (w * (p - y)).sum() / len(y)) < 1e-9
    assert max(map(abs, got.values())) > 1e-3


def test_category_of_the_test_rows_only_and_single_class(spark):
    f = wide_features(spark, 60, 60)     # every industry value once: a fifth is in test rows only
    design = SparseDesign(f)
    d = design.dictionary.where("cat = 'industry'").collect()
    assert {r.n_train for r in d} == {0, 1} and all(r["std"] == 1.0 for r in d if not r.n_train)
    assert design.scores(design.fit()).count() == 60
    with pytest.raises(ValueError, match="single class"):
        SparseDesign(f.withColumn(M.LABEL, F.lit(True))).fit()


def test_coefficients_by_size(spark, sf_dir):
    from arrlens.plans.registry import queries
    for key in ("lr_fit", "lr_coefficients"):
        sizes = [r.abs_coefficient for r in queries()[key](spark, sf_dir).collect()]
        assert sizes == sorted(sizes, reverse=True)
