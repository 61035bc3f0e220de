import numpy as np
import pytest

from ovelia.operators.numerics import SVC, OneClass, smo, svdd


def test_smo_reaches_the_optimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 12))
    q, y = a @ a.T + np.eye(12), np.where(np.arange(12) % 2, 1.0, -1.0)
    alpha, _ = smo(q, -np.ones(12), y, np.full(12, 0.3), np.zeros(12), tolerance=1e-9)
    assert abs(y @ alpha) < 1e-9 and alpha.min() >= -1e-12 and alpha.max() <= 0.3 + 1e-12
    best = 0.5 * alpha @ q @ alpha - alpha.sum()
    for _ in range(300):
        i, j = rng.choice(12, 2, replace=False)
        t = rng.normal() * 1e-3
        b = alpha.copy()
        b[i] += y[i] * t
        b[j] -= y[j] * t
        if b.min() >= 0 and b.max() <= 0.3:
            assert 0.5 * b @ q @ b - b.sum() >= best - 1e-7


def test_svc_separates():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 5])
    y = np.repeat([0, 1], 40)
    assert ((SVC().fit(x, y).decide(x) > 0).astype(int) == y).all()


def test_one_class_leaves_out_about_nu():
    x = np.random.default_rng(2).normal(size=(200, 3))
    out = (OneClass(0.2).fit(x).decide(x) < -1e-6).mean()
    assert 0.1 < out < 0.3


def test_svdd_is_feasible():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 2)), np.where(np.arange(30) < 20, 1.0, -1.0)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    a = svdd(k, y, np.full(30, 0.2))
    assert abs(y @ a - 1) < 1e-9 and a.min() >= -1e-12 and a.max() <= 0.2 + 1e-12


def test_too_many_rows():
    with pytest.raises(ValueError):
        SVC().fit(np.zeros((6001, 1)), np.zeros(6001))


def test_smote_of_one_minority_row(spark):
    from pyspark.sql import functions as F

    from ovelia.operators import samplers as sm

    x = spark.range(12).select("id", (F.col("id") == 0).cast("int").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    s = sm.SMOTE()
    got = s.resample(x).where("label = 1").collect()
    assert len(got) == 11 and s.stats_["added"] == s.stats_["repeated"] == 10 and all(r["features"] == [0.0, 1.0] for r in got)


def test_folds_are_stratified(spark):
    from pyspark.sql import functions as F

    from ovelia.operators import samplers as sm

    x = spark.range(40).select("id", (F.col("id") < 6).cast("int").alias("label"))
    got = {(r["label"], r["fold"]): r["count"] for r in x.join(sm.folds_of(x, 3, 1), "id").groupBy("label", "fold").count().collect()}
    assert {f: got[1, f] for f in range(3)} == {0: 2, 1: 2, 2: 2} and sorted(got[0, f] for f in range(3)) == [11, 11, 12]
