"""Covers and kernel machines over more rows than a kernel matrix or a cover's matrix may have: before, they were refused."""

import numpy as np
import pytest

from ovelia.operators import numerics as nm
from ovelia.operators import samplers as sm
from ovelia.operators import structure as st
from ovelia.operators.distance import distances


def test_columns_instead_of_a_matrix(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(int)
    whole = nm.SVC().fit(x, y).decide(x), nm.OneClass(0.3).fit(x).decide(x)
    k, sign = nm.gram(x, x), np.where(y == 1, 1.0, -1.0)
    alpha = nm.svdd(k, sign, np.full(300, 0.05))
    monkeypatch.setattr(nm, "KERNEL_ROWS", 100)
    monkeypatch.setattr(nm, "KEPT", 900)
    assert np.abs(nm.SVC().fit(x, y).decide(x) - whole[0]).max() < 1e-2
    assert np.abs(nm.OneClass(0.3).fit(x).decide(x) - whole[1]).max() < 1e-2
    got = nm.svdd(nm.Kernel(x, sign), sign, np.full(300, 0.05))
    value = lambda a: 0.5 * (a * sign) @ k @ (a * sign) - (a * sign).sum()
    assert value(got) == pytest.approx(value(alpha), abs=1e-3) and sign @ got == pytest.approx(1)


def test_svc_beyond_the_matrix():
    x = np.random.default_rng(1).normal(size=(6_500, 2))
    y = (x[:, 0] > 0).astype(int)
    assert ((nm.SVC().fit(x, y).decide(x) > 0) == y).mean() > 0.99


def test_lists_up_to_a_row_that_stays():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, (40, 2)).astype(float), rng.integers(0, 6, (50, 2)).astype(float)
    for stays in (rng.random(50) < 0.2, np.zeros(50, bool)):
        order, starts = sm.nearest_until(a, b, stays)
        want = np.argsort(distances(a, b), axis=1, kind="stable")
        for r in range(40):
            upto = int(stays[want[r]].argmax()) + 1 if stays.any() else 50
            assert order[starts[r] : starts[r + 1]].tolist() == want[r, :upto].tolist()


def test_covers_of_a_large_class(spark):
    """20,500 rows of one class: more than a cover took."""
    rows = [(i, 0, [float(i % 205), 0.0]) for i in range(20_500)] + [(30_000 + i, 1, [50.0 * i + 10.25, 0.0]) for i in range(4)]
    x = spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(4)
    balls = st.onb_balls(x).collect()
    assert sum(b["members"] for b in balls if b["label"] == 0) == 20_500
    for b in balls:
        enemy = min(abs(b["features"][0] - f[0]) for _, y, f in rows if y != b["label"])
        assert b["radius"] == pytest.approx(enemy / 204)
    assert 0 < st.clust(x).first()["value"] < 0.02
