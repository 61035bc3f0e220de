"""Blocks that boxes rule out: results are those of all pairs, and rows that meet are few."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ovelia.operators import distance, graphs, structure
from ovelia.operators import samplers as sm

SCHEMA = "id long, label int, features array<double>"


def table(spark, n=400, seed=5, places=60):
    """Rows on a few places, a third of them in one place, and some with a hole."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, places, (n, 2)).astype(float)
    x[: n // 3] = [7.0, 7.0]
    rows = [(int(i), int(i % 7 == 0), [None if i % 50 == 3 else float(a), float(b)]) for i, (a, b) in zip(rng.permutation(n) * 3, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 16)


def brute(x, k, scale):
    rows = x.orderBy("id").collect()
    f = np.array([[np.nan if v is None else v for v in r["features"]] for r in rows])
    dist, ids = distance.distances(f, f, scale), np.array([r["id"] for r in rows])
    np.fill_diagonal(dist, np.inf)
    return ids, dist, np.argsort(dist, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("part", [32_768, 64])
def test_neighbours_by_blocks(spark, tiny, monkeypatch, part):
    monkeypatch.setattr(distance, "PART", part)
    x = table(spark)
    scale = [3.0, 5.0]
    ids, dist, near = brute(x, 9, scale)
    got = {(r["i"], r["rk"]): (r["j"], r["dist"]) for r in distance.knn(x, 9, scale=scale).collect()}
    assert got == {(ids[r], k + 1): (ids[near[r, k]], dist[r, near[r, k]]) for r in range(len(ids)) for k in range(9)}
    some = {(r["i"], r["rk"]) for r in distance.knn(x, 9, scale=scale, only=1).collect()}
    label = {r["id"]: r["label"] for r in x.collect()}
    assert some == {key for key, (j, _) in got.items() if label[j] == 1}


def test_nearest_of_classes_by_blocks(spark, tiny):
    x = table(spark)
    ids, dist, _ = brute(x, 1, None)
    label = np.array([r["label"] for r in x.orderBy("id").collect()])
    for r in distance.nearest_by_class(x).collect():
        k = np.searchsorted(ids, r["i"])
        for name, ok in (("same", label == label[k]), ("other", label != label[k])):
            d = np.where(ok, dist[k], np.inf)
            assert (r[f"{name}_j"], r[f"{name}_dist"]) == (ids[d.argmin()], d.min())


def test_many_dimensions(spark, tiny):
    rng = np.random.default_rng(2)
    f = np.round(rng.normal(1000, 1, (120, 8)), 1)
    f[60:90] = f[:30]
    x = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(f)], SCHEMA)
    ids, dist, near = brute(x, 4, None)
    got = {(r["i"], r["rk"]): (r["j"], r["dist"]) for r in distance.knn(x, 4).collect()}
    assert got == {(r, k + 1): (near[r, k], dist[r, near[r, k]]) for r in range(120) for k in range(4)}


def test_few_rows_meet(spark, tiny):
    """Of n blocks, a block meets a few; before, all n * n pairs of blocks were dealt out."""
    x = table(spark, 1200, places=1000)
    met = []
    old = distance._deal

    def counted(q, d, plan, *rest):
        met.append((len(plan), len(q.n) * len(d.n)))
        return old(q, d, plan, *rest)

    distance._deal = counted
    try:
        assert distance.knn(x, 5).count() == 6000
    finally:
        distance._deal = old
    assert sum(a for a, _ in met) < 0.4 * met[0][1]


@pytest.mark.parametrize("method", sm.NBUS.METHODS)
def test_nbus_keeps_no_lists(spark, tiny, monkeypatch, method):
    """Whole lists of neighbours are not written; results are those of whole lists."""
    x, k = table(spark), 20
    rows = {r["i"]: [] for r in distance.knn(x, 1).collect()}
    for r in distance.knn(x, k).collect():
        rows[r["i"]].append((r["j"], r["yj"]))
    label = {r["id"]: r["label"] for r in x.collect()}
    often = lambda who: {j for j in label if label[j] == 0 and sum(j in {a for a, _ in rows[i]} for i in who) > 1}
    minor = [i for i in label if label[i] == 1]
    want = {
        "basic": lambda: {i for i in label if label[i] == 0 and any(y for _, y in rows[i])},
        "tomek": lambda: {i for i in label if label[i] == 0 and any(y and i in {a for a, _ in rows[j]} for j, y in rows[i])},
        "common": lambda: often(minor), "recursive": lambda: often(minor) | often(often(minor)),
    }[method]()
    sizes, old = [], sm.cut
    monkeypatch.setattr(sm, "cut", lambda d: sizes.append((y := old(d)).count()) or y)
    kept = {r["id"] for r in sm.NBUS(method, k).resample(x).collect()}
    assert kept == set(label) - want
    assert max(sizes) <= len(label)


def test_empty_and_one_row(spark, tiny):
    x = table(spark)
    none = x.where(F.lit(False))
    assert distance.knn(none, 3, x).count() == 0 and distance.knn(x, 3, none).count() == 0
    assert distance.knn(x.where("id = 3"), 3).count() == 0
    one = distance.nearest_by_class(x.where("id = 3")).first()
    assert one["same_j"] is None and one["other_j"] is None


def test_equal_densities_of_one_place(spark, monkeypatch):
    """Of rows of one place all but the lowest id have a denser row at no distance, even unrounded; before, sums in another order parted some."""
    monkeypatch.setattr(F, "round", lambda c, digits=0: F.col(c) if isinstance(c, str) else c)
    x = np.random.default_rng(6).normal(0, 60, (1500, 2)).tolist()
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x + x)], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r for r in sm.density_peaks(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(got[i]["delta"] == 0 and got[i]["rho"] == got[i - 1500]["rho"] for i in range(1500, 3000))
    assert all(got[i]["delta"] > 0 for i in range(1500))


def least_forest(x, scale):
    """Kruskal over all pairs above zero, in the order of (distance, lower id, higher id)."""
    rows = x.orderBy("id").collect()
    f = np.array([[np.nan if v is None else v for v in r["features"]] for r in rows])
    dist, ids = distance.distances(f, f, scale), [r["id"] for r in rows]
    root, out = list(range(len(ids))), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, i, j in sorted((dist[i, j], i, j) for j in range(len(ids)) for i in range(j) if dist[i, j] > 0):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.add((ids[i], ids[j], d, int(rows[i]["label"] != rows[j]["label"])))
    return out


@pytest.mark.parametrize("few", [20_000, 0])
def test_forest_by_blocks(spark, tiny, monkeypatch, few):
    """The forest is that of all pairs, also around a place of many blocks; before, every round dealt out all pairs of blocks."""
    x, scale, met = table(spark, 300, places=30), [3.0, 5.0], []
    old = graphs._deal
    monkeypatch.setattr(graphs, "BROADCAST_ROWS", few)
    monkeypatch.setattr(graphs, "_deal", lambda q, d, plan, *rest: met.append(sum(int(q.n[a] * d.n[c]) for a, _, c in plan)) or old(q, d, plan, *rest))
    assert {tuple(r) for r in graphs.spanning_forest(x, scale).collect()} == least_forest(x, scale)
    assert sum(met) < 2 * 300 * 300


def test_contained_balls_by_blocks(spark, tiny):
    x = table(spark, 300).where("features[0] is not null").withColumn("radius", F.pmod(F.xxhash64("id"), F.lit(60)) / 4.0)
    rows = x.collect()
    f, r, ids = np.array([b["features"] for b in rows]), np.array([b["radius"] for b in rows]), np.array([b["id"] for b in rows])
    dist = distance.distances(f, f)
    for b in structure._contained(x).collect():
        k = int(np.flatnonzero(ids == b["id"])[0])
        over = [(r[j], ids[j]) for j in range(len(ids)) if (r[j], ids[j]) > (r[k], ids[k]) and round(dist[k, j] + r[k], 9) <= round(r[j], 9)]
        assert (b["inside"], b["into"]) == (bool(over), max(over)[1] if over else -1)


def separability(x, resolutions, kmax):
    """All pairs of rows, cell by cell."""
    got = structure.cells(x, resolutions).collect()
    rows = sorted({(r["id"], r["label"]): r["features"] for r in got}.items())
    f = np.array([[np.nan if v is None else v for v in v] for _, v in rows])
    label, place = np.array([k[1] for k, _ in rows]), {k[0]: i for i, (k, _) in enumerate(rows)}
    dist, values = distance.distances(f, f, distance.ranges(x)), []
    for res in range(resolutions):
        cell = np.empty(len(rows), object)
        for r in got:
            if r["res"] == res:
                cell[place[r["id"]]] = r["cell"]
        v = []
        for i in range(len(rows)):
            mates = [j for j in np.flatnonzero(cell == cell[i]) if j != i]
            near = sorted(mates, key=lambda j: (dist[i, j], j))[:kmax]  # noqa: B023
            m = min(kmax, sum(label[j] == label[i] for j in mates))
            p = np.cumsum([label[j] == label[i] for j in near][:m]) / np.arange(1, m + 1)
            v.append(float(not mates) if m == 0 else p[0] if m == 1 else sum((p[1:] + p[:-1]) / 2) / m)
        values.append(np.mean(v) / 2**res)
    return structure._auc(values)


@pytest.mark.parametrize(("part", "spots"), [(32_768, 1 << 20), (64, 1 << 20), (32_768, 10)])
def test_cells_by_blocks(spark, tiny, monkeypatch, part, spots):
    monkeypatch.setattr(distance, "PART", part)
    monkeypatch.setattr(structure, "NEAREST", 12)
    monkeypatch.setattr(structure, "SPOTS", spots)
    x = table(spark).localCheckpoint()
    assert structure.neighbourhood_separability(x, 6, 5).first()["value"] == pytest.approx(separability(x, 6, 5), abs=2e-6)


def test_cells_meet_few_blocks(spark, tiny, monkeypatch):
    """Before, all pairs of blocks met, and each row's lists were dealt out resolution by resolution."""
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(i, i % 2, rng.random(2).tolist()) for i in range(800)], SCHEMA).localCheckpoint()
    met = []
    deal = structure._deal
    monkeypatch.setattr(structure, "_deal", lambda q, d, plan, *a: met.extend(plan) or deal(q, d, plan, *a))
    assert structure.neighbourhood_separability(x, 6, 3).first()["value"] == pytest.approx(separability(x, 6, 3), abs=2e-6)
    assert len(met) < 0.6 * len({r for r, _, _ in met}) ** 2


def test_nearest_rows_by_groups_of_columns():
    """The k-th least of all columns is bounded by groups' least: the product of matrices goes over the pairs once (before, some eight times)."""
    rng = np.random.default_rng(4)
    for d in (3, 9):
        a, b = rng.integers(0, 4, (40, d)).astype(float), rng.integers(0, 4, (1_031, d)).astype(float)
        for k in (1, 5, 40):
            banned = distance.distances(a, b) == 0
            row, col, value = distance.nearest_rows(a, b, k, banned=np.nonzero(banned))
            want = np.where(banned, np.inf, distance.distances(a, b))
            for r in range(40):
                got = sorted(zip(value[row == r], col[row == r], strict=True))[:k]
                assert [c for _, c in got] == np.argsort(want[r], kind="stable")[:k].tolist()
    ids = np.array([5, 3, 9, 3, 1])
    block = distance.Block(pa.table({"id": ids, "label": ids, "features": [[0.0]] * 5}))
    assert sorted(zip(*(v.tolist() for v in block.places(np.array([3, 4, 1]))), strict=True)) == [(0, 1), (0, 3), (2, 4)]
    dist = rng.random((50, 4_000))
    assert ((bound := distance._kth(dist, 5)) >= np.sort(dist, 1)[:, 4]).all() and ((dist <= bound[:, None]).sum(1) < 40).all()


def test_blocks_join_what_no_other_block_reaches(spark, tiny):
    """Before, each row went into the first round as a component of its own, and all blocks within reach met for it."""
    x = spark.createDataFrame([(i, i % 3 // 2, [float(v) for v in p]) for i, p in enumerate(np.random.default_rng(6).integers(0, 60, (150, 2)))], "id long, label int, features array<double>")
    scale = distance.ranges(x)
    boxes = distance.Boxes(x.select("id", "label", "features"), scale)
    home = graphs._joined_at_home(boxes).toPandas()
    edges = {(int(r.a), int(r.b), r.dist, int(r.cross)) for r in home[home["a"].notna()].itertuples()}
    want = {(a, b): (dist, cross) for a, b, dist, cross in least_forest(x, scale)}
    assert len(boxes.n) > 4 and home["comp"].nunique() == 150 - len(edges) < 130
    assert all((a, b) in want and want[a, b] == (dist, cross) for a, b, dist, cross in edges)


def test_enemies_compare_rows_of_other_classes_only(spark, monkeypatch):
    """Before, each block was compared with all rows twice."""
    seen = []
    monkeypatch.setattr(distance, "nearest_rows", lambda a, b, *r, f=distance.nearest_rows: seen.append(len(a) * len(b)) or f(a, b, *r))
    monkeypatch.setattr(distance, "reach_join", lambda q, d, wanted, compare, schema: [compare(distance.Block(x), distance.Block(x)) for x in (q.df.drop("_b").toArrow(),)][0])
    x = spark.createDataFrame([(i, int(i % 10 == 0), [float(i), float(i % 7)]) for i in range(100)], "id long, label int, features array<double>")
    with pytest.raises(AttributeError):
        distance.nearest_by_class(x)
    assert sum(seen) == 100 * 100


def test_distances_are_made_in_a_cache():
    """Before, every step of every feature took an array of all pairs."""
    a = np.random.default_rng(0).random((600, 3))
    tracemalloc.start()
    got = distance.distances(a, a, [1.0, 2.0, 3.0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.round(np.sqrt(((a[:, None] - a[None]) / [1.0, 2.0, 3.0]) ** 2 @ np.ones(3)), 9)
    assert np.abs(got - want).max() < 1e-8 and peak < 1.5 * got.nbytes
