"""The hand-worked table of FIXTURES.md, section D, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from ovelia.operators import measures as m
from ovelia.operators import samplers as sm
from ovelia.operators import structure as st
from ovelia.operators.distance import knn, nearest_by_class, ranges
from ovelia.sources import labelled as lb

POINTS = [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 4, 4, 0), (4, 2, 2, 1), (5, 5, 4, 0), (6, 2, 3, 1)]
SCHEMA = "id long, label int, features array<double>"


def make(spark, rows):
    return spark.createDataFrame([(r[0], r[-1], [float(v) for v in r[1:-1]]) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def d(spark):
    return make(spark, POINTS).repartition(3).cache()


def one(df):
    return df.first()[0]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def removed(df, out):
    return sorted(set(ids(df)) - set(ids(out)))


def test_neighbours(d):
    assert ranges(d) == [5.0, 4.0]
    nn = knn(d, 3, scale=ranges(d)).collect()
    got = {i: [r["j"] for r in sorted(nn, key=lambda r: r["rk"]) if r["i"] == i] for i in range(7)}
    assert got == {0: [1, 2, 4], 1: [0, 2, 4], 2: [0, 1, 4], 3: [5, 6, 4], 4: [6, 2, 1], 5: [3, 6, 4], 6: [4, 3, 2]}
    dist = {(r["i"], r["j"]): round(r["dist"], 4) for r in nn}
    assert (dist[0, 1], dist[2, 4], dist[3, 6], dist[4, 6]) == (0.2, 0.4717, 0.4717, 0.25)


def test_measures(d):
    scale = ranges(d)
    assert one(m.n3(knn(d, 1, scale=scale))) == 0.0
    assert one(m.kdn(knn(d, 3, scale=scale), 3)) == 0.52381
    near = nearest_by_class(d, scale)
    assert [r["other_j"] for r in near.orderBy("i").collect()] == [4, 4, 4, 6, 2, 6, 3]
    assert one(m.n2(near)) == 0.294362
    assert one(m.lsc(d, near, scale)) == 0.653061
    assert [r["value"] for r in m.f1(d).orderBy("feature").collect()] == [1.0, 0.880488]
    assert m.f2(d).first()["value"] == 0.0
    assert m.f3(d).first()["value"] == 0.285714


def test_undersamplers(d):
    assert removed(d, sm.NBUS("basic", 2).resample(d)) == [3, 5]
    assert removed(d, sm.NBUS("tomek", 2).resample(d)) == [3]
    assert removed(d, sm.NBUS("common", 3).resample(d)) == [2]
    assert removed(d, sm.NUS(3).resample(d)) == [2]


def test_si_is_one_minus_n3(d):
    nn = knn(d, 3, scale=ranges(d))
    assert one(m.si(nn, 3)) == round(1 - one(m.n3(nn, 3)), 6)


def test_partitions_do_not_matter(d):
    a = knn(d.repartition(1), 2).orderBy("i", "rk").collect()
    b = knn(d.repartition(5, "id"), 2).orderBy("i", "rk").collect()
    assert a == b


def test_more_neighbours_than_rows(d):
    assert knn(d, 50).count() == 42


def test_blocks_agree_with_one_block(d):
    from ovelia.operators import distance

    whole = knn(d, 3).orderBy("i", "rk").collect()
    old, distance.block_join.__defaults__ = distance.block_join.__defaults__, (2,)
    try:
        assert knn(d, 3).orderBy("i", "rk").collect() == whole
    finally:
        distance.block_join.__defaults__ = old


def test_missing_and_categories(spark):
    x = spark.createDataFrame([(0, 0, [None, 1.0]), (1, 0, [2.0, 1.0]), (2, 1, [2.0, 3.0])], SCHEMA)
    dist = {(r["i"], r["j"]): r["dist"] for r in knn(x, 2, scale=[1.0, 2.0], kinds=[0, 1]).collect()}
    assert dist[0, 1] == 1.0 and dist[1, 2] == 1.0 and dist[0, 2] == round(math.sqrt(2), 9)
    full = {r["id"]: list(r["features"]) for r in sm.impute(x).collect()}
    assert full[0] == [2.0, 1.0]


def test_constant_feature_and_one_feature(spark):
    x = make(spark, [(i, 1.0, i % 2) for i in range(6)])
    assert one(m.n2(nearest_by_class(x, ranges(x)))) == 0.0
    assert m.f1v(x).first()["value"] == 1.0
    assert st.purity_curve(x, 2).count() == 2


def test_balanced_classes(spark):
    x = make(spark, [(i, float(i), i % 2) for i in range(6)])
    with pytest.raises(ValueError):
        sm.RandomOverSampler().resample(x)
    assert sm.sides(x, compat=True)[2:] == (3, 3)


def test_random_samplers(d):
    over = sm.RandomOverSampler().resample(d)
    assert over.groupBy("label").count().select("count").distinct().collect() == [(5,)]
    under = sm.RandomUnderSampler().resample(d)
    assert under.count() == 4 and {4, 6} <= set(ids(under))
    assert ids(under) == ids(sm.RandomUnderSampler().resample(d.repartition(1)))


def test_smote_lies_between(d):
    out = sm.SMOTE().resample(d).where("origin = 'synth'").collect()
    assert len(out) == 3 and all(r["features"][0] == 2.0 and 2.0 <= r["features"][1] <= 3.0 for r in out)


def test_odbot_worked_example(spark):
    rows = [(i, float(i), float(i % 3), 0.0, 0) for i in range(9)] + [(20 + i, 30.0 + i, 1.0, 2.0, 1) for i in range(4)] + [(40 + i, 1.0, 50.0 + i, 3.0, 2) for i in range(5)]
    out = sm.ODBOT().resample(make(spark, rows))
    assert sorted(r["count"] for r in out.groupBy("label").count().collect()) == [9, 9, 9]
    assert out.where("label = 1 and origin = 'synth' and (features[0] < 30 or features[0] > 33)").count() == 0
    with pytest.raises(ValueError):
        sm.ODBOT(k=1)


def test_memberships_sum_to_one(d):
    got = sm.memberships(d, [[0.0, 0.0], [4.0, 4.0]]).collect()
    assert all(abs(sum(r["mu"]) - 1) < 1e-9 for r in got)


def test_spanning_tree(d):
    from ovelia.operators.graphs import spanning_forest

    e = {(r["a"], r["b"]) for r in spanning_forest(d).collect()}
    assert e == {(0, 1), (0, 2), (3, 5), (4, 6), (3, 6), (1, 4)}


def test_t1_against_brute_force(d):
    p = {r[0]: (r[1:3], r[3]) for r in POINTS}
    near = {i: min((math.dist(p[i][0], p[j][0]), j) for j in p if p[j][1] != p[i][1]) for i in p}
    done = {}

    def radius(i, path=()):
        if i in done:
            return done[i]
        x, e = near[i]
        if near[e][1] == i:
            done[i] = x / 2
        else:
            done[i] = abs(x - radius(e, (*path, i)))
        return done[i]

    want = {i: round(radius(i), 6) for i in p}
    assert {r["id"]: round(r["radius"], 6) for r in st.sphere_radii(d).collect()} == want
    left = [i for i in p if not any((want[j], j) > (want[i], i) and math.dist(p[i][0], p[j][0]) + want[i] <= want[j] + 1e-9 for j in p if j != i)]
    assert one(st.t1(d)) == round(len(left) / 7, 6)


def test_loader_orients_and_scales(spark):
    x = spark.createDataFrame([("b", 1.0, "x"), ("a", 2.0, "y"), ("b", 3.0, "x"), ("b", 4.0, None)], "y string, v double, c string")
    out, fit = lb.from_dataframe(x, "y")
    assert fit["labels"] == {"b": 0, "a": 1} and fit["kinds"] == [0, 1]
    assert out.count() == 4 and abs(out.agg(F.avg(F.col("features")[0])).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        lb.from_dataframe(x.withColumn("y", F.col("v")), "y")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("f,y\n1,stable\n2,unstable\n3,unstable\n")
    out, _ = lb.read_csv(spark, str(tmp_path / "a.csv"), "y", label_map={"stable": 1})
    assert out.count() == 3
    (tmp_path / "a.arff").write_text("@relation r\n@attribute f numeric\n@attribute 'k' {a,b}\n@data\n1,a\n?,b\n")
    assert sorted(map(tuple, lb.read_arff(spark, str(tmp_path / "a.arff")).collect()), key=str) == [(1.0, "a"), (None, "b")]


def test_unknown_names():
    from ovelia.operators.evaluate import fit_predict

    with pytest.raises(ValueError):
        sm.NBUS("none")
    with pytest.raises(ValueError):
        fit_predict(None, None, "none")


@pytest.mark.parametrize("few", [1, 4096])
def test_quantiles_are_exact(spark, monkeypatch, few):
    from ovelia.functions import stages

    monkeypatch.setattr(stages, "FEW", few)
    monkeypatch.setattr(stages, "BARS", 8)
    x = spark.range(997).select(F.array(F.exp(F.rand(5) * 30 - 9), F.floor(F.col("id") / 100).cast("double"), F.lit(2.5), F.when(F.col("id") % 3 > 0, F.col("id") * -1.0)).alias("v"))
    x = stages.cut(x)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    want = x.agg(*[F.percentile(F.col("v")[k], F.array(*map(F.lit, shares))) for k in range(4)]).first()
    assert stages.quantiles(x, F.col("v"), shares) == [list(w) for w in want]
    assert stages.quantiles(x.where("false"), F.col("v"), shares) == []


def test_categories_come_back(spark):
    x = spark.createDataFrame([(1, "b", None), (2, "a", "z"), (3, None, "y")], "id int, p string, q string")
    coded, maps = lb.encode_categories(x, ["p", "q"])
    assert sorted(lb.decode_categories(coded, maps).collect()) == sorted(x.collect())


def test_pictures_share_axes(spark):
    from ovelia.plans.overlap import overlap_picture

    x = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("label"), F.array(*[F.rand(k) * (k + 1) for k in range(4)]).alias("features")).cache()
    part = x.where("id < 9")
    key = lambda r: (r["id"], r["pc"])
    assert sorted(overlap_picture(part, 2, x).collect(), key=key) == sorted(overlap_picture(x).where("id < 9").collect(), key=key)
