"""Feature and instance overlap measures. Every function takes a labelled table and returns a DataFrame.

Measures of neighbours take a table of knn(); values are rounded to six digits. by_class gives a row per class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.stages import numbered, small
from ..sources.labelled import width
from .distance import knn, nearest_by_class, radius_counts, ranges

K = 5


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


# --- features -------------------------------------------------------------------------------------------------------


def class_moments(df: DataFrame) -> DataFrame:
    """label, n, and mean, population variance, min and max of each feature as arrays: one pass, one row per class."""
    d = width(df)
    arr = lambda f, n: F.array(*[f(F.col("features")[k]) for k in range(d)]).alias(n)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), arr(F.avg, "mean"), arr(F.var_pop, "var"), arr(F.min, "lo"), arr(F.max, "hi"))


def _pairs(df: DataFrame) -> list[tuple[dict, dict]]:
    rows = sorted((r.asDict() for r in class_moments(df).collect()), key=lambda r: r["label"])
    return [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]


def f1(df: DataFrame) -> DataFrame:
    """(feature, value): 1 / (1 + Fisher's discriminant ratio), mean over pairs of classes."""
    pairs = _pairs(df)
    out = []
    for k in range(len(pairs[0][0]["mean"]) if pairs else 0):
        vals = []
        for a, b in pairs:
            s = a["var"][k] + b["var"][k]
            ratio = (a["mean"][k] - b["mean"][k]) ** 2 / s if s else 0.0
            vals.append(1 / (1 + ratio))
        out.append((k, round(sum(vals) / len(vals), 6)))
    return df.sparkSession.createDataFrame(out, "feature int, value double")


def f1v(df: DataFrame) -> DataFrame:
    """(a, b, value): directional-vector discriminant of each pair of classes, from d² covariances per class."""
    d = width(df)
    x = lambda k: F.col("features")[k]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(x(k)).alias(f"m{k}") for k in range(d)] + [F.covar_samp(x(a), x(b)).alias(f"c{a}_{b}") for a in range(d) for b in range(a, d)]
    rows = sorted((r.asDict() for r in df.groupBy("label").agg(*aggs).collect()), key=lambda r: r["label"])
    out = []
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            cov = lambda r: np.array([[r[f"c{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(d)] for a in range(d)])
            w = (p["n"] * cov(p) + q["n"] * cov(q)) / (p["n"] + q["n"])
            delta = np.array([p[f"m{k}"] - q[f"m{k}"] for k in range(d)])
            v = np.linalg.pinv(w) @ delta
            within = v @ w @ v
            ratio = (v @ np.outer(delta, delta) @ v) / within if within > 0 else 0.0
            out.append((p["label"], q["label"], round(float(1 / (1 + ratio)), 6)))
    return df.sparkSession.createDataFrame(out, "a int, b int, value double")


def _overlap(a: dict, b: dict) -> list[tuple[float, float]]:
    return [(max(x, y), min(u, v)) for x, y, u, v in zip(a["lo"], b["lo"], a["hi"], b["hi"], strict=True)]


def f2(df: DataFrame, by_class: bool = False) -> DataFrame:
    """(a, b, value): volume of the overlap of the classes' boxes, as a product over features of their shares. by_class: of each class's own box."""
    out = []
    for a, b in _pairs(df):
        both = {"lo": [min(x) for x in zip(a["lo"], b["lo"], strict=True)], "hi": [max(x) for x in zip(a["hi"], b["hi"], strict=True)]}
        for box in (a, b) if by_class else (both,):
            v = 1.0
            for k, (lo, hi) in enumerate(_overlap(a, b)):
                whole = box["hi"][k] - box["lo"][k]
                v *= max(0.0, hi - lo) / whole if whole else 0.0
            out.append((a["label"], b["label"], box.get("label"), round(v, 6)))
    return df.sparkSession.createDataFrame(out, "a int, b int, label int, value double").select("a", "b", *(["label"] if by_class else []), "value")


def f3(df: DataFrame, by_class: bool = False) -> DataFrame:
    """(a, b, value): the least share, over features, of all rows that lie in the closed overlap of two classes. by_class: of each class's rows."""
    out = []
    for a, b in _pairs(df):
        box = _overlap(a, b)
        if by_class:
            inside = lambda k: F.sum(F.col("features")[k].between(*box[k]).cast("int"))  # noqa: E731, B023
            rows = df.where(F.col("label").isin(a["label"], b["label"])).groupBy("label").agg(F.least(*[inside(k) for k in range(len(box))], F.count(F.lit(1))).alias("c"), F.count(F.lit(1)).alias("n"))
            out += [(a["label"], b["label"], r["label"], round(r["c"] / r["n"], 6)) for r in rows.collect()]
            continue
        row = df.agg(*[F.sum(F.col("features")[k].between(lo, hi).cast("int")).alias(f"c{k}") for k, (lo, hi) in enumerate(box)]).first()
        out.append((a["label"], b["label"], None, round(min(row) / (a["n"] + b["n"]), 6)))
    return df.sparkSession.createDataFrame(out, "a int, b int, label int, value double").select("a", "b", *(["label"] if by_class else []), "value")


def f4(df: DataFrame) -> DataFrame:
    """(a, b, value): share of rows that remain when, feature by feature, the one with least overlap separates what it can."""
    out = []
    for p in _pairs(df):
        a, b = p[0]["label"], p[1]["label"]
        rest, left, total = df.where(F.col("label").isin(a, b)), list(range(len(p[0]["mean"]))), p[0]["n"] + p[1]["n"]
        n = total
        while left and n:
            rows = {r["label"]: r.asDict() for r in class_moments(rest).collect()}
            if len(rows) < 2:
                n = 0
                break
            box = _overlap(rows[a], rows[b])
            row = rest.agg(*[F.sum(F.col("features")[k].between(*box[k]).cast("int")).alias(f"c{k}") for k in left]).first()
            k = left[min(range(len(left)), key=lambda i: (row[i] or 0, i))]
            n = row[left.index(k)] or 0
            rest = rest.where(F.col("features")[k].between(*box[k]))
            left.remove(k)
        out.append((a, b, round(n / total, 6)))
    return df.sparkSession.createDataFrame(out, "a int, b int, value double")


def input_noise(df: DataFrame, by_class: bool = False) -> DataFrame:
    """(value): share of (row, feature) strictly inside another class's range; by_class: of each class's rows."""
    moments = {r["label"]: r for r in class_moments(df).collect()}
    hit = F.lit(0)
    for label, m in moments.items():
        for k in range(len(m["mean"])):
            hit = hit + F.when((F.col("label") != label) & (F.col("features")[k] > m["lo"][k]) & (F.col("features")[k] < m["hi"][k]), 1).otherwise(0)
    d = len(next(iter(moments.values()))["mean"]) if moments else 1
    share = _r(F.sum(hit) / (F.count(F.lit(1)) * d), "value")
    return df.groupBy("label").agg(share) if by_class else df.agg(share)


# --- neighbours -----------------------------------------------------------------------------------------------------


def own_counts(nn: DataFrame, k: int = K) -> DataFrame:
    """(i, yi, k, own): neighbours found and those of the own class, of the k nearest."""
    return nn.where(F.col("rk") <= k).groupBy("i", "yi").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("yi") == F.col("yj")).cast("int")).alias("own"))


def _by(df: DataFrame, by_class: bool, *aggs: Column) -> DataFrame:
    return df.groupBy(F.col("yi").alias("label")).agg(*aggs) if by_class else df.agg(*aggs)


def kdn(nn: DataFrame, k: int = K, by_class: bool = False) -> DataFrame:
    return _by(own_counts(nn, k), by_class, _r(F.avg(1 - F.col("own") / F.col("k")), "value"))


def cm(nn: DataFrame, k: int = K, by_class: bool = False) -> DataFrame:
    return _by(own_counts(nn, k), by_class, _r(F.avg((1 - F.col("own") / F.col("k") > 0.5).cast("int")), "value"))


def d3(nn: DataFrame, k: int = K) -> DataFrame:
    return own_counts(nn, k).groupBy(F.col("yi").alias("label")).agg(F.sum((F.col("own") / F.col("k") < 0.5).cast("int")).cast("long").alias("value"))


def _votes(nn: DataFrame, k: int) -> DataFrame:
    votes = nn.where(F.col("rk") <= k).groupBy("i", "yi", "yj").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("i", "yi").agg(F.max("c").alias("most"), F.max(F.when(F.col("yi") == F.col("yj"), F.col("c")).otherwise(0)).alias("own"), F.sum("c").alias("k"))


def n3(nn: DataFrame, k: int = 1, by_class: bool = False) -> DataFrame:
    return _by(_votes(nn, k), by_class, _r(F.avg((F.col("own") < F.col("most")).cast("int")), "value"))


def si(nn: DataFrame, k: int = 1, by_class: bool = False) -> DataFrame:
    return _by(_votes(nn, k), by_class, _r(F.avg((F.col("own") == F.col("most")).cast("int")), "value"))


def instance_hardness(nn: DataFrame, k: int = 1) -> DataFrame:
    """(id, value): 1 - own / k of each row."""
    return own_counts(nn, k).select(F.col("i").alias("id"), _r(1 - F.col("own") / F.lit(k), "value"))


def deg_overlap(nn: DataFrame, k: int = K, by_class: bool = False) -> DataFrame:
    return _by(own_counts(nn, k), by_class, _r(F.avg((F.col("own") < F.col("k")).cast("int")), "value"))


def borderline_tags(nn: DataFrame) -> DataFrame:
    """(id, label, tag) by disagreeing neighbours of five: 0-1 safe, 2-3 borderline, 4 rare, 5 outlier."""
    bad = F.col("k") - F.col("own")
    tag = F.when(bad <= 1, "safe").when(bad <= 3, "borderline").when(bad == 4, "rare").otherwise("outlier")
    return own_counts(nn, 5).select(F.col("i").alias("id"), F.col("yi").alias("label"), tag.alias("tag"))


def borderline(nn: DataFrame, by_class: bool = False) -> DataFrame:
    """(safe, borderline, rare, outlier): shares of rows; by_class: of each class's rows."""
    tags = borderline_tags(nn)
    shares = [_r(F.avg((F.col("tag") == t).cast("int")), t) for t in ("safe", "borderline", "rare", "outlier")]
    return tags.groupBy("label").agg(*shares) if by_class else tags.agg(*shares)


def r_value(nn: DataFrame, counts: dict[int, int], k: int = K, theta: int = 2) -> DataFrame:
    """(value): augmented R of two classes; rows count with more than theta neighbours of the other one."""
    rows = own_counts(nn, k).groupBy("yi").agg(F.avg((F.col("k") - F.col("own") > theta).cast("int")).alias("r"))
    (hi, a), (lo, b) = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]
    ir = a / b
    pick = lambda c: F.max(F.when(F.col("yi") == c, F.col("r")))
    return rows.agg(_r((pick(hi) + pick(lo) * ir) / (ir + 1), "value"))


def r_by_class(nn: DataFrame, k: int = K, theta: int = 2) -> DataFrame:
    """(label, value): R of each of two classes: the share of its rows with more than theta neighbours of the other one."""
    return own_counts(nn, k).groupBy(F.col("yi").alias("label")).agg(_r(F.avg((F.col("k") - F.col("own") > theta).cast("int")), "value"))


def r_pairs(nn: DataFrame, k: int = K, theta: int = 2) -> DataFrame:
    """(a, b, value): augmented R of each pair of any number of classes; neighbours of other classes than the two do not count."""
    near = nn.where(F.col("rk") <= k)
    size = near.groupBy("yi").agg(F.count_distinct("i").alias("n")).collect()  # a row for each class
    many = {r["yi"]: r["n"] for r in size}
    votes = near.where("yi <> yj").groupBy("i", "yi", "yj").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > theta)
    over = {(r["yi"], r["yj"]): r["n"] for r in votes.groupBy("yi", "yj").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda a, b: over.get((a, b), 0) / many[a]
    out = []
    for a in sorted(many):
        for b in (x for x in sorted(many) if x > a):
            hi, lo = (a, b) if many[a] > many[b] else (b, a)
            ir = many[hi] / many[lo]
            out.append((a, b, round((share(hi, lo) + ir * share(lo, hi)) / (ir + 1), 6)))
    return nn.sparkSession.createDataFrame(out, "a int, b int, value double")


def c1(nn: DataFrame, kmax: int = K, by_class: bool = False) -> DataFrame:
    w = Window.partitionBy("i").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    x = nn.where(F.col("rk") <= kmax).withColumn("s", F.sum((F.col("yi") == F.col("yj")).cast("int")).over(w) / F.col("rk"))
    return _by(x.groupBy("i", "yi").agg((1 - F.avg("s")).alias("v")), by_class, _r(F.avg("v"), "value"))


def c2(nn: DataFrame, kmax: int = K, by_class: bool = False) -> DataFrame:
    w = Window.partitionBy("i").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    near = F.when(F.col("yi") == F.col("yj"), 1 - F.least("dist", F.lit(1.0))).otherwise(0.0)
    x = nn.where(F.col("rk") <= kmax).withColumn("s", F.sum(near).over(w) / F.col("rk"))
    return _by(x.groupBy("i", "yi").agg((1 - F.avg("s")).alias("v")), by_class, _r(F.avg("v"), "value"))


def n2(near: DataFrame, by_class: bool = False) -> DataFrame:
    """near: nearest_by_class(). r / (1 + r) of the sums of distances to the own and to other classes."""
    r = F.when(F.sum("other_dist") > 0, F.sum("same_dist") / F.sum("other_dist")).otherwise(0.0)
    return _by(near, by_class, (r).alias("r")).select(*(["label"] if by_class else []), _r(F.col("r") / (1 + F.col("r")), "value"))


def local_sets(df: DataFrame, near: DataFrame, scale: list[float] | None) -> DataFrame:
    """(i, yi, size): rows of the own class closer than the nearest enemy, the row itself included."""
    q = df.join(near.select(F.col("i").alias("id"), F.col("other_dist").alias("radius")), "id")
    return radius_counts(q, df, ["radius"], strict=True, scale=scale).select("i", "yi", F.col("same_0").alias("size"))


def lsc(df: DataFrame, near: DataFrame, scale: list[float] | None, by_class: bool = False) -> DataFrame:
    sets = local_sets(df, near, scale)
    n = F.count(F.lit(1))
    return _by(sets, by_class, _r(1 - F.sum("size") / (n * n), "value"))


def hypersphere_profile(df: DataFrame, scale: list[float], radii: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(id, psi_0..): (same - different) / (same + different) within each radius, positive for class 1."""
    q = df
    for k, r in enumerate(radii):
        q = q.withColumn(f"radius_{k}", F.lit(float(r)))
    x = radius_counts(q, df, [f"radius_{k}" for k in range(len(radii))], scale=scale)
    sign = F.when(F.col("yi") == 1, 1).otherwise(-1)
    psi = lambda k: sign * (F.col(f"same_{k}") - F.col(f"diff_{k}")) / (F.col(f"same_{k}") + F.col(f"diff_{k}"))
    return x.select(F.col("i").alias("id"), F.col("yi").alias("label"), *[_r(psi(k), f"psi_{k}") for k in range(len(radii))])


def interpolated(df: DataFrame, seed: int = 7) -> DataFrame:
    """As many rows per class as it has: each between two random rows of the class, with a share per feature."""
    d = width(df)
    parts = []
    for label, n in sorted((r["label"], r["count"]) for r in df.groupBy("label").count().collect()):
        rows = numbered(df.where(F.col("label") == label), F.col("id"))
        new = df.sparkSession.range(n).select(F.col("id").alias("g"))
        pick = lambda s: F.floor(uniform(seed, f"{s}{label}", "g") * n).cast("long")  # noqa: E731, B023
        new = new.withColumn("pa", pick("a")).withColumn("pb", pick("b"))
        a, b = rows.select(F.col("n").alias("pa"), F.col("features").alias("fa")), rows.select(F.col("n").alias("pb"), F.col("features").alias("fb"))
        new = new.join(small(a), "pa").join(small(b), "pb")
        mix = F.array(*[F.col("fa")[k] + (F.col("fb")[k] - F.col("fa")[k]) * uniform(seed, f"t{k}_{label}", "g") for k in range(d)])
        parts.append(new.select((F.lit(-1) - F.col("g") - F.lit(label) * F.lit(1 << 40)).alias("id"), F.lit(label).cast("int").alias("label"), mix.alias("features")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def n4(df: DataFrame, seed: int = 7, by_class: bool = False) -> DataFrame:
    """(value): error of the 1-NN rule over df on interpolated rows."""
    return n3(knn(interpolated(df, seed), 1, df, ranges(df)), 1, by_class)


def neighbours(df: DataFrame, k: int = K) -> DataFrame:
    return knn(df, k, scale=ranges(df))


def enemies(df: DataFrame) -> DataFrame:
    return nearest_by_class(df, ranges(df))


def tree_depth(df: DataFrame, forest: bool = False, seed: int = 42) -> float:
    """Depth of a decision tree, or the mean over a forest of 100 (at most 30 each)."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = df.select("label", array_to_vector("features").alias("v"))
    if forest:
        m = RandomForestClassifier(featuresCol="v", numTrees=100, maxDepth=30, seed=seed).fit(x)
        return sum(t.depth for t in m.trees) / len(m.trees)
    return float(DecisionTreeClassifier(featuresCol="v", maxDepth=30, seed=seed).fit(x).depth)
