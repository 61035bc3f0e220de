"""Resamplers. Each has resample(df) -> DataFrame(id, label, features, origin) and stats_, filled as it runs.

df is a labelled table; origin is `orig`, `dup` or `synth`. Undersamplers never touch the minority. Random draws are
hashes of row ids, so a result depends neither on partitions nor on order. Classes are told apart by count; a tie is an
error unless compat takes label 0 as the majority.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.shipping import ship
from ..functions.stages import cut, numbered, quantiles, small
from ..sources.labelled import minmax_scaler, standard_scaler, width
from .distance import Block, block_join, distances, knn, nearest_by_class
from .numerics import SVC, Kernel, OneClass, svdd


#: Small fits that are under way at once.
FITS = 8


def sides(df: DataFrame, compat: bool = False) -> tuple[int, int, int, int]:
    """Majority label, minority label, and their counts."""
    counts = sorted(((r["count"], -r["label"]) for r in df.groupBy("label").count().collect()), reverse=True)
    if len(counts) != 2:
        raise ValueError(f"two classes are needed, {len(counts)} found")
    (a, la), (b, lb) = counts
    if a == b and not compat:
        raise ValueError("classes are equal in size: there is no majority")
    return -la, -lb, a, b


def _out(df: DataFrame, origin: str = "orig") -> DataFrame:
    return df.select("id", "label", "features", F.lit(origin).alias("origin"))


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df without the rows that ids(id) names."""
    return _out(df.join(ids.select("id").distinct(), "id", "left_anti"))


class Sampler(ABC):
    """Anything with resample(df) is a sampler."""

    def __init__(self, **params):
        self.params = params
        self.stats_: dict = {}

    def get_params(self) -> dict:
        return dict(self.params)

    @abstractmethod
    def resample(self, df: DataFrame) -> DataFrame: ...


def random_rows(df: DataFrame, need: int, seed: int, salt: str, origin: str = "dup") -> DataFrame:
    """need rows of df, drawn with replacement."""
    rows = numbered(df.select("id", "label", "features"), F.col("id"))
    n = rows.count()
    draws = df.sparkSession.range(max(0, need)).select(F.floor(uniform(seed, salt, "id") * n).cast("long").alias("n"))
    return _out(draws.join(small(rows), "n"), origin)


class RandomOverSampler(Sampler):
    """All rows, and minority rows drawn again up to the majority's number, or to `ratio` times their own."""

    def __init__(self, ratio: float | str = "auto", seed: int = 42):
        super().__init__(ratio=ratio, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        _, lo, a, b = sides(df)
        need = (a if self.params["ratio"] == "auto" else int(b * self.params["ratio"])) - b
        self.stats_ = {"added": max(0, need)}
        return _out(df).unionByName(random_rows(df.where(F.col("label") == lo), need, self.params["seed"], "ros")) if need > 0 else _out(df)


class RandomUnderSampler(Sampler):
    """The minority, and majority rows down to its number, or to a part `ratio` of their own."""

    def __init__(self, ratio: float | str = "auto", seed: int = 42):
        super().__init__(ratio=ratio, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        hi, _, a, b = sides(df)
        keep = b if self.params["ratio"] == "auto" else int(a * self.params["ratio"])
        if keep >= a:
            return _out(df)
        major = numbered(df.where(F.col("label") == hi).withColumn("_u", uniform(self.params["seed"], "rus", "id")), F.col("_u"), F.col("id"))
        self.stats_ = {"removed": a - keep}
        return _out(df.where(F.col("label") != hi)).unionByName(_out(major.where(F.col("n") < keep)))


class NUS(Sampler):
    """Removes majority rows that several minority rows have among their near majority neighbours."""

    def __init__(self, k_neighbors: int | None = None, distance_threshold: str | float = "median", min_membership: int = 2):
        super().__init__(k_neighbors=k_neighbors, distance_threshold=distance_threshold, min_membership=min_membership)

    def resample(self, df: DataFrame) -> DataFrame:
        p = self.params
        hi, lo, a, b = sides(df)
        k = min(p["k_neighbors"] or min(int(math.sqrt(a)), 50), a)
        nn = knn(df.where(F.col("label") == lo), k, df.where(F.col("label") == hi))
        w = Window.partitionBy("i")
        limit = F.median("dist").over(w) if p["distance_threshold"] == "median" else F.avg("dist").over(w) if p["distance_threshold"] == "mean" else F.lit(float(p["distance_threshold"]))
        named = nn.withColumn("limit", limit).where(F.col("dist") <= F.col("limit"))
        votes = cut(named.groupBy(F.col("j").alias("id")).agg(F.count(F.lit(1)).alias("c")))
        gone = votes.where(F.col("c") >= p["min_membership"])
        n = gone.count()
        self.stats_ = {"nominated": votes.count(), "eliminated": n, "IR_before": a / b, "IR_after": (a - n) / b, "IR_reduction_pct": 100 * n / a, "size_reduction_pct": 100 * n / (a + b)}
        return without(df, gone)


class URNS(Sampler):
    """Removes majority rows that recur among the neighbours of minority rows, then of the rows removed."""

    def __init__(self, k: int | str = "adaptive", min_frequency: int = 2, rounds: int = 2):
        super().__init__(k=k, min_frequency=min_frequency, rounds=rounds)

    def resample(self, df: DataFrame) -> DataFrame:
        hi, lo, a, b = sides(df)
        k = int(math.sqrt(a + b) + math.sqrt(a / b)) if self.params["k"] == "adaptive" else self.params["k"]
        nn = cut(knn(df, k).select("i", "j", "yj"))
        query, gone = df.where(F.col("label") == lo).select("id"), None
        for r in range(self.params["rounds"]):
            hit = nn.join(query.select(F.col("id").alias("i")), "i", "left_semi").where(F.col("yj") == hi).groupBy(F.col("j").alias("id")).agg(F.count(F.lit(1)).alias("c"))
            query = cut(hit.where(F.col("c") >= self.params["min_frequency"]).select("id"))
            self.stats_[f"round_{r + 1}_removed"] = query.count()
            gone = query if gone is None else gone.unionByName(query).distinct()
            if not self.stats_[f"round_{r + 1}_removed"]:
                break
        self.stats_["total_removed"], self.k_value_ = gone.count(), k
        return without(df, gone)


class NBUS(Sampler):
    """Neighbourhood-based undersampling: basic, tomek, common, recursive."""

    METHODS = ("basic", "tomek", "common", "recursive")

    def __init__(self, method: str = "basic", k: int | None = None):
        if method not in self.METHODS:
            raise ValueError(f"method must be one of {self.METHODS}")
        super().__init__(method=method, k=k)

    def resample(self, df: DataFrame) -> DataFrame:
        hi, lo, a, b = sides(df)
        k = self.params["k"] or int(math.sqrt(a + b) + a / b)
        method = self.params["method"]
        of = lambda label: df.where(F.col("label") == label)
        # Lists are reduced as they are made: all of them would be k rows for each row of the table.
        if method in ("basic", "tomek"):
            near = knn(of(hi), k, df, only=lo).select("i", "j")
            if method == "tomek":
                near = near.join(knn(of(lo), k, df, only=hi).select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")
            gone = near.select(F.col("i").alias("id")).distinct()
        else:
            often = lambda q: knn(q, k, df, only=hi).groupBy(F.col("j").alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
            gone = often(of(lo))
            if method == "recursive":
                gone = cut(gone)
                gone = gone.unionByName(often(cut(df.join(gone, "id", "left_semi")))).distinct()
        gone = cut(gone)
        n = gone.count()
        self.stats_ = {"original": {"n_negative": a, "n_positive": b, "k_used": k}, "final": {"n_negative": a - n, "n_positive": b, "n_removed": n}}
        return without(df, gone)


# --- clusters of the majority ---------------------------------------------------------------------------------------


def _squared(centre: list[float]) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(centre):
        out = out + F.pow(F.col("features")[k] - F.lit(float(c)), F.lit(2))
    return out


def memberships(x: DataFrame, centres: list[list[float]], m: float = 2.0) -> DataFrame:
    """x with mu: fuzzy weights of the clusters, which sum to 1."""
    dist = [F.greatest(F.sqrt(_squared(c)), F.lit(1e-10)) for c in centres]
    x = x.withColumn("_d", F.array(*dist))
    power = 2 / (m - 1)
    mu = [1 / sum((F.pow(F.col("_d")[i] / F.col("_d")[j], F.lit(power)) for j in range(len(centres))), F.lit(0.0)) for i in range(len(centres))]
    return x.withColumn("mu", F.array(*mu)).drop("_d")


def fuzzy_step(x: DataFrame, centres: list[list[float]], m: float = 2.0) -> list[list[float]]:
    """New centres: means weighted by mu**m; one aggregate."""
    d, k = len(centres[0]), len(centres)
    w = memberships(x, centres, m)
    weight = [F.pow(F.col("mu")[i], F.lit(float(m))) for i in range(k)]
    row = w.agg(*[F.sum(weight[i]) for i in range(k)], *[F.sum(weight[i] * F.col("features")[f]) for i in range(k) for f in range(d)]).first()
    return [[row[k + i * d + f] / row[i] for f in range(d)] for i in range(k)]


def hard_step(x: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """New centres: means of the rows nearest to each; an empty cluster keeps its centre."""
    d = len(centres[0])
    c = F.array_min(F.array(*[F.struct(F.round(F.sqrt(_squared(z)), 9).alias("d"), F.lit(i).alias("c")) for i, z in enumerate(centres)]))["c"]
    rows = {r["c"]: r for r in x.groupBy(c.alias("c")).agg(*[F.avg(F.col("features")[f]).alias(f"f{f}") for f in range(d)]).collect()}
    return [[rows[i][f"f{f}"] for f in range(d)] if i in rows else z for i, z in enumerate(centres)]


def rough(x: DataFrame, centres: list[list[float]], sigma: float) -> DataFrame:
    """x with lower (its cluster, or null on a boundary) and upper (array of clusters it may belong to)."""
    dist = [F.sqrt(_squared(c)) for c in centres]
    x = x.withColumn("_d", F.array(*dist)).withColumn("_n", F.array_min("_d"))
    near = F.filter(F.array(*[F.when(F.col("_d")[i] - F.col("_n") <= sigma, F.lit(i)) for i in range(len(centres))]), lambda v: v.isNotNull())
    x = x.withColumn("upper", near)
    return x.withColumn("lower", F.when(F.size("upper") == 1, F.col("upper")[0])).drop("_d", "_n")


def rough_step(x: DataFrame, centres: list[list[float]], w: float = 0.95, sigma: float = 0.1, m: float | None = None) -> list[list[float]]:
    """New centres: w times the lower mean and 1 - w times the boundary mean, or whichever there is. With m, rows weigh mu**m, still over counts."""
    d, k = len(centres[0]), len(centres)
    y = rough(memberships(x, centres, m) if m else x, centres, sigma)
    aggs = []
    for i in range(k):
        weight = F.pow(F.col("mu")[i], F.lit(float(m))) if m else F.lit(1.0)
        for name, here in (("l", F.col("lower") == i), ("u", F.col("lower").isNull() & F.array_contains("upper", i))):
            aggs += [F.sum(F.when(here, 1).otherwise(0)).alias(f"{name}{i}")] + [F.sum(F.when(here, weight * F.col("features")[f])).alias(f"{name}{i}_{f}") for f in range(d)]
    r = y.agg(*aggs).first()
    out = []
    for i in range(k):
        mean = lambda n: [r[f"{n}{i}_{f}"] / r[f"{n}{i}"] for f in range(d)]  # noqa: E731, B023
        has_l, has_u = bool(r[f"l{i}"]), bool(r[f"u{i}"])
        out.append([w * a + (1 - w) * b for a, b in zip(mean("l"), mean("u"), strict=True)] if has_l and has_u else mean("l") if has_l else mean("u") if has_u else centres[i])
    return out


def first_centres(x: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k rows by hash."""
    return [list(r["features"]) for r in x.select("features", uniform(seed, "centre", "id").alias("u"), "id").orderBy("u", "id").limit(k).collect()]


class KMeansUndersampling(Sampler):
    """Clusters the majority and removes a part of it: HKM, FCM, RKM or FRKM.

    HKM removes rows whose distance ratio (nearest to second centre) is below a percentile; mode='boundary' those above
    the opposite one. FCM removes rows with a second membership above a threshold, RKM those on a boundary, FRKM both.
    """

    METHODS = ("HKM", "FCM", "RKM", "FRKM")

    def __init__(self, method: str = "HKM", k: int = 3, max_iter: int = 100, epsilon: float = 1e-5, percentile: float = 10, m: float = 2.0, membership: float = 0.3, w: float = 0.95, sigma: float = 0.1, mode: str = "central", seed: int = 42):
        if method not in self.METHODS:
            raise ValueError(f"method must be one of {self.METHODS}")
        super().__init__(method=method, k=k, max_iter=max_iter, epsilon=epsilon, percentile=percentile, m=m, membership=membership, w=w, sigma=sigma, mode=mode, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        p = self.params
        hi, _, a, b = sides(df)
        x = cut(df.where(F.col("label") == hi).select("id", "label", "features"))
        centres = first_centres(x, p["k"], p["seed"])
        step = {"HKM": lambda c: hard_step(x, c), "FCM": lambda c: fuzzy_step(x, c, p["m"]), "RKM": lambda c: rough_step(x, c, p["w"], p["sigma"]), "FRKM": lambda c: rough_step(x, c, p["w"], p["sigma"], p["m"])}[p["method"]]
        for done in range(1, p["max_iter"] + 1):
            new = step(centres)
            moved = math.sqrt(sum((u - v) ** 2 for s, t in zip(new, centres, strict=True) for u, v in zip(s, t, strict=True)))
            centres = new
            if moved < p["epsilon"]:
                break
        self.centres_ = centres
        gone = self._removed(x, centres)
        gone = cut(gone.select("id"))
        n = gone.count()
        self.stats_ = {"n_majority": a, "n_minority": b, "n_removed": n, "iterations": done}
        return without(df, gone)

    def _removed(self, x: DataFrame, centres: list[list[float]]) -> DataFrame:
        p = self.params
        second = F.element_at(F.reverse(F.array_sort("mu")), 2)
        if p["method"] == "HKM":
            y = x.withColumn("_d", F.array_sort(F.array(*[F.sqrt(_squared(c)) for c in centres]))).withColumn("ratio", F.col("_d")[0] / (F.col("_d")[1] + 1e-10))
            q = p["percentile"] / 100
            limit = quantiles(y, F.array("ratio"), [q if p["mode"] == "central" else 1 - q])[0][0]
            return y.where(F.col("ratio") < limit if p["mode"] == "central" else F.col("ratio") > limit)
        if p["method"] == "FCM":
            return memberships(x, centres, p["m"]).where(second > p["membership"])
        y = rough(memberships(x, centres, p["m"]), centres, p["sigma"])
        return y.where(F.col("lower").isNull() | (F.lit(p["method"] == "FRKM") & (second > p["membership"])))


# --- synthesis ------------------------------------------------------------------------------------------------------


def interpolate(pairs: DataFrame, d: int, seed: int, salt: str) -> DataFrame:
    """pairs(g, label, fa, fb): rows at one random share of the way from fa to fb. Synthetic ids are -1 - g."""
    u = uniform(seed, salt, "g")
    mix = F.array(*[F.col("fa")[k] + (F.col("fb")[k] - F.col("fa")[k]) * u for k in range(d)])
    return pairs.select((-1 - F.col("g")).alias("id"), "label", mix.alias("features"), F.lit("synth").alias("origin"))


class SMOTE(Sampler):
    """Minority rows up to the majority's number, each between a minority row and one of its k minority neighbours."""

    def __init__(self, k: int = 5, seed: int = 42):
        super().__init__(k=k, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        _, lo, a, b = sides(df)
        x, seed = df.where(F.col("label") == lo), self.params["seed"]
        nn = knn(x, self.params["k"]).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "j"))), lambda s: s["j"]).alias("js"))
        # Rows without a neighbour (a class of one row) are not drawn from; without any, rows are drawn again.
        rows = numbered(x.select("id", "label", "features").join(nn.withColumnRenamed("i", "id"), "id"), F.col("id"))
        n = rows.count()
        if not n:
            self.stats_ = {"added": a - b, "repeated": a - b}
            return _out(df).unionByName(random_rows(x, a - b, seed, "base"))
        new = df.sparkSession.range(a - b).select(F.col("id").alias("g")).withColumn("n", F.floor(uniform(seed, "base", "g") * n).cast("long"))
        base = new.join(rows, "n").select("g", "label", F.col("features").alias("fa"), F.get("js", F.floor(uniform(seed, "pick", "g") * F.size("js")).cast("int")).alias("j"))
        pairs = base.join(x.select(F.col("id").alias("j"), F.col("features").alias("fb")), "j")
        self.stats_ = {"added": a - b}
        return _out(df).unionByName(interpolate(pairs, width(df), seed, "gap"))


def danger(df: DataFrame, k: int, lo: int) -> DataFrame:
    """(id, n_major): minority rows with some but not only majority rows among k neighbours."""
    c = knn(df.where(F.col("label") == lo), k, df).groupBy(F.col("i").alias("id")).agg(F.sum((F.col("yj") != lo).cast("int")).alias("n_major"), F.count(F.lit(1)).alias("n"))
    return c.where("n_major > 0 and n_major < n").select("id", "n_major")


class BorderlineSMOTE(Sampler):
    """One synthetic row for each endangered minority row, toward one of its minority neighbours."""

    def __init__(self, k: int = 5, seed: int = 42):
        super().__init__(k=k, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        _, lo, _, _ = sides(df)
        k, seed = self.params["k"], self.params["seed"]
        x = df.where(F.col("label") == lo)
        who = danger(df, k, lo)
        nn = knn(x, k).groupBy(F.col("i").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "j"))), lambda s: s["j"]).alias("js"))
        base = x.join(who, "id", "left_semi").join(nn, "id").select(F.col("id").alias("g"), "label", F.col("features").alias("fa"), F.get("js", F.floor(uniform(seed, "pick", "id") * F.size("js")).cast("int")).alias("j"))
        pairs = base.join(x.select(F.col("id").alias("j"), F.col("features").alias("fb")), "j")
        return _out(df).unionByName(interpolate(pairs, width(df), seed, "gap"))


class ODBOT(Sampler):
    """Draws rows in the box of the minority cluster that lies farthest from the majority's clusters; for each class but the largest."""

    def __init__(self, k: int = 2, percentage: float | None = None, seed: int = 42):
        if k <= 1:
            raise ValueError("k must be over 1")
        super().__init__(k=k, percentage=percentage, seed=seed)

    def _clusters(self, x: DataFrame, n: int):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        k, y = min(self.params["k"], n), x.withColumn("v", array_to_vector("features"))
        if k < 2:
            return y.withColumn("c", F.lit(0)), [np.array(x.first()["features"])]
        model = KMeans(k=k, seed=self.params["seed"], featuresCol="v", predictionCol="c").fit(y)
        return model.transform(y), model.clusterCenters()

    def resample(self, df: DataFrame) -> DataFrame:
        p, d = self.params, width(df)
        counts = sorted(((r["label"], r["count"]) for r in df.groupBy("label").count().collect()), key=lambda x: (-x[1], x[0]))
        hi, a = counts[0]
        _, far = self._clusters(df.where(F.col("label") == hi), a)
        out, self.stats_, made = _out(df), {}, 0
        for label, m in counts[1:]:
            pct = (a / m - 1) * 100 if p["percentage"] is None else p["percentage"]
            need = int(round(pct * m / 100, 9))
            x, centres = self._clusters(df.where(F.col("label") == label), m)
            best = max(range(len(centres)), key=lambda c: (sum(float(np.linalg.norm(centres[c] - z)) for z in far), -c))  # noqa: B023
            row = x.where(F.col("c") == best).agg(*[F.min(F.col("features")[k]) for k in range(d)], *[F.max(F.col("features")[k]) for k in range(d)]).first()
            g = F.col("id") + made
            new = df.sparkSession.range(max(0, need)).select((-1 - g).alias("id"), F.lit(label).cast("int").alias("label"), F.array(*[F.lit(row[k]) + uniform(p["seed"], f"box{k}_{label}", "id") * F.lit(row[d + k] - row[k]) for k in range(d)]).alias("features"), F.lit("synth").alias("origin"))
            out, made = out.unionByName(new), made + max(0, need)
            self.stats_[label] = need
        return out


class FCMBoostOBU(Sampler):
    """Borderline synthesis, fuzzy c-means with two clusters, and majority rows kept where they belong little to the minority's cluster."""

    def __init__(self, k: int = 5, m: float = 2.0, max_iter: int = 1000, error: float = 1e-5, seed: int = 42):
        super().__init__(k=k, m=m, max_iter=max_iter, error=error, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        p = self.params
        hi, lo, a, b = sides(df)
        boosted = cut(BorderlineSMOTE(p["k"], p["seed"]).resample(df))
        centres = first_centres(boosted, 2, p["seed"])
        for _ in range(p["max_iter"]):
            new = fuzzy_step(boosted, centres, p["m"])
            moved = max(abs(u - v) for s, t in zip(new, centres, strict=True) for u, v in zip(s, t, strict=True))
            centres = new
            if moved < p["error"]:
                break
        y = cut(memberships(boosted, centres, p["m"]))
        pos = y.where(F.col("label") == lo).agg(F.avg(F.col("mu")[0]), F.avg(F.col("mu")[1])).first()
        c = 1 if pos[1] > pos[0] else 0
        neg = y.where(F.col("label") == hi).agg(F.avg(F.col("mu")[1 - c]), F.avg(F.col("mu")[c])).first()
        self.mu_th_ = min(neg)
        out = y.where((F.col("label") == lo) | (F.col("mu")[c] < self.mu_th_))
        self.stats_ = {"synthetic": boosted.where("origin = 'synth'").count(), "kept": out.where(F.col("label") == hi).count()}
        return out.select("id", "label", "features", "origin")


# --- overlap regions ------------------------------------------------------------------------------------------------


def tomek_links(df: DataFrame) -> DataFrame:
    """(min_id, maj_id): rows of two classes that are each other's nearest row of all."""
    hi, lo, _, _ = sides(df, compat=True)
    nn = cut(knn(df, 1).select("i", "yi", "j", "yj"))
    back = nn.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return nn.where((F.col("yi") == lo) & (F.col("yj") == hi)).join(back, ["i", "j"], "left_semi").select(F.col("i").alias("min_id"), F.col("j").alias("maj_id"))


def tomek_like_pairs(df: DataFrame) -> DataFrame:
    """(min_id, maj_id): rows that are each other's nearest row of the other class."""
    hi, lo, _, _ = sides(df, compat=True)
    near = cut(nearest_by_class(df).select("i", "yi", F.col("other_j").alias("j")))
    back = near.where(F.col("yi") == hi).select(F.col("j").alias("i"), F.col("i").alias("j"))
    return near.where(F.col("yi") == lo).join(back, ["i", "j"], "left_semi").select(F.col("i").alias("min_id"), F.col("j").alias("maj_id"))


def overlap_region(df: DataFrame, k: int = 5) -> DataFrame:
    """(id): majority rows with a minority row among k neighbours."""
    hi, lo, _, _ = sides(df, compat=True)
    return knn(df.where(F.col("label") == hi), k, df).where(F.col("yj") == lo).select(F.col("i").alias("id")).distinct()


def iqr_filter(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Rows of which all features lie within factor interquartile ranges of the quartiles of all rows."""
    ok = F.lit(True)
    for k, (q1, q3) in enumerate(quantiles(df, F.col("features"), [0.25, 0.75])):
        ok = ok & F.col("features")[k].between(q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return df.where(ok)


def density_peaks(df: DataFrame, share: float = 0.02, rho_threshold: float = 0.045, delta_threshold: float = 0.25) -> DataFrame:
    """(id, rho, delta, noisy): density and distance to the nearest denser row, of the rows of one class.

    The cut-off distance is the mean distance to the neighbour of rank max(1, floor(share * n)). Equal densities are
    ordered by id; densities are summed as whole numbers, so that rows of one place have equal ones, in whatever order
    tasks end. rho and delta are scaled to 0..1; noisy rows are isolated: of little density, and far away.
    """
    x = cut(df.select("id", "label", "features"))
    n = x.count()
    rank = max(1, int(share * n))
    total, ends = knn(x, rank).where(F.col("rk") == rank).agg(F.sum(F.col("dist").cast("decimal(28,9)")), F.count(F.lit(1))).first()
    dc = float(total) / ends if total else 1.0

    def density(q: Block, e: Block) -> pa.Table:
        # In units of 2^-30, and what is left of them in units of 2^-60.
        v = np.exp(-((distances(q.x, e.x) / dc) ** 2)) * 2.0**30 if len(q.id) and len(e.id) else np.zeros((len(q.id), 0))
        return pa.table({"id": q.id, "high": np.floor(v).astype(np.int64).sum(1), "low": np.rint(v % 1 * 2.0**30).astype(np.int64).sum(1)})

    rho = (F.sum("high") + F.sum("low") / 2.0**30) / 2.0**30
    rho = cut(block_join(x, x, density, "id long, high long, low long").groupBy("id").agg(F.round(rho, 9).alias("rho")))
    y = cut(x.join(rho, "id"))

    def higher(q: Block, e: Block) -> pa.Table:
        near, far = np.full(len(q.id), np.inf), np.zeros(len(q.id))
        if len(q.id) and len(e.id):
            rq, re = (np.asarray(b.table.column("rho"), float) for b in (q, e))
            dist = distances(q.x, e.x)
            above = (re[None, :] > rq[:, None]) | ((re[None, :] == rq[:, None]) & (e.id[None, :] < q.id[:, None]))
            near, far = np.where(above, dist, np.inf).min(1), dist.max(1)
        return pa.table({"id": q.id, "near": np.where(np.isfinite(near), near, 1e300), "far": far})

    delta = block_join(y, y, higher, "id long, near double, far double").groupBy("id").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    z = cut(y.join(delta, "id").select("id", "rho", F.when(F.col("near") < 1e300, F.col("near")).otherwise(F.col("far")).alias("delta")))
    r = z.agg(F.min("rho"), F.max("rho"), F.min("delta"), F.max("delta")).first()
    scaled = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo) if hi is not None and hi > lo else F.lit(0.0)
    noisy = (scaled("rho", r[0], r[1]) <= rho_threshold) & (scaled("delta", r[2], r[3]) >= delta_threshold)
    return z.select("id", F.round("rho", 6).alias("rho"), F.round("delta", 6).alias("delta"), noisy.alias("noisy"))


# --- machines over one block ----------------------------------------------------------------------------------------


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and features on the driver, in the order of ids, for kernel machines: their solver goes from row to row."""
    rows = df.select("id", "label", "features").toPandas().sort_values("id", kind="stable")
    return rows["id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, 0))


def _ids(df: DataFrame, ids) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")


class SVDDWSMOTE(Sampler):
    """Two-class data description with noisy minority rows capped; removes majority rows at their bound and noisy minority rows inside.

    The minority is the target class and is found by count. Boxes are chosen on a grid, each point of it a task.
    """

    def __init__(self, rho_threshold: float = 0.045, delta_threshold: float = 0.25, n_c1: int = 5, n_sigma: int = 5):
        super().__init__(rho_threshold=rho_threshold, delta_threshold=delta_threshold, n_c1=n_c1, n_sigma=n_sigma)

    def resample(self, df: DataFrame) -> DataFrame:
        p = self.params
        hi, lo, a, b = sides(df)
        scaled = standard_scaler(df).transform(df)
        ids, label, x = _arrays(scaled)
        noisy = {r["id"] for r in density_peaks(scaled.where(F.col("label") == lo), rho_threshold=p["rho_threshold"], delta_threshold=p["delta_threshold"]).where("noisy").collect()}
        y, im = np.where(label == lo, 1.0, -1.0), a / b
        noise = np.isin(ids, list(noisy))

        def solve(c1: float, sigma: float):
            c2 = im * c1
            upper = np.where(y > 0, np.where(noise, c1, c2), c1)
            if upper[y > 0].sum() < 1:
                return None
            k = Kernel(x, y, "rbf", 1 / (2 * sigma**2))
            al = svdd(k, y, upper)
            major, minor = (y < 0) & (al >= c1 - 1e-5), (y > 0) & (al >= c2 - 1e-5)
            free = (al > 1e-5) & (al < upper - 1e-5)
            return float(major.sum() + im * minor.sum() + free.sum()), al, k, major, minor

        grid = [(float(c), float(s)) for c in np.logspace(-3, 2, p["n_c1"]) for s in np.linspace(0.5, 10, p["n_sigma"])]
        ship(df.sparkSession)

        def score(batches):
            for batch in batches:
                got = [solve(c, s) for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] if g else None for g in got], pa.float64())], ["c1", "sigma", "em"])

        points = df.sparkSession.createDataFrame(grid, "c1 double, sigma double").repartition(len(grid))
        best = points.mapInArrow(score, "c1 double, sigma double, em double").where("em is not null").orderBy("em", "c1", "sigma").first()
        if best is None:
            return _out(df)
        self.best_C1_, self.best_sigma_ = best["c1"], best["sigma"]
        _, al, k, major, minor = solve(best["c1"], best["sigma"])
        near = k.times(al)
        dist2 = k.diag - 2 * y * near + al @ near
        free = (al > 1e-5) & (al < np.where(y > 0, im, 1) * best["c1"] - 1e-5) & (y > 0)
        r2 = dist2[free].mean() if free.any() else dist2[y > 0].max()
        gone = ids[major | (minor & noise & (dist2 < r2))]
        self.stats_ = {"noisy": len(noisy), "removed": len(gone)}
        return without(df, _ids(df, gone))


class DeviOCSVM(Sampler):
    """Removes, by one-class machines per class and Tomek-like pairs: pairs with both ends in the overlap, sparse majority ends, and far twins.

    Row ids, not positions, tell rows apart after a removal.
    """

    def __init__(self, nu: float = 0.5, k2: int = 5, kernel: str = "rbf", gamma: float | str = "scale"):
        super().__init__(nu=nu, k2=k2, kernel=kernel, gamma=gamma)

    def resample(self, df: DataFrame) -> DataFrame:
        p = self.params
        hi, lo, _, _ = sides(df)
        over: set[int] = set()
        for label in (hi, lo):
            ids, _, x = _arrays(df.where(F.col("label") == label))
            over |= set(ids[OneClass(p["nu"], p["kernel"], p["gamma"]).fit(x).fitted < 0].tolist())
        pairs = lambda d: [(r["min_id"], r["maj_id"]) for r in tomek_like_pairs(d).collect()]
        gone = {i for ab in pairs(df) if ab[0] in over and ab[1] in over for i in ab}
        rest = cut(df.join(_ids(df, gone), "id", "left_anti"))
        some = rest.join(_ids(df, over), "id", "left_semi")
        left = pairs(rest) if rest.where(F.col("label") == lo).count() else []
        sparse = [m for s, m in left if m in over and s not in over]
        if sparse:
            c = knn(rest.join(_ids(df, sparse), "id", "left_semi"), p["k2"], some).groupBy("i").agg(F.sum(F.when(F.col("yj") == lo, 1).otherwise(-1)).alias("s"))
            gone |= {r["i"] for r in c.where("s > 0").collect()}
        outside = [m for s, m in left if m not in over and s not in over]
        if outside:
            major = rest.where(F.col("label") == hi)
            d = width(df)
            mean = list(major.agg(*[F.avg(F.col("features")[k]) for k in range(d)]).first())
            from_mean = {r["id"]: r["d"] for r in major.select("id", _squared(mean).alias("d")).collect()}
            twins = knn(major.join(_ids(df, outside), "id", "left_semi"), 1, major).collect()
            gone |= {r["i"] if from_mean[r["i"]] >= from_mean[r["j"]] else r["j"] for r in twins}
        self.stats_ = {"overlap": len(over), "removed": len(gone)}
        return without(df, _ids(df, gone))


class RFCL(Sampler):
    """Keeps the majority rows whose margin, by votes of a random forest's trees, is above a threshold chosen by cross-validated F1 of the minority."""

    def __init__(self, trees: int = 500, step: float = 0.05, folds: int = 3, seed: int = 42, classifier=None, score_trees: int = 20, score_depth: int = 5):
        """Candidate thresholds are scored by `classifier`, by default a forest of score_trees trees of at most score_depth levels."""
        super().__init__(trees=trees, step=step, folds=folds, seed=seed, classifier=classifier, score_trees=score_trees, score_depth=score_depth)

    def _forest(self, x: DataFrame, seed: int):
        from pyspark.ml.classification import RandomForestClassifier

        d = width(x)
        return RandomForestClassifier(featuresCol="v", numTrees=self.params["trees"], maxDepth=10, featureSubsetStrategy=str(min(d, int(math.log2(max(d, 1))) + 1)), seed=seed).fit(x)

    def _votes(self, model, x: DataFrame) -> DataFrame:
        """x with the part of trees that vote for class 1: trees as arrays, all of them over a batch at once."""
        flat = [_tree_arrays(t) for t in model.trees]
        ship(x.sparkSession)

        def vote(batches):
            for batch in batches:
                b = Block(pa.Table.from_batches([batch]))
                v = np.zeros(len(b.id))
                for feat, cutoff, left, right, value in flat:
                    node = np.zeros(len(b.id), int)
                    while True:
                        inner = np.flatnonzero(feat[node] >= 0)
                        if not len(inner):
                            break
                        n = node[inner]
                        node[inner] = np.where(b.x[inner, feat[n]] <= cutoff[n], left[n], right[n])
                    v += value[node]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v / max(1, len(flat)))], ["id", "one"])

        return x.select("id", "label", "features").mapInArrow(vote, "id long, one double")

    def resample(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        p = self.params
        hi, lo, a, b = sides(df, compat=True)
        x = cut(df.select("id", "label", "features").withColumn("label", F.col("label").cast("int")))
        x = cut(x.withColumn("v", array_to_vector("features")).join(folds_of(x, p["folds"], p["seed"]), "id"))
        one = cut(self._votes(self._forest(x, p["seed"]), x))
        share = F.col("one") if lo == 1 else 1 - F.col("one")
        m = cut(x.join(one, "id").withColumn("margin", 1 - 2 * share))
        major = m.where(F.col("label") == hi)
        r = major.agg(F.min("margin"), F.median("margin")).first()
        top = max(r[1], m.where(F.col("label") == lo).agg(F.median("margin")).first()[0]) + 0.05
        cuts = [-1.0] + [round(float(c), 6) for c in np.arange(r[0], top, p["step"])]
        # Candidates with the same kept rows share their fits.
        kept = major.agg(*[F.sum((F.col("margin") > c).cast("int")).alias(f"n{i}") for i, c in enumerate(cuts)]).first()
        of = {kept[i]: c for i, c in reversed(list(enumerate(cuts)))}
        with ThreadPoolExecutor(FITS) as pool:
            f1s = {(n, f): pool.submit(self._f1, m, c, f, hi, lo) for n, c in of.items() for f in range(p["folds"])}
            seen = {n: np.mean([f1s[n, f].result() for f in range(p["folds"])]) for n in of}
        best = (-1.0, None)
        for i, c in enumerate(cuts):
            if seen[kept[i]] > best[0]:
                best = (seen[kept[i]], c)
        self.threshold_ = best[1] if best[1] is not None else -1.0
        out = m.where((F.col("label") == lo) | (F.col("margin") > self.threshold_))
        self.rf_margin_ = m.select("id", "margin")
        self.stats_ = {"final": {"threshold": self.threshold_, "n_majority": out.where(F.col("label") == hi).count()}}
        return _out(out)

    def _f1(self, m: DataFrame, cutoff: float, fold: int, hi: int, lo: int) -> float:
        from pyspark.ml.classification import RandomForestClassifier

        train = m.where((F.col("fold") != fold) & ((F.col("label") == lo) | (F.col("margin") > cutoff)))
        if train.select("label").distinct().count() < 2:
            return 0.0
        est = self.params["classifier"] or RandomForestClassifier(featuresCol="v", numTrees=self.params["score_trees"], maxDepth=self.params["score_depth"], seed=self.params["seed"])
        got = est.copy().fit(train).transform(m.where(F.col("fold") == fold)).agg(
            F.sum(((F.col("label") == lo) & (F.col("prediction") == lo)).cast("int")), F.sum(((F.col("label") != lo) & (F.col("prediction") == lo)).cast("int")), F.sum(((F.col("label") == lo) & (F.col("prediction") != lo)).cast("int"))
        ).first()
        tp, fp, fn = (v or 0 for v in got)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def _tree_arrays(tree) -> tuple[np.ndarray, ...]:
    """Feature (-1 at a leaf), cut-off, left, right and class of each node of a fitted tree."""
    feat, cutoff, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        at = len(feat)
        for x in (feat, cutoff, left, right, value):
            x.append(-1)
        value[at] = node.prediction()
        if node.subtreeDepth() > 0:
            s = node.split()
            feat[at], cutoff[at] = s.featureIndex(), s.threshold()
            left[at], right[at] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(tree._call_java("rootNode"))
    return np.array(feat), np.array(cutoff, float), np.array(left), np.array(right), np.array(value, float)


def folds_of(df: DataFrame, folds: int, seed: int) -> DataFrame:
    """(id, fold): rows of each class are dealt to folds in turn, in the order of a hash."""
    labels, out = sorted(r["label"] for r in df.select("label").distinct().collect()), None
    for label in labels:
        rows = numbered(df.where(F.col("label") == label).select("id", uniform(seed, "fold", "id").alias("_u")), F.col("_u"), F.col("id"))
        rows = rows.select("id", (F.col("n") % folds).cast("int").alias("fold"))
        out = rows if out is None else out.unionByName(rows)
    return out


def nearest_until(a: np.ndarray, b: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): for each row of a the rows of b by distance (then place) up to the first that stays, one list after the other; all of b if none does."""
    lists, sizes = [], []
    step = max(1, (1 << 21) // max(1, len(b)))
    for k in range(0, len(a), step):
        dist = distances(a[k : k + step], b)
        last = np.where(stays[None, :], dist, np.inf).min(1, initial=np.inf)
        row, col = np.nonzero(dist <= last[:, None])
        best = np.lexsort((col, dist[row, col], row))
        row, col = row[best], col[best]
        # Rows that tie with the first that stays, but come after it, are never reached.
        before = np.cumsum(stays[col]) - stays[col]
        begin = np.searchsorted(row, np.arange(len(dist)))
        keep = before == before[begin[row]]
        lists.append(col[keep])
        sizes.append(np.bincount(row[keep], minlength=len(dist)))
    return (np.concatenate(lists), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])) if lists else (np.zeros(0, int), np.zeros(1, int))


class EHSO(Sampler):
    """Chooses by a genetic search which majority rows of the overlap to remove, then oversamples to equal classes.

    Fitness weighs what is left of the overlap (alpha) against the geometric mean of the 1-NN rule on held-out rows. The
    search holds on the driver, for each held-out row, the training rows it may remove that are nearer than the first it may not.
    """

    def __init__(self, k: int = 5, alpha: float = 0.1, population: int = 10, generations: int = 30, threshold: float = 0.25, mutation: float = 0.35, seed: int = 42):
        super().__init__(k=k, alpha=alpha, population=population, generations=generations, threshold=threshold, mutation=mutation, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        p, rng = self.params, np.random.default_rng(self.params["seed"])
        hi, lo, a, b = sides(df)
        ids, label, x = _arrays(df)
        self.overlapping_indices_ = sorted(r["id"] for r in overlap_region(df, p["k"]).collect())
        over = np.array(self.overlapping_indices_, np.int64)
        if not len(over):
            return RandomOverSampler(seed=p["seed"]).resample(df)
        # Three tenths of each class are held out.
        test = np.zeros(len(ids), bool)
        for c in (lo, hi):
            of = np.flatnonzero(label == c)
            test[rng.permutation(of)[: round(0.3 * len(of))]] = True
        bit = np.full(len(ids), -1)
        bit[np.searchsorted(ids, over)] = np.arange(len(over))
        bit_train, y_train, y_test = bit[~test], label[~test], label[test]
        order, starts = nearest_until(x[test], x[~test], bit_train < 0)

        def fitness(mask: np.ndarray) -> float:
            kept = ~((bit_train >= 0) & mask[np.maximum(bit_train, 0)])
            # The first of each list that is kept, or its first if none is.
            on = np.append(np.flatnonzero(kept[order]), len(order))
            first = on[np.searchsorted(on, starts[:-1])]
            pred = y_train[order[np.where(first < starts[1:], first, starts[:-1])]]
            sens = (pred[y_test == lo] == lo).mean() if (y_test == lo).any() else 0.0
            spec = (pred[y_test == hi] == hi).mean() if (y_test == hi).any() else 0.0
            ir = (a - mask.sum()) / b
            return p["alpha"] * (mask.mean() / max(ir, 1e-9)) + (1 - p["alpha"]) * math.sqrt(sens * spec)

        n, size = len(over), p["population"]
        pop = rng.random((size, n)) < 0.5
        fit = np.array([fitness(m) for m in pop])
        limit, stale = p["threshold"] * n, 0
        for _ in range(p["generations"]):
            new = []
            perm = rng.permutation(size)
            for i, j in zip(perm[::2], perm[1::2], strict=False):
                diff = np.flatnonzero(pop[i] != pop[j])
                if len(diff) and len(diff) >= limit:
                    swap = rng.permutation(diff)[: len(diff) // 2]
                    for s, t in ((i, j), (j, i)):
                        child = pop[s].copy()
                        child[swap] = pop[t][swap]
                        new.append(child)
            if new:
                both, score = np.vstack([pop, new]), np.concatenate([fit, [fitness(m) for m in new]])
                best = np.argsort(-score, kind="stable")[:size]
                stale = 0 if (best >= size).any() else stale + 1
                pop, fit = both[best], score[best]
            else:
                stale += 1
            limit -= 1
            if stale >= 10 or limit <= 0:
                lead = pop[fit.argmax()].copy()
                pop = np.where(rng.random((size, n)) < p["mutation"], ~lead, lead)
                pop[0] = lead
                fit, limit, stale = np.array([fitness(m) for m in pop]), p["threshold"] * n, 0
        self.removed_indices_ = over[pop[fit.argmax()]].tolist()
        rest = cut(df.join(_ids(df, self.removed_indices_), "id", "left_anti").select("id", "label", "features"))
        self.stats_ = {"overlapping": n, "removed": len(self.removed_indices_), "fitness": float(fit.max())}
        left = a - len(self.removed_indices_)
        return _out(rest) if left == b else RandomOverSampler(seed=p["seed"]).resample(rest)


class OSM(Sampler):
    """Scaling, balancing, Tomek links, feature choice, outlier box, clusters and a kernel machine, one after the other.

    transform_ carries new rows into the feature space of the result: scaled, and cut to the features chosen.
    """

    def __init__(self, n_clusters: int = 2, n_features: int | None = None, overlap_threshold: float = 0.3, balance: bool = True, tomek: bool = True, select: bool = True, outliers: bool = True, cluster: bool = True, svm: bool = True, seed: int = 42):
        super().__init__(n_clusters=n_clusters, n_features=n_features, overlap_threshold=overlap_threshold, balance=balance, tomek=tomek, select=select, outliers=outliers, cluster=cluster, svm=svm, seed=seed)

    def resample(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        p = self.params
        x = cut(impute(df))
        scaler = minmax_scaler(x)
        x = _out(scaler.transform(x))
        hi, lo, a, b = sides(x, compat=True)
        if p["balance"] and a > b:
            x = SMOTE(seed=p["seed"]).resample(x)
        x = cut(x)
        self.stats_ = {"balanced": x.count()}
        if p["tomek"]:
            x = cut(x.join(tomek_links(x).select(F.col("maj_id").alias("id")), "id", "left_anti"))
            self.stats_["tomek"] = x.count()
        d = width(x)
        self.selected_features = list(range(d))
        if p["select"]:
            from pyspark.ml.classification import RandomForestClassifier

            weight = RandomForestClassifier(featuresCol="v", numTrees=100, seed=p["seed"]).fit(x.withColumn("v", array_to_vector("features"))).featureImportances
            self.selected_features = sorted(range(d), key=lambda k: (-weight[k], k))[: p["n_features"] or max(6, d // 2)]
            x = x.withColumn("features", F.array(*[F.col("features")[k] for k in self.selected_features]))
        keep = list(self.selected_features)
        self.transform_ = lambda new: scaler.transform(new).withColumn("features", F.array(*[F.col("features")[k] for k in keep]))
        if p["outliers"]:
            x = cut(iqr_filter(x))
            self.stats_["outliers"] = x.count()
        if p["cluster"]:
            x = self._clusters(x)
        return x.select("id", "label", "features", "origin")

    def _clusters(self, x: DataFrame) -> DataFrame:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        p = self.params
        y = x.withColumn("v", array_to_vector("features"))
        model = KMeans(k=p["n_clusters"], seed=p["seed"], featuresCol="v", predictionCol="c").fit(y)
        y = cut(model.transform(y).drop("v"))
        dist = [F.sqrt(_squared(list(c))) for c in model.clusterCenters()]
        own = F.array(*dist)[F.col("c")]
        other = F.array_min(F.filter(F.array(*[F.when(F.col("c") != i, d) for i, d in enumerate(dist)]), lambda v: v.isNotNull()))
        mixed = y.groupBy("c").agg((F.count_distinct("label") > 1).alias("mixed"))
        y = cut(y.join(F.broadcast(mixed), "c").withColumn("gap", F.abs(own - F.coalesce(other, own))).withColumn("over", F.col("mixed") | (own / (F.coalesce(other, own) + 1e-10) > 0.7)))
        parts = {r["over"]: r["count"] for r in y.groupBy("over").count().collect()}
        if len(parts) < 2:
            limit = quantiles(y, F.array("gap"), [p["overlap_threshold"]])[0][0]
            y = y.withColumn("over", F.col("gap") <= limit)
        inner = y.where("not over")
        self.stats_["overlap"] = y.where("over").count()
        if p["svm"] and inner.count() >= 10 and inner.select("label").distinct().count() > 1:
            ids, label, z = _arrays(inner)
            wrong = ids[(SVC().fit(z, label).fitted > 0).astype(int) != label]
            y = y.join(_ids(x, wrong), "id", "left_anti")
            self.stats_["misclassified"] = len(wrong)
        return y


def impute(df: DataFrame, k: int = 5) -> DataFrame:
    """df with null features replaced by the mean of the k nearest rows that have them, weighted by inverse distance over the features both have."""
    d = width(df)
    gap = F.lit(False)
    for f in range(d):
        gap = gap | F.col("features")[f].isNull() | F.isnan(F.col("features")[f])
    holes = cut(df.where(gap))
    if holes.isEmpty():
        return df

    def near(q: Block, e: Block) -> pa.Table:
        ids, feats, dists, values = [], [], [], []
        for r in range(len(q.id)):
            diff = e.x - q.x[r]
            both = ~np.isnan(diff)
            n = both.sum(1)
            dist = np.where(n > 0, np.sqrt(np.where(both, diff, 0) ** 2 @ np.ones(d) * d / np.maximum(n, 1)), np.inf)
            dist[e.id == q.id[r]] = np.inf
            for f in np.flatnonzero(np.isnan(q.x[r])):
                ok = np.flatnonzero(np.isfinite(dist) & ~np.isnan(e.x[:, f]))
                ok = ok[np.lexsort((e.id[ok], dist[ok]))][:k]
                ids += [q.id[r]] * len(ok)
                feats += [f] * len(ok)
                dists += dist[ok].tolist()
                values += e.x[ok, f].tolist()
        return pa.table({"id": pa.array(ids, pa.int64()), "f": pa.array(feats, pa.int32()), "dist": pa.array(dists, pa.float64()), "value": pa.array(values, pa.float64())})

    got = block_join(holes, df, near, "id long, f int, dist double, value double")
    got = got.withColumn("rk", F.row_number().over(Window.partitionBy("id", "f").orderBy("dist", "value"))).where(F.col("rk") <= k)
    w = 1 / F.greatest("dist", F.lit(1e-12))
    filled = got.groupBy("id", "f").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("fill"))
    value = lambda f: F.coalesce(F.nanvl(F.col("features")[f], F.lit(None).cast("double")), F.try_element_at("fill", F.lit(f)))
    return df.join(filled, "id", "left").withColumn("features", F.array(*[value(f) for f in range(d)])).drop("fill")
