"""Overlap analysis: all measures of a table, their reading, and before against after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..operators import measures as m
from ..operators import structure as s
from ..operators.numerics import SVC
from ..operators.samplers import _arrays

FAMILIES = {
    "feature": ["f1", "f1v", "f2", "f3", "f4", "input_noise"],
    "instance": ["r_value", "d3", "cm", "kdn", "deg_overlap", "n3", "si", "n4", "borderline"],
    "structural": ["n1", "t1", "lsc", "clust", "dbc", "nsg", "icsv", "onb", "n2"],
    "multiresolution": ["mrca", "c1", "c2", "purity", "neighbourhood_separability"],
}
KEY = ["n3", "t1", "n1", "f1", "n2", "si"]


def available_measures() -> dict[str, list[str]]:
    return {k: list(v) for k, v in FAMILIES.items()}


class ComplexityMeasures:
    """Measures of one labelled table. Neighbours, enemies and covers are computed once and kept in the checkpoint folder."""

    def __init__(self, df: DataFrame, drop_first: bool = False):
        """drop_first leaves out the row of lowest id, as the compared toolkit's file bridge does."""
        x = df.select("id", "label", "features")
        self.df = cut(x.where(F.col("id") != x.agg(F.min("id")).first()[0]) if drop_first else x)
        self._held: dict[str, DataFrame] = {}

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._held:
            self._held[name] = cut(make())
        return self._held[name]

    @property
    def neighbours(self) -> DataFrame:
        return self._keep("nn", lambda: m.neighbours(self.df))

    @property
    def enemies(self) -> DataFrame:
        return self._keep("near", lambda: m.enemies(self.df))

    @property
    def balls(self) -> DataFrame:
        return self._keep("balls", lambda: s.onb_balls(self.df))

    def measure(self, name: str) -> DataFrame:
        df, counts = self.df, {r["label"]: r["count"] for r in self.df.groupBy("label").count().collect()}
        if name in ("f1", "f1v", "f2", "f3", "f4", "input_noise"):
            return getattr(m, name)(df)
        if name in ("d3", "cm", "kdn", "deg_overlap", "n3", "si", "borderline", "c1", "c2"):
            return getattr(m, name)(self.neighbours)
        makers = {
            "r_value": lambda: m.r_value(self.neighbours, counts), "n4": lambda: m.n4(df), "n2": lambda: m.n2(self.enemies), "lsc": lambda: m.lsc(df, self.enemies, m.ranges(df)),
            "dbc": lambda: s.dbc(df, self.balls), "nsg": lambda: s.nsg(df, self.balls), "icsv": lambda: s.icsv(df, self.balls),
        }
        if name in makers:
            return makers[name]()
        if name in ("n1", "t1", "clust", "onb", "mrca", "purity", "neighbourhood_separability"):
            return getattr(s, name)(df)
        raise ValueError(f"unknown measure {name!r}")

    def value(self, name: str) -> float:
        """A measure as one number: its value, or the mean of its values."""
        x = self.measure(name)
        return float(x.agg(F.avg("value" if "value" in x.columns else x.columns[0])).first()[0] or 0.0)

    def family(self, name: str) -> dict[str, float]:
        return {k: self.value(k) for k in FAMILIES[name]}

    def table(self, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
        """(family, measure, value) of all measures of some families."""
        rows = [(f, k, v) for f in families for k, v in self.family(f).items()]
        return self.df.sparkSession.createDataFrame(rows, "family string, measure string, value double")

    def calculate_n3(self) -> dict:
        v = self.value("n3")
        return {"overall": v, "level": level(v, 0.1, 0.3)}

    def calculate_t1(self) -> dict:
        v = self.value("t1")
        return {"normalized": v, "level": level(v, 0.2, 0.4)}

    def hardness_picture(self) -> DataFrame:
        """(id, label, pc, value, hardness): rows in two principal components, with their instance hardness."""
        h = m.instance_hardness(self.neighbours).select("id", F.col("value").alias("hardness"))
        return overlap_picture(self.df).join(h, "id")

    def svm_reduction(self) -> dict[int, float]:
        """Per class, the share of rows that are no support vectors (rbf, gamma .1, C 100)."""
        _, label, x = _arrays(self.df)
        sv = SVC(100.0, "rbf", 0.1).fit(x, label).support
        return {int(c): float(1 - (label[sv] == c).sum() / (label == c).sum()) for c in sorted(set(label))}

    def analyze_overlap(self, include_all: bool = False) -> dict:
        if include_all:
            out: dict = {f: self.family(f) for f in FAMILIES}
            flat = {k: v for f in out.values() for k, v in f.items()}
        else:
            flat = {k: self.value(k) for k in KEY}
            out = {"n3": {"overall": flat["n3"]}, "t1": {"normalized": flat["t1"]}, **{k: flat[k] for k in KEY if k not in ("n3", "t1")}}
        out["interpretation"] = interpret(flat)
        return out


def level(value: float, medium: float, high: float) -> str:
    return "high" if value > high else "medium" if value > medium else "low"


def interpret(v: dict[str, float]) -> dict:
    """Levels and advice; the overall level is the worse of N3's and T1's."""
    order = ["low", "medium", "high"]
    n3, t1 = level(v["n3"], 0.1, 0.2), level(v["t1"], 0.15, 0.3)
    worst = max(n3, t1, key=order.index)
    advice = {
        "high": "Classes overlap strongly: remove majority rows in the overlap before oversampling.",
        "medium": "Classes overlap in part: neighbourhood-based undersampling is worth a try.",
        "low": "Classes are well apart: random resampling will do.",
    }
    out = [advice[worst]]
    if v.get("n1", 0) > 0.5:
        out.append("The border between classes is long: prefer methods that clean it.")
    if v.get("f1", 1) < 1.0:
        out.append("Single features separate the classes in part: weigh or choose features.")
    return {"n3_level": n3, "t1_level": t1, "overall": worst, "recommendations": out}


def compare_pre_post(before: DataFrame, after: DataFrame, measures: tuple[str, ...] = ("n3", "t1", "n1", "n2", "si")) -> DataFrame:
    """(measure, before, after, absolute, relative): what resampling took away, and in percent of before (0 where that is not above 0)."""
    a, b = ComplexityMeasures(before), ComplexityMeasures(after)
    rows = []
    for k in measures:
        x, y = a.value(k), b.value(k)
        rows.append((k, round(x, 6), round(y, 6), round(x - y, 6) if x > 0 else 0.0, round((x - y) * 100 / x, 6) if x > 0 else 0.0))
    return before.sparkSession.createDataFrame(rows, "measure string, before double, after double, absolute double, relative double")


def overlap_picture(df: DataFrame, components: int = 2, source: DataFrame | None = None) -> DataFrame:
    """(id, label, pc, value): rows in the first principal components of source, or of their own; with source, before and after resampling share their axes."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..sources.labelled import width

    fit = df if source is None else source
    d = width(fit)
    mean = fit.agg(*[F.avg(F.col("features")[k]) for k in range(d)]).first()
    centred = lambda t: t.select("id", "label", array_to_vector(F.array(*[F.col("features")[k] - mean[k] for k in range(d)])).alias("v"))
    x = centred(df)
    y = x if d <= components else PCA(k=components, inputCol="v", outputCol="w").fit(centred(fit)).transform(x).drop("v").withColumnRenamed("w", "v")
    return y.select("id", "label", F.posexplode(vector_to_array("v")).alias("pc", "value"))


def resampling_table(before: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """(technique, n, majority, minority, ratio) of the source table and each result."""
    out = None
    for name, x in {"original": before, **results}.items():
        c = x.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.max("c").alias("majority"), F.min("c").alias("minority"))
        c = c.select(F.lit(name).alias("technique"), "*", F.round(F.col("majority") / F.col("minority"), 6).alias("ratio"))
        out = c if out is None else out.unionByName(c)
    return out
