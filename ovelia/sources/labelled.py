"""Sources of labelled tables, in one schema: id long, label int (0 majority, 1 minority), features array<double>."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import normal, uniform
from ..functions.stages import numbered


def encode_label(df: DataFrame, target: str, orient: bool = True) -> tuple[DataFrame, dict]:
    """Adds label: codes 0.. by sorted value; with two classes and orient, 1 is the rarer (ties keep the order). Also the mapping."""
    counts = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    values = sorted(counts)
    if orient and len(values) != 2:
        raise ValueError(f"two classes are needed, {len(values)} found")
    if orient and counts[values[0]] < counts[values[1]]:
        values.reverse()
    code = {v: i for i, v in enumerate(values)}
    expr = F.lit(None).cast("int")
    for v, i in code.items():
        expr = F.when(F.col(target) == F.lit(v), i).otherwise(expr)
    return df.withColumn("label", expr), code


@dataclass
class Scaler:
    """Per-feature centre and spread; a constant feature's spread is 1."""

    centre: list[float]
    spread: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(*[(F.col("features")[k] - m) / s for k, (m, s) in enumerate(zip(self.centre, self.spread, strict=True))]))

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(*[F.col("features")[k] * s + m for k, (m, s) in enumerate(zip(self.centre, self.spread, strict=True))]))


def width(df: DataFrame) -> int:
    row = df.select(F.size("features")).first()
    return row[0] if row else 0


def standard_scaler(df: DataFrame) -> Scaler:
    """Mean and population standard deviation."""
    d = width(df)
    row = df.agg(*[F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("features")[k]).alias(f"s{k}") for k in range(d)]).first()
    return Scaler([row[k] for k in range(d)], [row[d + k] or 1.0 for k in range(d)])


def minmax_scaler(df: DataFrame) -> Scaler:
    d = width(df)
    row = df.agg(*[F.min(F.col("features")[k]).alias(f"a{k}") for k in range(d)], *[F.max(F.col("features")[k]).alias(f"b{k}") for k in range(d)]).first()
    return Scaler([row[k] for k in range(d)], [(row[d + k] - row[k]) or 1.0 for k in range(d)])


def encode_categories(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, dict]]:
    """String columns as codes of their sorted values, one map for each column (their distinct values reach the driver)."""
    maps = {}
    for c in columns:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]
        maps[c] = {v: float(i) for i, v in enumerate(values)}
        pairs = [F.lit(x) for kv in maps[c].items() for x in kv]
        df = df.withColumn(c, F.try_element_at(F.create_map(*pairs), F.col(c)) if pairs else F.lit(None).cast("double"))
    return df, maps


def decode_categories(df: DataFrame, maps: dict[str, dict]) -> DataFrame:
    """The reverse of encode_categories: codes back to values, null where a code has none."""
    for c, codes in maps.items():
        pairs = [F.lit(x) for value, code in codes.items() for x in (code, value)]
        df = df.withColumn(c, F.try_element_at(F.create_map(*pairs), F.col(c).cast("double")) if pairs else F.lit(None).cast("string"))
    return df


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The rows of the lowest ids: each task keeps as many, none sorts the table."""
    return df.orderBy("id").limit(rows)


def feature_kinds(df: DataFrame, features: list[str]) -> list[int]:
    """0 for numeric features, 1 for categorical ones."""
    return [0 if isinstance(df.schema[c].dataType, T.NumericType) else 1 for c in features]


def from_dataframe(df: DataFrame, target: str, features: list[str] | None = None, id_col: str | None = None, standardise: bool = True, orient: bool = True) -> tuple[DataFrame, dict]:
    """A labelled table of df, and what was fitted: label codes, categories, scaler, names and kinds of features.

    Without id_col rows are numbered in the order of all their values. features defaults to all but target and id.
    """
    names = features or [c for c in df.columns if c not in (target, id_col)]
    kinds = feature_kinds(df, names)
    df, code = encode_label(df, target, orient)
    df, maps = encode_categories(df, [c for c, k in zip(names, kinds, strict=True) if k])
    if id_col is None:
        df, id_col = numbered(df, *[F.col(c) for c in names], F.col("label"), name="_id"), "_id"
    out = df.select(F.col(id_col).cast("long").alias("id"), "label", F.array(*[F.col(c).cast("double") for c in names]).alias("features"))
    fitted = {"labels": code, "categories": maps, "features": names, "kinds": kinds, "scaler": None}
    if standardise:
        fitted["scaler"] = standard_scaler(out)
        out = fitted["scaler"].transform(out)
    return out, fitted


def read_csv(spark: SparkSession, path: str, target: str, features: list[str] | None = None, label_map: dict | None = None, drop_first: bool = False, **options) -> tuple[DataFrame, dict]:
    """A CSV file with a header. label_map renames target values (others: 0); drop_first leaves the first data row out."""
    options.pop("standardise", None)
    df = spark.read.csv(path, header=True, inferSchema=True)
    if drop_first:
        df = numbered(df.withColumn("_at", F.monotonically_increasing_id()), F.col("_at"), name="_row").where("_row > 0").drop("_row", "_at")
    if label_map:
        expr = F.lit(0)
        for k, v in label_map.items():
            expr = F.when(F.col(target) == F.lit(k), F.lit(v)).otherwise(expr)
        df = df.withColumn(target, expr)
    return from_dataframe(df, target, features, **options)


_ATTRIBUTE = re.compile(r"@attribute\s+(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s+(.*)", re.I)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file: numeric attributes as double, others as string, `?` as null. The header is read on the driver, rows are not."""
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    header = [r[0] for r in lines.where(F.lower("value").startswith("@attribute")).collect()]
    names, numeric = [], []
    for h in header:
        m = _ATTRIBUTE.match(h)
        if m:
            names.append(m[1] or m[2] or m[3])
            numeric.append(bool(re.match(r"(numeric|real|integer)\b", m[4].strip(), re.I)))
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("@") & ~F.col("value").startswith("%"))
    parts = F.split("value", r"\s*,\s*")
    cell = lambda k: F.nullif(F.regexp_replace(F.get(parts, F.lit(k)), "^['\"]|['\"]$", ""), F.lit("?"))
    return rows.select(*[(cell(k).cast("double") if q else cell(k)).alias(c) for k, (c, q) in enumerate(zip(names, numeric, strict=True))])


def synthetic(spark: SparkSession, n_samples: int = 500, n_features: int = 10, imbalance_ratio: float = 5, overlap: float = 0.3, seed: int = 42) -> DataFrame:
    """Two Gaussian clusters per class; n_samples // (ratio + 1) minority rows; a share `overlap` of labels is drawn anew."""
    minority = int(n_samples / (imbalance_ratio + 1))
    informative = max(2, n_features - 2)
    df = spark.range(n_samples).withColumn("true", (F.col("id") < minority).cast("int")).withColumn("side", (F.col("id") % 2).cast("int"))
    sign = F.col("true") * 2 - 1
    cols = []
    for k in range(n_features):
        noise = normal(seed, f"x{k}", "id")
        centre = sign * (1.0 if k % 2 == 0 else 0.5) + (F.col("side") * 2 - 1) * (0.8 if k % 2 else -0.3) if k < informative else F.lit(0.0)
        cols.append(noise + centre)
    flipped = F.when(uniform(seed, "flip", "id") < overlap, (uniform(seed, "new", "id") < minority / max(1, n_samples)).cast("int")).otherwise(F.col("true"))
    return df.select("id", flipped.alias("label"), F.array(*cols).alias("features"))


def fraud_like(spark: SparkSession, seed: int = 42) -> DataFrame:
    """500 rows of N(0, 1) and 50 of N(0.5, 1.5) in ten features."""
    df = spark.range(550).withColumn("label", (F.col("id") >= 500).cast("int"))
    cols = [normal(seed, f"v{k}", "id") * F.when(F.col("label") == 1, 1.5).otherwise(1.0) + F.col("label") * 0.5 for k in range(10)]
    return df.select("id", "label", F.array(*cols).alias("features"))


def stratified_subset(df: DataFrame, keep: int, label: int = 1, seed: int = 42) -> DataFrame:
    """All rows but of one class, of which `keep` rows stay, by hash."""
    some = numbered(df.where(F.col("label") == label).withColumn("_u", uniform(seed, "subset", "id")), F.col("_u"), F.col("id")).where(F.col("n") < keep).drop("_u", "n")
    return df.where(F.col("label") != label).unionByName(some)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def class_distribution(df: DataFrame) -> DataFrame:
    """label, n and share of each class, n_samples, n_classes, imbalance ratio (two classes only), majority and minority label."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"), F.min_by("label", F.struct("n", -F.col("label"))).alias("minority"))
    out = counts.join(F.broadcast(one))
    return out.select("label", "n", F.round(F.col("n") / F.col("n_samples"), 6).alias("share"), "n_samples", "n_classes", F.when(F.col("n_classes") == 2, F.round(F.col("hi") / F.col("lo"), 6)).alias("imbalance_ratio"), "majority", "minority")


def columns(df: DataFrame, d: int) -> DataFrame:
    """id, label, f0..: the narrow access style, for expressions that compile."""
    return df.select("id", "label", *[F.col("features")[k].alias(f"f{k}") for k in range(d)])


def feature(k: int) -> Column:
    return F.col("features")[k]
