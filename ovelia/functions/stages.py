"""Checkpoints, size-checked broadcasts, distributed row numbers and quantiles."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 20_000
#: Bars between two values, and values that are counted one by one, per quantile.
BARS, FEW = 1_024, 4_096


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and Spark runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ovelia-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast of df if it has at most that many rows (they are counted), else df itself, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quantiles(df: DataFrame, values: Column, shares: list[float]) -> list[list[float]]:
    """For each element of an array column the exact quantiles, interpolated; missing values are left out.

    No task sees all values: ranks are narrowed down by counts in BARS equal bars between two values, which every task
    sums for itself, until the values between are at most FEW; only those are then counted one by one.
    """
    x = df.select(F.posexplode(values).alias("f", "v")).where("v is not null and not isnan(v)")
    whole = {r["f"]: (r["n"], r["lo"], r["hi"]) for r in x.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    places = {(f, p): p * (n - 1) for f, (n, _, _) in whole.items() for p in shares}
    # (element, rank) -> between which values it is, how many there are, and its rank among those.
    found = {(f, k): (whole[f][1], whole[f][2], whole[f][0], k) for (f, _), at in places.items() for k in (math.floor(at), math.ceil(at))}
    while True:
        rest = {t: s for t, s in found.items() if s[0] != s[1]}
        if not rest:
            break
        names = list(rest)
        plan = df.sparkSession.createDataFrame([(i, t[0], rest[t][0], rest[t][1], rest[t][2] <= FEW) for i, t in enumerate(names)], "t int, f int, lo double, hi double, few boolean")
        bar = F.when(F.col("few"), F.col("v")).otherwise(F.floor(F.least((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BARS, F.lit(BARS - 1.0))).cast("double"))
        bars = x.join(F.broadcast(plan), "f").where("v between lo and hi").groupBy("t", bar.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(bars, key=lambda r: (r["t"], r["b"])):
            t = names[r["t"]]
            if found[t] is rest[t]:
                k = rest[t][3]
                if k < r["n"]:
                    found[t] = (r["lo"], r["hi"], r["n"], k)
                else:
                    found[t] = rest[t] = (*rest[t][:3], k - r["n"])
    value = lambda f, at: found[f, math.floor(at)][0] if at == math.floor(at) else (math.ceil(at) - at) * found[f, math.floor(at)][0] + (at - math.floor(at)) * found[f, math.ceil(at)][0]
    return [[value(f, places[f, p]) for p in shares] for f in sorted(whole)]


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with row numbers from 0 in a total order, without a task that sees all rows.

    Rows are dealt out by ranges of the order and sorted there; a count per range gives each its offset.
    """
    part = F.shiftrightunsigned(F.col("_m"), 33)
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(total)]
        total += counts[p]
    at = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return rows.withColumn(name, (at + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m")
