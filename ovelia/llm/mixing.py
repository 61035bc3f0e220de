"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All of it is DataFrame expressions. Decisions for a source are a few numbers (its target, whole repetitions and hash
thresholds), so applying a mix to documents is a join with a table of one row per source and no shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import BARS, FEW, numbered
from .common import cut, small, word_count

#: Hashes have 62 bits; the top 12 of them are the bucket of a first, pre-aggregated pass.
HASH_BITS, BUCKET_BITS = 62, 12
#: How often what is still missing from a source's target is filled up with documents that fit.
PASSES = 3


def _hash(doc_id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - HASH_BITS)


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, ... by rank from 1."""
    return ((rank - 1) % 3 + 1).cast("double")


def water_level(sizes: DataFrame) -> float | None:
    """The level up to which sources(_fill, _cap, weight, source_size) fill, None where all reach their caps.

    What is taken up to a level, the caps of the sources that it fills and level * weight of the others, grows with it:
    between two fills the sources are summed in BARS equal bars, and the bar in which the words are all dealt out is
    taken next, until one fill is left. No task sees all sources.
    """
    sums = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.min("_fill").alias("lo"), F.max("_fill").alias("hi"), F.sum("_cap").alias("cap"), F.sum("weight").alias("weight"))
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    at, below, above = sums(sizes.groupBy()).first(), 0.0, 0.0
    if not at["n"] or at["cap"] < total:
        return None
    while at["lo"] != at["hi"]:
        lo, hi = F.lit(at["lo"]), F.lit(at["hi"])
        bar = F.col("_fill") if at["n"] <= FEW else F.floor(F.least((F.col("_fill") - lo) / (hi - lo) * BARS, F.lit(BARS - 1.0))).cast("double")
        bars = sorted(sums(sizes.where(F.col("_fill").between(lo, hi)).groupBy(bar.alias("b"))).collect(), key=lambda r: r["b"])
        rest = sum(r["weight"] for r in bars)
        for at in bars:
            rest -= at["weight"]
            if below + at["cap"] + at["hi"] * (rest + above) >= total or at is bars[-1]:
                break
            below += at["cap"]
        above += rest
    return (total - below) / (at["weight"] + above)


def targets(sizes: DataFrame, max_epochs: float = 3.0, weight=cyclic_weight) -> DataFrame:
    """Adds weight and target to sizes(src, source_size).

    Clamping at the cap and sharing the excess by weight, until no source is above its cap, ends at
    target = min(cap, level * weight).
    """
    df = numbered(sizes, F.col("src").asc_nulls_last(), name="_rank").withColumn("weight", weight(F.col("_rank") + 1))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_fill", F.col("_cap") / F.col("weight"))
    level = water_level(df)
    target = F.col("_cap") if level is None else F.least("_cap", F.lit(level) * F.col("weight"))
    return df.select("src", "source_size", "weight", target.alias("target"))


def _threshold(rows: DataFrame, plan: DataFrame, wanted: str) -> DataFrame:
    """For each source the largest hash up to which rows(src, size, h) sum to at most plan's column wanted.

    Sizes are first summed by (source, bucket), which spreads a hot source over 4096 keys; only rows of the one bucket
    in which the sum passes the target are then ordered.
    """
    low = HASH_BITS - BUCKET_BITS
    rows = rows.withColumn("b", F.shiftright("h", low))
    run = Window.partitionBy("src").orderBy("b")
    bars = rows.groupBy("src", "b").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(run))
    at = bars.join(plan.select("src", wanted), bars["src"].eqNullSafe(plan["src"])).drop(plan["src"])
    at = at.where(F.col("upto") > F.col(wanted)).groupBy("src").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("base"), F.col(wanted).alias("most"))).alias("x"))
    at = cut(at.select("src", "x.*"))
    one = small(at.withColumnRenamed("src", "s2").withColumnRenamed("b", "b2"))
    inside = rows.join(one, rows["src"].eqNullSafe(one["s2"]) & (F.col("b") == F.col("b2")))
    inside = inside.withColumn("run", F.sum("size").over(Window.partitionBy("src", "b").orderBy("h"))).where(F.col("base") + F.col("run") <= F.col("most"))
    inside = inside.groupBy(F.col("src").alias("s3")).agg(F.max("h").alias("last"))
    return at.join(inside, F.col("src").eqNullSafe(F.col("s3")), "left").select(F.col("src").alias("s4"), F.coalesce("last", F.shiftleft(F.col("b"), low) - 1).alias("thr"))


def plan_mix(rows: DataFrame, max_epochs: float = 3.0, weight=cyclic_weight) -> DataFrame:
    """rows(src, size, h) -> one row per source: source_size, target, whole, rest0.., thr0... (see copies())."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, max_epochs, weight)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", F.least(whole, F.lit(int(max_epochs))).cast("long"))
    plan = cut(plan.withColumn("rest0", F.col("target") - F.col("whole") * F.col("source_size")))
    for k in range(PASSES):
        near = small(plan.withColumnRenamed("src", "s1"))
        open_ = rows.join(near, rows["src"].eqNullSafe(near["s1"])).where(_open(k))
        thr = _threshold(open_.select(rows["src"], "size", "h"), plan, f"rest{k}")
        # Without a threshold all that is open fits.
        plan = plan.join(thr, plan["src"].eqNullSafe(thr["s4"]), "left").withColumn(f"thr{k}", F.coalesce("thr", F.lit(1 << HASH_BITS))).drop("s4", "thr")
        if k + 1 < PASSES:
            plan = cut(plan)
            near = small(plan.withColumnRenamed("src", "s1"))
            got = rows.join(near, rows["src"].eqNullSafe(near["s1"])).where(_open(k) & (F.col("h") <= F.col(f"thr{k}"))).groupBy(rows["src"].alias("s5")).agg(F.sum("size").alias("got"))
            plan = plan.join(got, plan["src"].eqNullSafe(got["s5"]), "left").withColumn(f"rest{k + 1}", F.col(f"rest{k}") - F.coalesce("got", F.lit(0))).drop("s5", "got")
        plan = cut(plan)
    return plan


def _open(k: int) -> Column:
    """Rows of pass k: not taken by an earlier pass, and small enough for what is missing."""
    ok = (F.col("size") > 0) & (F.col("size") <= F.col(f"rest{k}")) if k else F.col("size") > 0
    for j in range(k):
        ok = ok & ~_taken(j)
    return ok


def _taken(k: int) -> Column:
    fits = (F.col("size") <= F.col(f"rest{k}")) if k else F.lit(True)
    return fits & (F.col("h") <= F.col(f"thr{k}"))


def _copies() -> Column:
    extra = _taken(0)
    for k in range(1, PASSES):
        extra = extra | _taken(k)
    return F.col("whole") + F.when(extra & (F.col("size") > 0), 1).otherwise(0)


def _decided(docs: DataFrame, source: str, doc_id: str, text: str, max_epochs: float, seed: int, weight) -> DataFrame:
    """_row (docs' columns as they are), size, source_size, target and copies of each row."""
    col = lambda name: F.col(f"`{name}`")
    base = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), col(source).alias("_s"), word_count(col(text)).alias("_n"), _hash(col(doc_id), seed).alias("_h"))
    narrow = cut(base.select(F.col("_s").alias("src"), F.col("_n").alias("size"), F.col("_h").alias("h")))
    return apply_plan(base, plan_mix(narrow, max_epochs, weight))


def apply_plan(base: DataFrame, plan: DataFrame) -> DataFrame:
    """base(_row, _s, _n, _h) with the decisions of its source."""
    near = small(plan.select(F.struct("*").alias("_plan"), F.col("src").alias("_src")))
    held = base.select("_row", "_s", F.col("_n").alias("size"), F.col("_h").alias("h"))
    out = held.join(near, held["_s"].eqNullSafe(near["_src"])).select("_row", "size", "h", "_plan.*")
    return out.select("_row", "size", "source_size", "target", _copies().cast("long").alias("copies"))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", max_epochs: float = 3.0, seed: int = 17, weight=cyclic_weight) -> DataFrame:
    """docs with size, source_size, target, copies and taken: how often the mix takes each document.

    A source's target is its share by weight of all words, at most max_epochs times its own words, the excess shared by
    weight among the others. target // source_size repetitions take every document; the fractional one takes documents
    in the order of a seeded hash of doc_id until the target is reached, then smaller ones that still fit.
    Null sources are one source, after the others. Null and empty texts have size 0 and are taken whole times only.
    Rows that share doc_id and source are taken alike. An empty table gives an empty result. Columns of docs that have
    the names of this operator's are replaced; mixed_documents keeps them.
    """
    own = ("size", "source_size", "target", "copies")
    out = _decided(docs, source, doc_id, text, max_epochs, seed, weight)
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (*own, "taken")]
    return out.select(*kept, *own, (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", max_epochs: float = 3.0, seed: int = 17, weight=cyclic_weight) -> DataFrame:
    """The mix itself: docs' rows with all their columns, whatever their names, each as often as the mix takes it."""
    out = _decided(docs, source, doc_id, text, max_epochs, seed, weight).where(F.col("copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    base = docs.select(F.struct("doc_id").alias("_row"), F.col("source").alias("_s"), word_count(F.col("text")).alias("_n"), _hash(F.col("doc_id"), 17).alias("_h"))
    base = cut(base)
    plan = plan_mix(base.select(F.col("_s").alias("src"), F.col("_n").alias("size"), F.col("_h").alias("h")))
    return apply_plan(base, plan).select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
