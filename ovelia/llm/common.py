"""What several operators of this subpackage share: reading, checkpoints, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import BROADCAST_ROWS, cut, ensure_checkpoint_dir, small  # noqa: F401

#: White space of all word rules, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """body(value), where value is computed once for each row although body names it more than once.

    A column that a lambda names from outside is computed again for each element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words between white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the rows that no model learns from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, label: str, key: str, each: int, labels: int = 1000, seed: int = 5) -> DataFrame:
    """About `each` rows of every label, by a hash of the key; at most the `labels` most frequent labels. Adds _h, the hash.

    A label's rows are kept when their hash is below a share that its count sets, so no row is moved to choose them.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()
    space = 1 << 30
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(space))
    if not counts:
        return df.withColumn("_h", h).where(F.lit(False))
    most = F.create_map(*[x for r in counts for x in (F.lit(r[label]), F.lit(min(space, int(space * 1.15 * each / r["count"]) + 1)))])
    return df.withColumn("_h", h).where(F.col("_h") < F.try_element_at(most, F.col(label)))
