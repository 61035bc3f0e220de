"""Exact dedup over an extendible-hash index on shared files.

Texts are equal when they are after white space is deleted. Each row has a 64-bit key of its normalised text. The index
is a folder of shared files: `directory`, the slots (a key's first bits) with the bucket that each points to, which doubles
where a bucket is overfull and splits in two, and `pages`, the buckets' pages, one folder for each owner of a run of buckets.

Building: keys are counted, and the directory grows over the counts. Texts of keys that more than one row has are compared
byte by byte where equal ones meet, then dealt out to the owner of their key's bucket, found through the directory; an owner
task sorts its range of keys and chains the different texts of one key, a page each. A key of one row has a page without a
text. Looking up: a row's key leads through the directory to its bucket, the bucket and the key to the chain, and in the
chain the text's SHA-256 to the page, which has the group's number of rows and the row that stays.

Copies of one text are summed before they are dealt out, so a text that a third of all rows share comes to its owner once
from each task; rows are looked up by a join that can be split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, ensure_checkpoint_dir

#: Bits of a key by which pages are counted; the directory has at most 2**16 slots, whatever the input.
DIRECTORY_BITS = 16
#: Pages in a bucket before it splits; larger where 2**16 slots would not do.
BUCKET_PAGES = 50_000
#: Runs of buckets, each with one owner task.
OWNERS = 1024
#: Keys of 8 bytes up to which they are broadcast, so that only texts of these keys are dealt out; beyond it all texts are.
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def grow_directory(counts: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The directory after all inserts: slots (bucket numbers), and bucket -> (first cell, local depth).

    counts: keys by their first `bits` bits. A bucket over capacity splits by its next bit; if its depth is the
    directory's, the directory doubles. At `bits` bits a bucket may stay overfull: its pages are chained.
    """
    upto = [0]
    for c in range(1 << bits):
        upto.append(upto[-1] + counts.get(c, 0))
    slots, depth = [0], 0
    buckets, todo = {0: (0, 0)}, [0]
    while todo:
        b = todo.pop()
        first, local = buckets[b]
        width = 1 << (bits - local)
        if local == bits or upto[first + width] - upto[first] <= capacity:
            continue
        if local == depth:
            slots, depth = [s for s in slots for _ in (0, 1)], depth + 1
        new = len(buckets)
        buckets[b], buckets[new] = (first, local + 1), (first + width // 2, local + 1)
        step = bits - depth
        for s in range((first + width // 2) >> step, (first + width) >> step):
            slots[s] = new
        todo += [b, new]
    return slots, buckets


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - DIRECTORY_BITS).cast("int")


def write_directory(spark: SparkSession, path: str, counts: dict[int, int], capacity: int, owners: int = OWNERS) -> None:
    """Writes path/directory: slot, bucket, owner. Owners have runs of buckets in the order of their keys."""
    capacity = max(capacity, 4 * sum(counts.values()) >> DIRECTORY_BITS)
    slots, buckets = grow_directory(counts, capacity)
    order = {b: k for k, b in enumerate(sorted(buckets, key=lambda b: buckets[b][0]))}
    rows = [(s, b, order[b] * min(owners, len(order)) // len(order)) for s, b in enumerate(slots)]
    spark.createDataFrame(rows, "slot int, bucket int, owner int").coalesce(1).write.parquet(f"{path}/directory")


def through_directory(rows: DataFrame, path: str) -> DataFrame:
    """rows(key, ...) with bucket and owner, as the directory at path has them; its slots, 2**16 at most, go with the plan."""
    slots = sorted(tuple(r) for r in rows.sparkSession.read.parquet(f"{path}/directory").select("slot", "bucket", "owner").collect())
    slot = F.shiftright(_cell(F.col("key")), DIRECTORY_BITS - (len(slots).bit_length() - 1))
    at = lambda k: F.element_at(F.lit([s[k] for s in slots]), slot + 1)
    return rows.withColumn("bucket", at(1)).withColumn("owner", at(2))


def build_index(entries: DataFrame, texts: DataFrame, path: str, capacity: int = BUCKET_PAGES) -> DataFrame:
    """Writes the index of entries(key, sha, best) and texts(key, norm, best) of the same rows to path; returns its pages.

    A page: bucket, key, chain, sha (null where the key has one row), n, best. best orders the rows of a group, the least stays.
    """
    spark = entries.sparkSession
    keys = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best")))
    counts = {r["cell"]: r["count"] for r in keys.groupBy(_cell(F.col("key")).alias("cell")).count().collect()}  # 2**16 rows at most
    write_directory(spark, path, counts, capacity)
    many = keys.where("n > 1").select("key")
    if many.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        many = F.broadcast(many)
    same = texts.join(many, "key", "left_semi").groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best"))
    dealt = through_directory(same, path).repartition("owner")
    chained = dealt.withColumn("chain", F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("norm")) - 1)
    chained = chained.select("owner", "bucket", "key", "chain", F.sha2("norm", 256).alias("sha"), "n", "best")
    single = through_directory(keys.where("n = 1"), path).select("owner", "bucket", "key", F.lit(0).alias("chain"), F.lit(None).cast("string").alias("sha"), "n", "best")
    chained.write.partitionBy("owner").parquet(f"{path}/pages")
    single.repartition("owner").write.mode("append").partitionBy("owner").parquet(f"{path}/pages")
    return spark.read.schema(f"bucket int, key long, chain int, sha string, n long, best {chained.schema['best'].dataType.simpleString()}, owner int").parquet(f"{path}/pages")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = BUCKET_PAGES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id. Null and
    empty texts are equal to each other. Rows that share a doc_id are rows of their own: where text, length and doc_id
    tie, the first in the order of a hash of the original text stays; rows that are equal in all of these count
    all, and the one with the smallest row number of this run stays. Null doc_ids come after others. The index stays at
    path if one is given, else it goes when all rows are looked up. An empty table gives an empty result; docs' other
    columns are not looked at.
    """
    spark, own = docs.sparkSession, path is None
    path = path or f"{ensure_checkpoint_dir(spark)}/exact-{uuid.uuid4().hex}"
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    norm = normalised(F.col("text"))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    best = lambda *more: F.struct((-chars).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).alias("d"), *more)
    read = base.select("doc_id", F.xxhash64(norm).alias("key"), norm.alias("norm"), best().alias("best"))
    entries = cut(read.select("doc_id", "key", "best", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    pages = build_index(entries, read, path, capacity)
    found = through_directory(entries, path).drop("owner")
    at = pages.select(F.col("bucket").alias("b2"), F.col("key").alias("k2"), F.col("sha").alias("s2"), F.col("n").alias("group_size"), F.col("best").alias("first"))
    # A key of one row has one page, and no text to tell apart.
    out = found.join(at, (F.col("bucket") == F.col("b2")) & (F.col("key") == F.col("k2")) & (F.col("s2").isNull() | (F.col("sha") == F.col("s2"))))
    out = out.withColumn("is_first", F.struct("best.a", "best.b", "best.d") == F.struct("first.a", "first.b", "first.d")).withColumn("is_first", F.col("is_first") & F.col("best.c").eqNullSafe(F.col("first.c")))
    out = cut(out.select("doc_id", F.col("first.c").alias("keep_id"), "group_size", "is_first", F.col("sha").alias("text_sha256"), "row"))
    # Rows that are first in their group and equal in all that orders it: one of them stays.
    ties = out.where("is_first").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("least")).where("m > 1")
    if own:  # all that follows is in checkpoints
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if not ties.isEmpty():
        ties = ties.select(F.col("text_sha256").alias("t2"), "least")
        out = out.join(ties, (F.col("text_sha256") == F.col("t2")) & F.col("is_first"), "left").withColumn("is_first", F.col("is_first") & F.coalesce(F.col("row") == F.col("least"), F.lit(True)))
    return out.select("doc_id", "keep_id", "group_size", F.col("is_first").alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with docs' columns. Where rows share a doc_id, the one with the longest text of those equal to the kept one stays."""
    groups = cut(exact_groups(docs, doc_id, text, **options))
    keep = groups.where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    repeats = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if repeats.isEmpty():
        return docs.join(keep, docs[doc_id].eqNullSafe(keep["_keep"]), "left_semi")
    repeats = cut(repeats)
    columns = docs.columns
    once = docs.join(repeats, docs[doc_id].eqNullSafe(repeats["_again"]), "left_anti")
    once = once.join(keep, once[doc_id].eqNullSafe(keep["_keep"]), "left_semi")
    again = docs.join(repeats, docs[doc_id].eqNullSafe(repeats["_again"]), "left_semi")
    row = again.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(doc_id).alias("_id"), F.coalesce(F.length(text), F.lit(0)).alias("_chars"), F.sha2(normalised(F.col(text)), 256).alias("_text"))
    row = row.join(keep, row["_id"].eqNullSafe(keep["_keep"]) & (F.col("_text") == F.col("_sha")), "left_semi")
    first = Window.partitionBy("_id", "_text").orderBy(F.desc("_chars"), F.xxhash64("_row"))
    return once.unionByName(row.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*"))


def op6(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL6 = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
