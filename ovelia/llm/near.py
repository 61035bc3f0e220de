"""Near duplicates: a Jaccard join of word shingles with Bayesian candidate pruning.

Rows with the same words are one representative. Representatives meet where a band of their MinHash values is equal.
In a bucket a pair's values are compared some at a time, and the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold, given the matches so far, is below a tolerance; what is left is compared by
its shingles, exactly. Pairs are never rows: tasks compare blocks of a bucket as arrays and return sums per document,
so a bucket of any size is dealt out as pairs of blocks, and every link counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.stages import numbered
from ..operators.graphs import components
from .common import cut, small
from .textarrays import U, Words, chunks, give_back, mix64, stream

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES, STEP = 128, 32
#: A pair is dropped when its chance to reach the threshold, by a uniform prior, is below this.
TOLERANCE = 1e-6
#: Representatives in a block of a bucket.
BLOCK = 2048

_FLIP, _TIMES = stream(101, HASHES), stream(102, HASHES) | U(1)


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> dict[int, int]:
    """n -> the fewest matches of n values with which a pair stays.

    Similarity has a uniform prior, matches are binomial, so the posterior is Beta(m + 1, n - m + 1), and its mass from
    the threshold up is the probability of at most m successes in n + 1 trials at the threshold.
    """
    out = {}
    for n in range(step, hashes + 1, step):
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                out[n] = m
                break
    return out


def minhash(shingles: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) 32-bit values; rows without shingles are not in first."""
    out = np.empty((len(first), hashes), np.uint32)
    if len(first):
        for k in range(hashes):
            x = shingles ^ _FLIP[k]
            x *= _TIMES[k]
            out[:, k] = np.minimum.reduceat(x, first) >> U(32)
    return out


def _shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, shingles, rows with shingles, and where each such row's shingles begin."""
    w = Words(raw, off)
    s, row = w.shingles(n)
    have, first = np.unique(row, return_index=True)
    return w, s, have, first


def _bands(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in chunks(batch.column(1)):
            w, s, have, first = _shingles(raw, off, words)
            h1, h2 = w.text_hashes()
            v = minhash(s, first, bands * rows).astype(U).reshape(len(first), bands, rows)
            key = np.zeros((len(first), bands), U) + stream(103, bands)
            for r in range(rows):
                key = mix64((key ^ v[:, :, r]) * U(0x9E3779B97F4A7C15))
            n = np.zeros(b - a, np.int64)
            n[have] = 1
            ends = np.concatenate([[0], np.cumsum(n * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.ravel().view(np.int64)))], ["doc", "h1", "h2", "bands"])
    give_back()


def _payload(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in chunks(batch.column(1)):
            _, s, have, first = _shingles(raw, off, words)
            v = minhash(s, first, HASHES)
            ends = np.append(first[1:], len(s))
            sets, sigs = [b""] * (b - a), [b""] * (b - a)
            for i, r in enumerate(have):
                sets[r], sigs[r] = np.unique(s[first[i] : ends[i]]).tobytes(), v[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sigs, pa.binary()), pa.array(sets, pa.binary()), batch.column(2)[a:b], batch.column(3)[a:b]], ["doc", "sig", "shingles", "weight", "in"])
    give_back()


class _Group:
    """Members of one bucket's pair of blocks; links() compares them."""

    def __init__(self, key: int, doc: list, weight: list, block: list, cross: bool, keys: list, sig: list, sets: list):
        self.key, self.cross = key, cross
        self.doc, self.weight, self.block = np.array(doc), np.array(weight), np.array(block)
        self.keys = keys
        self.sig = np.stack([np.frombuffer(x, np.uint32) for x in sig])
        self.sets = [np.frombuffer(x, U) for x in sets]

    def links(self, threshold: float, stay: dict[int, int]) -> np.ndarray:
        """Symmetric matrix of the links that this bucket is the first to meet."""
        n = len(self.doc)
        todo = np.triu(np.ones((n, n), bool), 1)
        if self.cross:
            todo &= self.block[:, None] != self.block[None, :]
        # A pair belongs to the smallest kept bucket that both are in.
        lengths = [len(k) for k in self.keys]
        flat, owner = np.concatenate(self.keys), np.repeat(np.arange(n), lengths)
        less = flat < self.key
        flat, owner = flat[less], owner[less]
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for rows in np.split(owner, np.flatnonzero(np.diff(flat)) + 1):
            if len(rows) > 1:
                todo[np.ix_(rows, rows)] = False
        out = np.zeros((n, n), bool)
        size = np.array([len(s) for s in self.sets])
        every = np.concatenate(self.sets)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, ids = np.unique(every, return_inverse=True)
        mark = np.zeros(ids.max() + 1 if len(ids) else 1, np.int32)
        for i in range(n):
            j = np.flatnonzero(todo[i])
            matches, seen = np.zeros(len(j), np.int64), 0
            for upto, least in stay.items():
                if not len(j):
                    break
                matches += (self.sig[j, seen:upto] == self.sig[i, seen:upto]).sum(1)
                ok = matches >= least
                j, matches, seen = j[ok], matches[ok], upto
            if len(j):
                own = ids[first[i] : first[i] + size[i]]
                mark[own] = 1
                if len(j) * 4 > n:
                    both = np.add.reduceat(mark[ids], first)[j]
                else:
                    both = np.array([mark[ids[first[x] : first[x] + size[x]]].sum() for x in j])
                mark[own] = 0
                # both / union >= threshold, in whole numbers
                hit = j[both * 10**6 >= round(threshold * 10**6) * (size[i] + size[j] - both)]
                out[i, hit] = out[hit, i] = True
        return out

    def result(self, threshold: float, stay: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with links, the weight of what they link to, and the smallest document they reach in here."""
        at = self.links(threshold, stay)
        have = np.flatnonzero(at.any(1))
        at = at[np.ix_(have, have)]
        root = self.doc[have].copy()
        while len(have):
            new = np.minimum(root, np.where(at, root[None, :], np.iinfo(np.int64).max).min(1))
            if (new == root).all():
                break
            root = new
        return self.doc[have], at @ self.weight[have], root


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, stay: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go on in the next batch."""
    names = ["key", "lo", "hi", "doc", "weight", "blk", "keys", "sig", "shingles"]
    held: list[dict] = []

    def close() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            g = held[0]
            group = _Group(g["key"], *[[h[c] for h in held] for c in ("doc", "weight", "blk")], g["lo"] != g["hi"], [np.array(h["keys"], np.int64) for h in held], [h["sig"] for h in held], [h["shingles"] for h in held])
            doc, links, root = group.result(threshold, stay)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(links.astype(np.int64)), pa.array(root, pa.int64())], ["doc", "links", "root"])
        held.clear()

    for batch in batches:
        for row in batch.select(names).to_pylist():
            if held and (held[0]["key"], held[0]["lo"], held[0]["hi"]) != (row["key"], row["lo"], row["hi"]):
                yield from close()
            held.append(row)
    yield from close()
    give_back()


def _nodes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of each row, where doc is a number that only rows of the same doc_id and text share; and, unless it is
    the doc_id everywhere, which doc_id and hash of the text each number is of.

    It is where doc_id is an integer and stands once. Others are numbered: rows without one or with one that rows of
    other texts have too, below all doc_ids; all rows in their order where doc_id is no integer.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    odd = base.groupBy("id").count().where(F.col("id").isNull() | (F.col("count") > 1)).select("id")
    if whole and odd.isEmpty():
        return base.select(F.col("id").cast("long").alias("doc"), "text"), None
    mark = F.xxhash64("text").alias("mark")
    odd = cut(odd).select(F.col("id").alias("o"))
    split = base.join(odd, F.col("id").eqNullSafe(F.col("o")), "left_semi") if whole else base
    named = numbered(split.select("id", mark).distinct(), F.col("id").asc_nulls_last(), "mark")
    least = (base.agg(F.min("id")).first()[0] or 0) - 1 if whole else 0
    named = cut(named.select("id", "mark", (F.lit(least).cast("long") - F.col("n") if whole else F.col("n")).alias("doc")))
    to = named.select(F.col("id").alias("i2"), F.col("mark").alias("m2"), "doc")
    rows = split.withColumn("mark", mark).join(to, F.col("id").eqNullSafe(F.col("i2")) & (F.col("mark") == F.col("m2"))).select("doc", "text").dropDuplicates(["doc"])
    if whole:
        rest = base.join(odd, F.col("id").eqNullSafe(F.col("o")), "left_anti").withColumn("doc", F.col("id").cast("long"))
        rows = rows.unionByName(rest.select("doc", "text"))
        named = named.unionByName(rest.select("id", mark, "doc"))
    return rows, named


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of each document of docs.

    Two documents link when the Jaccard similarity of their sets of `words` consecutive words (between white space) is
    at least threshold; a text of fewer words has one shingle of all of them. n_links counts a document's links, those
    to documents with the same words included; n_copies counts documents with the same words, itself included. class_id
    is the smallest doc_id that is reached over links, null only where none has one. Null, empty and blank texts link to
    nothing. Rows of the same doc_id and text are one document; a doc_id with several texts is several documents, and
    rows without a doc_id are documents by their text. An empty table gives an empty result; docs' other columns are not
    looked at. Recall: a pair at the threshold shares no band with probability (1 - 0.8**4)**24 = 3e-6, and is pruned
    with at most the tolerance.
    """
    return _classes(docs, doc_id, text, words, threshold, block).drop("mark", "first")


def _classes(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """near_duplicates, with the hash of the text as mark where doc_ids do not tell documents apart, else null; first: the
    document that stands for its class."""
    base, named = _nodes(docs, doc_id, text)
    got = _near_numbers(base, words, threshold, block)
    if named is None:
        return got.withColumnRenamed("doc", "doc_id").withColumn("first", F.col("doc_id") == F.col("class_id")).withColumn("mark", F.lit(None).cast("long"))
    got = cut(got.join(named, "doc"))
    # Of a class's documents the one with the smallest doc_id stands for it.
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("doc").alias("c"))
    least = got.groupBy(F.col("class_id").alias("k")).agg(F.min(order).alias("least"))
    got = got.join(least, F.col("class_id") == F.col("k"))
    return got.select(F.col("id").alias("doc_id"), F.col("least.b").alias("class_id"), "n_links", "n_copies", (F.col("doc") == F.col("least.c")).alias("first"), "mark")


def _near_numbers(base: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """doc, class_id, n_links and n_copies of base(doc, text), doc an integer that only rows with the same text share."""
    ship(base.sparkSession)
    # 1. One pass over all texts: hashes of the words, and bands.
    marks = cut(base.mapInArrow(lambda it: _bands(it, words, BANDS, ROWS), "doc long, h1 long, h2 long, bands array<long>"))
    full = marks.where(F.size("bands") > 0)
    same = cut(full.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("weight")))
    reps = same.select(F.col("rep").alias("doc"), "weight")
    # 2. Buckets of two or more; of buckets with the same members one is kept.
    banded = full.join(reps, "doc").select("doc", "weight", F.explode("bands").alias("key"))
    print_ = F.xxhash64(F.lit(7), "doc")
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(8), "doc")).alias("p"), F.bit_xor(print_).alias("x")).where("n > 1")
    kept = cut(buckets.groupBy("n", "p", "x").agg(F.min("key").alias("key")).select("key", "n"))
    member = cut(banded.join(small(kept), "key").select("doc", "weight", "key", "n").distinct())
    keys = member.groupBy("doc").agg(F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("key", "n"))).alias("in"))
    keys = cut(keys)
    # 3. Texts of documents in such buckets, again, to signatures and sets of shingles.
    # The buckets go with the text, so that nothing made of it is dealt out by document again.
    active = base.join(keys, "doc").select("doc", "text", "weight", "in")
    payload = active.mapInArrow(lambda it: _payload(it, words), "doc long, sig binary, shingles binary, weight long, in array<struct<key:long,n:long>>").where("length(sig) > 0")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = payload.select("doc", "weight", "sig", "shingles", F.expr("transform(in, k -> k.key)").alias("keys"), F.explode("in").alias("k"))
    placed = placed.select("doc", "weight", "sig", "shingles", "keys", "k.key", "k.n").withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64(F.lit(9), "doc"), F.col("nb").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    placed = placed.select("key", "lo", "hi", "doc", "weight", "blk", "keys", "sig", "shingles").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    stay = least_matches(threshold, TOLERANCE)
    found = cut(placed.mapInArrow(lambda it: _compare(it, threshold, stay), "doc long, links long, root long"))
    # 4. Classes, and results for all rows.
    roots = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    of_rep = reps.join(links, "doc", "left").join(roots, F.col("doc") == F.col("node"), "left")
    of_rep = of_rep.select(F.col("doc").alias("rep"), "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "doc").alias("class_id"))
    every = full.select("doc", "h1", "h2").distinct().join(same.select("h1", "h2", "rep"), ["h1", "h2"]).join(of_rep, "rep")
    every = every.select("doc", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n_copies"))
    alone = marks.where(F.size("bands") == 0).select("doc", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")).distinct()
    return every.unionByName(alone)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without documents of which another one, that of the smallest doc_id, stands for their class; docs' columns, whatever their names."""
    drop = cut(_classes(docs, doc_id, text, **options).where("not first").select(F.col("doc_id").alias("_drop"), F.col("mark").alias("_mark")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_drop")) & F.coalesce(F.col("_mark") == F.xxhash64(F.col(f"`{text}`")), F.lit(True))
    return docs.join(drop, same, "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, array_to_string(w, ' ') AS t, w FROM d WHERE len(w) > 0),
rep AS (SELECT t, min(doc_id) AS rep, count(*) AS n, any_value(w) AS w FROM x GROUP BY t),
s AS (SELECT DISTINCT rep, array_to_string(w[u.i:u.i + 4], ' ') AS s FROM rep, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i)),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z y ON y.rep = a JOIN z v ON v.rep = b WHERE 10 * p.n >= 8 * (y.n + v.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rep AS node, rep AS root FROM rep UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node),
k AS (SELECT e.a AS rep, sum(rep.n) AS n FROM e JOIN rep ON rep.rep = e.b GROUP BY e.a)
SELECT x.doc_id, m.root AS class_id, (coalesce(k.n, 0) + rep.n - 1)::BIGINT AS n_links, rep.n AS n_copies
FROM x JOIN rep USING (t) JOIN m ON m.node = rep.rep LEFT JOIN k ON k.rep = rep.rep
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM d WHERE len(w) = 0
"""
