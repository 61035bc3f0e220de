"""Removal of repeated byte strings, by sparse prefix doubling.

A suffix array of a corpus tells for each position which others begin with the same THRESHOLD bytes. Prefix doubling
ranks positions by their first bytes, then sorts pairs of ranks at growing offsets, until ranks are unique or cover
the threshold. Over all positions of a corpus its first round alone would move some fifty times the input, so only
positions that can matter take part:

1. Each window of 50 bytes names its anchor, the smallest of the 31 hashed 20-byte strings in it; equal windows name
   equal anchors. One window in some sixteen begins a new anchor. Anchors that stand in one document only are unique.
2. For other anchors, the bytes of the windows that name them (a segment) are dealt out by anchor. A task ranks the
   positions of its segments by 8 bytes and doubles: pairs of ranks at offsets 8, 16 and 18 give ranks of 16, 32 and 50
   bytes; positions whose rank is unique leave the sort. A class of equal windows has the smallest document it is in.
3. Back at its document, a window of a class with a smaller document is removed.

Documents are dealt out into groups; what a group sends is pre-aggregated (each distinct anchor and segment once, with
its smallest document), so a passage that a third of all documents share reaches a task once per group, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .textarrays import BYTES, WORDS, WORDS2, RangeHash, U, buffers, mix64

THRESHOLD, GRAM = 50, 20
#: Bytes of text that a group of documents, or the anchors of one bucket, come from on average; at least so many groups.
GROUP_BYTES, LEAST_GROUPS = 3 << 20, 64
#: Bits of an anchor that are sent beside its bucket's number; a chance match only makes a candidate.
ANCHOR_BYTES = 5
#: Bytes whose windows are worked on at once.
PIECE = 1 << 18
_LOW = U((1 << 21) - 1)


class Runs:
    """Runs of windows of a piece that name the same anchor: first and last window, document, anchor's hash, key of the segment's bytes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lo: int, hi: int, keys: bool = True):
        """Windows that begin at lo..hi-1 of raw (a group's documents, one after the other). Without keys, key stays empty."""
        part = raw[lo : min(len(raw), hi + THRESHOLD - 1)]
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.key = np.zeros(0, U)
        n = len(part) - THRESHOLD + 1
        if n <= 0:
            return
        ranges = RangeHash(BYTES[part], WORDS)
        h = mix64((ranges.sums[GRAM:] - ranges.sums[:-GRAM]) * ranges.down[: len(part) - GRAM + 1])
        m = (h & ~_LOW) | np.arange(len(h), dtype=U)
        span, want = 1, THRESHOLD - GRAM + 1
        while 2 * span <= want:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if want > span:
            m = np.minimum(m[: len(m) - (want - span)], m[want - span :])
        at = (m & _LOW).astype(np.int32)
        # Windows that reach over a document's end name no anchor.
        for e in off[np.searchsorted(off, lo, "right") : np.searchsorted(off, lo + len(part), "left")] - lo:
            at[max(0, e - THRESHOLD + 1) : e] = -1
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(head[1:], n) - 1
        ok = at[head] >= 0
        head, last = head[ok], last[ok]
        self.doc = np.searchsorted(off, head + lo, "right") - 1
        self.anchor = h[at[head]] | U(1)
        if keys:
            other = RangeHash(mix64(BYTES ^ U(77))[part], WORDS2)
            self.key = mix64(other.get(head, last + THRESHOLD) ^ self.anchor)
        self.first, self.last = head + lo, last + lo


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ids of a group's documents, by id."""
    table = table.sort_by("doc")
    text = table.column("text").cast(pa.large_string()).combine_chunks()
    raw, off = buffers(text)
    return raw[off[0] : off[-1]] if len(off) > 1 else raw[:0], off - off[0], np.asarray(table.column("doc"), np.int64)


def _pieces(raw: np.ndarray, off: np.ndarray, keys: bool = True) -> Iterator[Runs]:
    for lo in range(0, len(raw), PIECE):
        yield Runs(raw, off, lo, min(len(raw), lo + PIECE), keys)


def _packed(bucket: np.ndarray, dg: int, **columns: np.ndarray) -> dict[str, list]:
    """Rows of a table by bucket, each column as bytes; bucket is sorted."""
    cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))[: len(cut)]
    out: dict[str, list] = {"bucket": bucket[cut].tolist(), "dg": [dg] * len(cut)}
    for name, x in columns.items():
        out[name] = [_short(x[a:b]) if name == "anchors" else _squeeze(x[a:b]) for a, b in zip(cut, ends, strict=True)]
    return out


def _short(anchor: np.ndarray) -> bytes:
    return np.ascontiguousarray(anchor.view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]).tobytes()


def _long(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, ANCHOR_BYTES)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :ANCHOR_BYTES] = part
    return out.view(U).ravel()


def _squeeze(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _expand(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n, "zstd", asbytes=True) if n else b"", kind)


def _column(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [_expand(b.as_py(), kind) for b in table.column(name)]


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> U(33)) % U(buckets)).astype(np.int64)


ANCHORS = pa.schema([("bucket", pa.int32()), ("dg", pa.int32()), ("anchors", pa.binary())])
REPEATED = pa.schema([("dg", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary())])
SEGMENTS = pa.schema([("bucket", pa.int32()), ("dg", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
FIRSTS = pa.schema([("dg", pa.int32()), ("keys", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _anchors(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    """Distinct anchors of a group; the lowest bit tells whether two of its documents have it."""
    raw, off, ids = _group(table)
    found = [(r.anchor, ids[r.doc]) for r in _pieces(raw, off, keys=False)]
    anchor, doc = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.zeros(0, U), np.zeros(0, np.int64))
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    start = np.flatnonzero(np.append(True, np.diff(anchor) != 0)) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(start[1:], len(anchor)) - 1 if len(anchor) else start
    out = np.where(doc[start] != doc[last], anchor[start], anchor[start] & ~U(1))
    bucket = _bucket(out, buckets)
    order = np.argsort(bucket, kind="stable")
    return pa.table(_packed(bucket[order], key[0].as_py(), anchors=out[order]), schema=ANCHORS)


def _repeated(table: pa.Table) -> pa.Table:
    """For each group the anchors of one bucket that stand in two documents or more, of whatever groups."""
    parts = [_long(b.as_py()) for b in table.column("anchors")]
    every = np.concatenate(parts) if parts else np.zeros(0, U)
    distinct, back, count = np.unique(every >> U(1), return_inverse=True, return_counts=True)
    many = count > 1
    many[back[(every & U(1)) == U(1)]] = True
    keep, at, out = many[back], 0, []
    for p in parts:
        out.append(_short(p[keep[at : at + len(p)]] | U(1)))
        at += len(p)
    return pa.table({"dg": table.column("dg"), "bucket": table.column("bucket"), "anchors": out}, schema=REPEATED)


def _segments(key: tuple, texts: pa.Table, repeated: pa.Table, buckets: int) -> pa.Table:
    """Distinct segments of a group's repeated anchors, each with its smallest document, dealt out by anchor."""
    raw, off, ids = _group(texts)
    tag = lambda bucket: U(bucket) << U(8 * ANCHOR_BYTES) if np.isscalar(bucket) else bucket.astype(U) << U(8 * ANCHOR_BYTES)
    known = np.sort(np.concatenate([np.zeros(0, U)] + [_long(a.as_py()) | tag(b.as_py()) for a, b in zip(repeated.column("anchors"), repeated.column("bucket"), strict=True)]))
    low = U((1 << 8 * ANCHOR_BYTES) - 1)
    found = []
    for r in _pieces(raw, off):
        if len(known) and len(r.anchor):
            own = (r.anchor & low) | tag(_bucket(r.anchor, buckets))
            hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            found.append((r.key[hit], r.anchor[hit], ids[r.doc[hit]], r.first[hit], r.last[hit] + THRESHOLD - r.first[hit]))
    if not found:
        return SEGMENTS.empty_table()
    k, anchor, doc, first, size = (np.concatenate([f[i] for f in found]) for i in range(5))
    order = np.lexsort((doc, k))
    one = order[np.append(True, np.diff(k[order]) != 0)] if len(k) else order
    bucket = _bucket(anchor[one], buckets)
    one = one[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket, kind="stable")
    out = _packed(bucket, key[0].as_py(), keys=k[one], docs=doc[one], sizes=size[one].astype(np.int32))
    out["bytes"] = []
    cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)) if len(bucket) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        n = size[one[a:b]]
        to = np.concatenate([[0], np.cumsum(n)])
        out["bytes"].append(_squeeze(raw[np.repeat(first[one[a:b]] - to[:-1], n) + np.arange(to[-1])]))
    return pa.table(out, schema=SEGMENTS)


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b) of ranks."""
    return np.unique(a.astype(np.int64) * np.int64(int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def first_documents(raw: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of segments (raw, off; each with its smallest document): its position, and the smallest document with equal bytes. By prefix doubling."""
    n = len(raw)
    windows = np.maximum(np.diff(off) - THRESHOLD + 1, 0)
    p = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum()) if len(off) > 1 else np.zeros(0, np.int64)
    best = np.repeat(doc, windows)
    if not len(p):
        return p, best
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = raw
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= wide[k : n + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    live = np.arange(len(p))
    # Ranks are of live windows' own positions and of those that their pairs reach into.
    rank = np.unique(eight, return_inverse=True)[1].astype(np.int32)
    size = 8
    del eight, wide
    while True:
        alone = np.bincount(rank[p[live]])[rank[p[live]]] == 1
        live = live[~alone]
        if size == THRESHOLD or not len(live):
            break
        grow = min(size, THRESHOLD - size)
        # A position takes part in the next sort if a live window reads its rank: at offset 0, or where a later pair reaches.
        need = np.zeros(n + THRESHOLD, bool)
        need[p[live]] = True
        after = size + grow
        while after < THRESHOLD:
            g = min(after, THRESHOLD - after)
            need[g:] |= need[:-g].copy()
            after += g
        q = np.flatnonzero(need[: n - grow])
        new = np.zeros(n, np.int32)
        new[q] = _rank(rank[q], rank[q + grow])
        rank, size = new, size + grow
        del new, q, need
    if len(live):
        r, d = rank[p[live]], best[live]
        order = np.lexsort((d, r))
        start = np.flatnonzero(np.append(True, np.diff(r[order]) != 0))
        best[live[order]] = np.repeat(d[order[start]], np.diff(np.append(start, len(order))))
    return p, best


def _firsts(table: pa.Table) -> pa.Table:
    """For each group and segment of one bucket: runs of its windows with the same smallest document."""
    keys, docs, sizes, raws = (_column(table, c, t) for c, t in (("keys", U), ("docs", np.int64), ("sizes", np.int32), ("bytes", np.uint8)))
    key, size, doc, raw = (np.concatenate(x) for x in (keys, sizes, docs, raws))
    # Groups that send the same segment share one copy of it.
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, back, doc)
    at, n = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[one], size[one].astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    p, best = first_documents(raw[np.repeat(at - off[:-1], n) + np.arange(off[-1])], off, least)
    seg = np.searchsorted(off, p, "right") - 1
    head = np.flatnonzero(np.append(True, (np.diff(seg) != 0) | (np.diff(best) != 0))) if len(p) else p
    runs = np.diff(np.append(head, len(p))).astype(np.int32)
    # Each segment's runs, for every group that sent it.
    begin = np.searchsorted(seg[head], np.arange(len(one) + 1))
    many = np.diff(begin)[back]
    upto = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(begin[back] - upto[:-1], many) + np.arange(upto[-1])
    key, runs, best = np.repeat(key, many), runs[row], best[head][row]
    cuts = upto[np.concatenate([[0], np.cumsum([len(k) for k in keys])])]
    pick = lambda x: [_squeeze(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"dg": table.column("dg"), "keys": pick(key), "runs": pick(runs), "docs": pick(best)}, schema=FIRSTS)


def _remove(texts: pa.Table, firsts: pa.Table) -> pa.Table:
    """Results of a group's documents."""
    raw, off, ids = _group(texts)
    get = lambda c, t: np.concatenate([np.zeros(0, t), *_column(firsts, c, t)])
    keys, runs, docs = get("keys", U), get("runs", np.int32).astype(np.int64), get("docs", np.int64)
    order = np.argsort(keys, kind="stable")
    keys, runs, docs = keys[order], runs[order], docs[order]
    change = np.zeros(len(raw) + 1, np.int32)
    for r in _pieces(raw, off):
        if not len(keys) or not len(r.key):
            continue
        a, b = np.searchsorted(keys, r.key), np.searchsorted(keys, r.key, "right")
        hit = np.flatnonzero(b > a)
        n = b[hit] - a[hit]
        row = np.repeat(hit, n)
        at = np.repeat(a[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        width = runs[at]
        upto = np.cumsum(width)
        begin = upto - width
        lead = np.concatenate([[0], np.cumsum(n)[:-1]])
        begin = begin - np.repeat(begin[lead], n) if len(begin) else begin
        gone = docs[at] < ids[r.doc[row]]
        first = r.first[row[gone]] + begin[gone]
        # Windows first .. first + width - 1 cover bytes up to the end of the last one.
        np.add.at(change, first, 1)
        np.add.at(change, first + width[gone] + THRESHOLD - 1, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    edge[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
    starts = np.flatnonzero((edge == 1) & gone)
    stop = np.append(~gone[1:], True) & gone
    stop[off[1:][np.diff(off) > 0] - 1] |= gone[off[1:][np.diff(off) > 0] - 1]
    stops = np.flatnonzero(stop) + 1
    at = np.searchsorted(starts, off)
    removed = np.concatenate([[0], np.cumsum(gone)])[off]
    sha, spans = [], []
    for i in range(len(ids)):
        body, cut = raw[off[i] : off[i + 1]], gone[off[i] : off[i + 1]]
        sha.append(hashlib.sha256((body[~cut] if at[i + 1] > at[i] else body).tobytes()).hexdigest())
        spans.append((np.stack([starts[at[i] : at[i + 1]], stops[at[i] : at[i + 1]]], 1) - off[i]).ravel().tolist())
    return pa.table({"doc_id": ids, "n_bytes": np.diff(off), "n_removed": np.diff(removed), "n_spans": np.diff(at), "kept_sha256": sha, "spans": spans}, schema=RESULT)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begins and ends, in bytes) of each row of docs.

    A byte is removed when a string of 50 bytes that covers it also starts in a document with a smaller doc_id; matches
    do not cross documents. Null and empty texts have no bytes. doc_id is an integer. Of rows without one nothing is
    removed, and they remove nothing: no doc_id is smaller or larger than theirs. Rows that repeat a doc_id do not remove
    from each other. Segments are told apart by 64-bit keys of their bytes: over 100 TB the chance that two of those
    whose anchors are equal share a key by accident is some 0.04. An empty table gives an empty result; docs' other
    columns are not looked at. A text is worked on whole, in pieces of 256 kB, beside some 30 bytes for each of its bytes.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    loose = base.where("doc is null").select(F.col("doc").alias("doc_id"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<bigint>").alias("spans"))
    base = base.where("doc is not null")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-total // GROUP_BYTES))
    base = base.withColumn("dg", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int"))
    texts = lambda: base.groupBy("dg")
    anchors = texts().applyInArrow(lambda key, t: _anchors(key, t, groups), _sql(ANCHORS))
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, _sql(REPEATED))
    segments = texts().cogroup(repeated.groupBy("dg")).applyInArrow(lambda key, t, r: _segments(key, t, r, groups), _sql(SEGMENTS))
    firsts = segments.groupBy("bucket").applyInArrow(_firsts, _sql(FIRSTS))
    return texts().cogroup(firsts.groupBy("dg")).applyInArrow(_remove, _sql(RESULT)).unionByName(loose)


def op2(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, u.i AS i, substr(h, 2 * u.i - 1, 100) AS s FROM d, unnest(range(1, len(h) // 2 - 48)) AS u(i)),
f AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN f USING (s) WHERE f < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS b FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(b), 1), len(any_value(h)) // 2 + 1 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS h FROM e JOIN d USING (doc_id) GROUP BY e.doc_id),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*)::BIGINT AS s FROM r GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(n.s, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
