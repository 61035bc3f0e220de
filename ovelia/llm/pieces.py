"""SentencePiece encoding with sampled segmentations, and decoding.

The pieces of a public model make a lattice over each text; forward filtering sums the weights of all paths to each
place, backward sampling draws a path from its end. Draws are hashes of the row's key and the place, so a row is
segmented alike wherever and whenever it is encoded. No piece goes on after a space that follows another character,
nor over a character that only has byte pieces: so the lattice of a text is one of its words after the other. Lattices
of distinct words are built once for a batch and drawn from for all of their occurrences at once, as arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .textarrays import BYTES, WORDS, RangeHash, U, chunks, give_back, mix64, stream

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weights are rank**-SHARPNESS, by the order in which the model merges its pieces; larger: fewer, longer pieces.
SHARPNESS = 1.5
#: Distinct words whose lattices a worker keeps, and bytes of new ones whose lattices are made at once.
KEPT, ADDED = 150_000, 1 << 15
SPACE = 32


@dataclass
class Vocabulary:
    """Pieces as bytes, with spaces for the model's space marks; which are bytes; log weights."""

    pieces: list[bytes]
    byte_ids: list[int]
    weights: list[float]
    usable: list[bool]

    @property
    def name(self) -> str:
        return hashlib.sha256(b"\0".join(self.pieces) + repr((self.byte_ids, self.weights)).encode()).hexdigest()


def load(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    """Reads a model on the driver; what tasks need of it is a part of the job. The model must have byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    byte_ids = [-1] * 256
    pieces, weights, usable = [], [], []
    worst = -sharpness * float(np.log(2 * n))
    for i in range(n):
        text = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            pieces.append(bytes([int(text[3:5], 16)]))
            weights.append(worst)
        else:
            pieces.append(text.replace("▁", " ").encode())
            weights.append(max(worst, -sharpness * float(np.log(2 - min(0.0, m.get_score(i))))))
        usable.append(not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    if min(byte_ids) < 0:
        raise ValueError("the model has no piece for some byte, so texts would not come back whole")
    if any(u and b" " in p.lstrip(b" ") for p, u in zip(pieces, usable, strict=True)):
        raise ValueError("the model has pieces that go on after a space")
    return Vocabulary(pieces, byte_ids, weights, usable)


class _Tables:
    """A vocabulary as arrays; one for each worker."""

    made: dict[str, _Tables] = {}

    def __init__(self, v: Vocabulary):
        self.size = np.array([len(p) for p in v.pieces])
        self.pool = np.frombuffer(b"".join(v.pieces), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.byte_ids = np.array(v.byte_ids, np.int32)
        self.weight = np.array(v.weights)
        below: list[dict[int, int]] = [{}]
        ends = [-1]
        plain = set()
        for i, p in enumerate(v.pieces):
            if v.usable[i]:
                plain |= set(p) if len(p.decode()) == len(p) else {b for b in p if b < 128}
                node = 0
                for b in p:
                    if b not in below[node]:
                        below[node][b] = len(below)
                        below.append({})
                        ends.append(-1)
                    node = below[node][b]
                ends[node] = i
        # 0, the root, for none.
        self.next = np.zeros((len(below), 256), np.uint16 if len(below) <= 1 << 16 else np.uint32)
        for k, d in enumerate(below):
            for b, c in d.items():
                self.next[k, b] = c
        self.ends = np.array(ends, np.int32)
        #: ASCII characters that are in no piece: each is a word of its own.
        self.lone = np.array([b < 128 and b not in plain for b in range(256)])
        self.clear()

    def clear(self) -> None:
        #: Keys of words in order, and each one's number.
        self.known, self.number = np.zeros(0, U), np.zeros(0, np.int32)
        self.base, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        # An edge goes back by its piece's bytes, so where it begins need not be kept.
        self.nodes, self.first, self.keys, self.piece = 0, np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.uint16 if len(self.size) <= 1 << 16 else np.int32)

    def _append(self, name: str, more: np.ndarray) -> None:
        """In place: two copies of what is kept never stand side by side."""
        kept = getattr(self, name)
        n = len(kept)
        kept.resize(n + len(more), refcheck=False)
        kept[n:] = more

    @classmethod
    def of(cls, v: Vocabulary) -> _Tables:
        if v.name not in cls.made:
            cls.made[v.name] = cls(v)
            give_back()
        return cls.made[v.name]

    def _edges(self, raw: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words that lie one after the other in raw: where they begin and end, and their ids. limit: each byte's end of word."""
        head = (raw & 0xC0) != 0x80
        pos = np.flatnonzero(head)
        node = np.zeros(len(pos), np.int32)
        cursor = pos.copy()
        out = []
        while len(pos):
            ok = cursor < limit[pos]
            pos, node, cursor = pos[ok], node[ok], cursor[ok]
            node = self.next[node, raw[cursor]]
            ok = node > 0
            pos, node, cursor = pos[ok], node[ok], cursor[ok] + 1
            done = self.ends[node]
            hit = done >= 0
            out.append((pos[hit], cursor[hit], done[hit]))
        begin, end, piece = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        # Characters without a piece of their own go by bytes.
        after = np.append(np.flatnonzero(head)[1:], len(raw))
        width = np.zeros(len(raw), np.int64)
        width[head] = after - np.flatnonzero(head)
        alone = np.zeros(len(raw), bool)
        alone[begin[(end - begin) == width[begin]]] = True
        owner = np.maximum.accumulate(np.where(head, np.arange(len(raw)), 0))
        bare = np.flatnonzero(~alone[owner])
        return np.concatenate([begin, bare]), np.concatenate([end, bare + 1]), np.concatenate([piece, self.byte_ids[raw[bare]]])

    def add(self, raw: np.ndarray, off: np.ndarray, keys: np.ndarray) -> None:
        """Adds the lattices of new words, with their sums filtered forward; keys are in order."""
        size = np.diff(off)
        limit = np.repeat(off[1:], size)
        begin, end, piece = self._edges(raw, limit)
        word = np.repeat(np.arange(len(size)), size)[begin]
        # A word of n bytes has n + 1 nodes.
        first = off[:-1] + np.arange(len(size))
        rel = end - off[word]
        here, source = first[word] + rel, first[word] + begin - off[word]
        order = np.argsort(here, kind="stable")
        here, source, piece, rel, word = here[order], source[order], piece[order], rel[order], word[order]
        total = np.full(off[-1] + len(size), -np.inf)
        total[first] = 0.0
        by = np.argsort(rel, kind="stable")
        cuts = np.searchsorted(rel[by], np.arange(1, (size.max() if len(size) else 0) + 2))
        value = np.empty(len(here))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                e = by[a:b]
                v = total[source[e]] + self.weight[piece[e]]
                value[e] = v
                start = np.flatnonzero(np.append(True, np.diff(here[e]) != 0))
                top = np.maximum.reduceat(v, start)
                top = np.where(np.isinf(top), 0.0, top)
                runs = np.diff(np.append(start, len(e)))
                with np.errstate(divide="ignore"):
                    total[here[e[start]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, runs)), start))
        part = np.exp(value - np.where(np.isinf(total[here]), 0.0, total[here]))
        run = np.cumsum(part)
        start = np.flatnonzero(np.append(True, np.diff(here) != 0)) if len(here) else np.zeros(0, np.int64)
        runs = np.diff(np.append(start, len(here)))
        share = run - np.repeat(run[start] - part[start], runs) if len(here) else run
        last = start + runs - 1
        share[last] = 1.0
        at = np.searchsorted(self.known, keys)
        self.known, self.number = np.insert(self.known, at, keys), np.insert(self.number, at, np.arange(len(self.base), len(self.base) + len(keys)))
        # Where each node's edges begin.
        edges = np.zeros(off[-1] + len(size), np.int32)
        edges[here[start]] = len(self.keys) + start
        for name, more in (("first", edges), ("keys", (self.nodes + here) + np.minimum(share, 1.0)), ("piece", piece), ("base", self.nodes + first), ("length", size)):
            self._append(name, more)
        self.nodes += int(off[-1] + len(size))

    def draw(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence (a known word and its seed) the pieces of one path: all ids in order, and how many each has."""
        base, at = self.base[word], self.length[word].astype(np.int64)
        live = np.arange(len(word))
        steps, taken = [], np.zeros(len(word), np.int64)
        k = 0
        while len(live):
            u = (mix64(seed[live] + U(k * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(11)) * 2.0**-53
            # Shares end at 1 in each node, so its edges have keys in (node, node + 1].
            node = base[live] + at[live]
            edge, until = self.first[node].astype(np.int64), node + np.maximum(u, 1e-6)
            late = np.flatnonzero(self.keys[edge] < until)
            while len(late):
                edge[late] += 1
                late = late[self.keys[edge[late]] < until[late]]
            piece = self.piece[edge]
            steps.append((live, piece))
            taken[live] += 1
            at[live] -= self.size[piece]
            live = live[at[live] > 0]
            k += 1
        ends = np.cumsum(taken)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for k, (live, piece) in enumerate(steps):
            out[ends[live] - 1 - k] = piece
        return out, taken

    def encode(self, raw: np.ndarray, off: np.ndarray, row_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's end. Non-empty texts get the model's leading space."""
        some = np.flatnonzero(np.diff(off) > 0)
        raw = np.insert(raw, off[some], SPACE)
        off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, lone = raw == SPACE, self.lone[raw]
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[off] = True
        fresh = fresh[:-1] | lone
        fresh[1:] |= (space[1:] & ~space[:-1]) | lone[:-1]
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(raw))
        key = RangeHash(BYTES[raw], WORDS).get(start, end) ^ (end - start).astype(U)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[start]
        ordinal = np.arange(len(start)) - np.searchsorted(start, off[:-1])[row]
        distinct, sample, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KEPT:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != distinct[at < len(self.known)]
        new = np.flatnonzero(new)
        if len(new):
            # A few words at once: a word's lattice takes many times its bytes while it is made.
            part = np.cumsum(end[sample[new]] - start[sample[new]]) // ADDED
            for some in np.split(new, np.flatnonzero(np.diff(part)) + 1):
                s = start[sample[some]]
                size = end[sample[some]] - s
                to = np.concatenate([[0], np.cumsum(size)])
                self.add(raw[np.repeat(s - to[:-1], size) + np.arange(to[-1])], to, distinct[some])
        word = self.number[np.searchsorted(self.known, distinct)][back]
        ids, taken = self.draw(word, mix64(row_seed[row] ^ (ordinal.astype(U) * U(0xD1342543DE82EF95))))
        upto = np.concatenate([[0], np.cumsum(taken)])
        return ids, upto[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and where each row's end."""
        size = self.size[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        raw = self.pool[np.repeat(self.at[ids] - to[:-1], size) + np.arange(to[-1])]
        rows = to[off]
        some = np.diff(rows) > 0
        return np.delete(raw, rows[:-1][some]), rows - np.concatenate([[0], np.cumsum(some)])


def _encode(batches: Iterator[pa.RecordBatch], v: Vocabulary, seed: int) -> Iterator[pa.RecordBatch]:
    give_back()
    t = _Tables.of(v)
    try:
        for batch in batches:
            for a, b, raw, off in chunks(batch.column(2)):
                key = np.array(batch.column(1)[a:b].to_pylist(), np.int64).view(U)
                ids, ends = t.encode(raw, off, mix64(key ^ stream(seed, 1)[0]))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], ["doc_id", "ids"])
            give_back()
    finally:
        # A worker outlives its task: what it holds for words would stay beside other stages' rows.
        t.clear()
        give_back()


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs: a sampled segmentation of the whole text, seeded by doc_id.

    Null and empty texts have no ids. Rows with the same doc_id and text are segmented alike.
    """
    ship(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, vocabulary, seed), f"doc_id {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    t = _Tables.of(v)
    for batch in batches:
        a = 0
        lists = batch.column(1)
        off = np.asarray(lists.offsets, np.int64)
        values = np.asarray(lists.values)
        while a < len(lists):
            b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 18), "right")) - 1)
            raw, ends = t.decode(values[off[a] : off[b]], off[a : b + 1] - off[a])
            text = pa.StringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], text], ["doc_id", "text"])
            a = b


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of encoded(doc_id, ids); null ids: an empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda it: _decode(it, vocabulary), f"doc_id {kind}, text string")


def encoded_digest(docs: DataFrame, vocabulary: Vocabulary, seed: int = 3) -> DataFrame:
    """doc_id, n_pieces, ids_hash, and of the text decoded from the ids: n_chars, text_sha256."""
    ids = encode(docs, vocabulary, seed=seed)
    carried = ids.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash")).alias("doc_id"), "ids")
    back = decode(carried, vocabulary)
    return back.select("doc_id.*", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    return encoded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
