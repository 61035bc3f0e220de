"""Toxicity by a subsequence string kernel.

The kernel of two words is a sum over their common subsequences of three characters, each weighing less the more it is
spread, normalised; so `id-iot`, `i d i o t` and `idxiot` stay close to `idiot`. A sentence is described by its
words' kernel with landmark words, each the largest in the sentence and measured by how rare it is in clean sentences, so
that a weak likeness counts as far as clean text does not show it. The Nyström map of that vector is what a linear support
vector machine, trained on sentences of labelled documents, sees. A landmark is a word or the beginning of words; what
begins like one contains it and is as like it as its own length allows, however the word goes on.

A document's score follows from its worst sentence and from the part of its words that the machine, asked about each of
them alone, calls toxic: one word that is an insult by chance of its letters is not what a document full of them is.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import bounded_sample, held_out, small
from .nystrom import inverse_root, logistic, svm
from .textarrays import BYTES, WORDS, RangeHash, chunks

ORDER, DECAY = 3, 0.5
LANDMARKS = 64
#: Bound of the documents that the model is fitted on, for each label, and of a sampled document's characters.
EACH, EACH_CHARS = 1500, 50_000
#: Longer words are cut into overlapping pieces of this many characters.
PIECE = 48
#: Beginnings of words that may be landmarks, in characters.
SHORT, LONG = 3, 8
#: Parts of the fitting sample; the scores' slopes are fitted on margins of machines that have not seen a document's part.
FOLDS = 3
#: What the kernel sees before and after a word; a landmark that is a beginning has none after it.
BEFORE, AFTER = "^^", "$"
THRESHOLD = 0.3
#: Steps of the kernel in the curve of its rarity, and the power that keeps common likeness small.
STEPS, POWER = 1024, 4
#: Candidates that are compared, and the least that one more landmark must add for each toxic document.
POOL, GAIN = 4000, 0.01
#: Rarity below which a sentence is like no landmark; rounds of choosing toxic documents' sentences.
FAINT, ROUNDS = 0.01, 2
#: Smoothing of the part of toxic words: hits and words that each document has besides, and the least part that is told apart.
HIT, FEW, LEAST = 0.05, 20, 1e-3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
#: Words whose kernels are kept, token rows of kernels, letter triples and pairs of letters of words that are held at once.
KNOWN, SLICE, TRIPLES, CELLS = 200_000, 1 << 16, 1 << 18, 1 << 14


def _kind(point: int) -> int:
    """1: a letter, or a mark that is one in its script; 2: white space; 0: all else, as accents laid over letters and what is not seen."""
    if 0x300 <= point < 0x370 or 0xFE00 <= point < 0xFE10 or 0xE0100 <= point < 0xE01F0 or point in (0x115F, 0x1160, 0x3164, 0xFFA0):
        return 0
    return {"L": 1, "M": 1, "Z": 2}.get(unicodedata.category(chr(point))[0], 0)


@cache
def _kinds() -> np.ndarray:
    return np.array([_kind(i) for i in range(1 << 16)], np.uint8)


def _classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to letters, and where white space is."""
    letter, white = _LETTER[raw], _WHITE[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        head = raw[lead].astype(np.int64)
        size = 2 + (head >= 0xE0) + (head >= 0xF0)
        point = head & (0x7F >> size)
        for k in range(1, 4):
            m = np.flatnonzero(size > k)
            point[m] = point[m] << 6 | raw[lead[m] + k] & 0x3F
        kind = _kinds()[np.minimum(point, 0xFFFF)]
        far = np.flatnonzero(point > 0xFFFF)
        if len(far):
            some, back = np.unique(point[far], return_inverse=True)
            kind[far] = np.array([_kind(int(i)) for i in some], np.uint8)[back]
        for k in range(4):
            m = np.flatnonzero(size > k)
            letter[lead[m] + k] = kind[m] == 1
        white[lead] = kind == 2
    return letter, white


class Tokens:
    """Words of a chunk in lower case: letters between white space, other characters left out, spelt-out words joined.

    letters, start, end: bytes; row: of the chunk; sentence: increasing over the chunk, never over two rows.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        raw = _LOWER[raw]
        letter, white = _classes(raw)
        at = np.flatnonzero(letter)
        self.letters = raw[at]
        rows = np.searchsorted(off, at, "right") - 1
        gap = np.cumsum(white)[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(gap) != 0) | (np.diff(rows) != 0)
        start = np.flatnonzero(fresh)
        if len(start):
            size, row = np.diff(np.append(start, len(at))), rows[start]
            spelt = np.zeros(len(start), bool)
            spelt[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
            start = start[~spelt]
        self.start, self.end = start, np.append(start[1:], len(at)).astype(np.int64) if len(start) else start
        self.row = rows[start]
        stop = np.cumsum(_STOP[raw])
        self.sentence = stop[at[start]] + self.row if len(start) else start

    def word(self, i: int) -> bytes:
        return self.letters[self.start[i] : self.end[i]].tobytes()

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and which of them each word is."""
        _, first, back = np.unique(RangeHash(BYTES[self.letters], WORDS).get(self.start, self.end), return_index=True, return_inverse=True)
        return [self.word(i) for i in first], back


def _points(words: list[str]) -> np.ndarray:
    """Characters of all words, one after the other."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(words: list[str]) -> np.ndarray:
    """(words, longest) characters, 0 after a word's end."""
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), size.max()), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = _points(words)
    return out


def _raw_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each row of a (n, s) with the same row of b (n, t) or with its only row; 0 pads.

    inner[i][j] is the weight of common subsequences of the order so far that end at or before i and j, spread included:
    what ends at both, summed along either side with the decay.
    """
    hit = np.where((a.T[:, None, :] == b.T[None, :, :]) & (a.T[:, None, :] != 0), decay * decay, 0.0)
    inner = hit
    for _ in range(1, order):
        inner = inner.copy()
        for j in range(1, inner.shape[1]):
            inner[:, j] += decay * inner[:, j - 1]
        for i in range(1, len(inner)):
            inner[i] += decay * inner[i - 1]
        end = np.zeros_like(hit)
        np.multiply(hit[1:, 1:], inner[:-1, :-1], out=end[1:, 1:])
        inner = end
    return inner.sum((0, 1))


def _own(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself, before it is normalised; words of a length together, as many as stay in a core's cache."""
    out, size = np.zeros(len(words)), np.array([len(w) for w in words], np.int64)
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        for part in np.array_split(rows, len(rows) * int(s) ** 2 // CELLS + 1):
            if len(part):
                a = _points([words[i] for i in part]).reshape(len(part), s)
                out[part] = _raw_kernel(a, a)
    return out


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@cache
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, n) places of all subsequences of three of so many characters, and their weights."""
    at = np.array(list(combinations(range(size), ORDER)), np.int64).T
    return at, DECAY ** (at[-1] - at[0] + 1.0)


class Likeness:
    """Kernels of words with all landmarks, none left out: normalised by both for words, by the landmark's own, up to 1, for beginnings,
    which are compared with all of a word but its last character, since it has to go on.

    The landmarks' triples of characters are numbered; a word's own are looked up, and each one found adds to the landmarks
    that have it. That is the kernel as `kernel` has it, with work only for what two words share.
    """

    def __init__(self, marks: list[bytes], whole: list[bool]):
        self.marks, self.whole = marks, np.array(whole, bool)
        self.shown = [BEFORE + m.decode() + AFTER * w for m, w in zip(marks, whole, strict=True)]
        self.used = np.unique(_points(self.shown))
        self.base = len(self.used) + 1
        found: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for k, (m, own) in enumerate(zip(self.shown, _own(self.shown), strict=True)):
            at, weight = _places(len(m))
            for t, w in zip(self._triples(self._code(_points([m]))[None, :], at)[0], weight, strict=True):
                found[int(t)][k] += w / (math.sqrt(own) if self.whole[k] else own)
        self.number = np.zeros(self.base**ORDER, np.int32)
        self.number[list(found)] = np.arange(1, len(found) + 1)
        self.first = np.cumsum([0, 0, *[len(v) for v in found.values()]])
        self.mark = np.array([k for v in found.values() for k in v], np.int64)
        self.part = np.array([w for v in found.values() for w in v.values()])
        self.known: dict[bytes, int] = {}
        self.store = np.zeros((0, len(marks)), np.float32)

    def _code(self, points: np.ndarray) -> np.ndarray:
        """Numbers from 1 for the landmarks' characters, 0 for others."""
        at = np.minimum(np.searchsorted(self.used, points), len(self.used) - 1)
        return np.where(self.used[at] == points, at + 1, 0)

    def _triples(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (code[:, at[0]] * self.base + code[:, at[1]]) * self.base + code[:, at[2]]

    def _kernels(self, shown: list[str]) -> np.ndarray:
        """(words, landmarks) of padded words."""
        out, size = np.zeros((len(shown), len(self.marks))), np.array([len(w) for w in shown])
        for s in np.unique(size):
            at, weight = _places(int(s))
            rows = np.flatnonzero(size == s)
            for part in np.array_split(rows, len(rows) * len(weight) // TRIPLES + 1):
                if not len(part):
                    continue
                code = self._code(_points([shown[i] for i in part])).reshape(len(part), s)
                number = self.number[self._triples(code, at)].ravel()
                hit = np.flatnonzero(number)
                number = number[hit]
                count = self.first[number + 1] - self.first[number]
                each = np.repeat(np.arange(len(hit)), count)
                place = np.arange(len(each)) + np.repeat(self.first[number] - np.cumsum(count) + count, count)
                step, mark = (hit % len(weight))[each], self.mark[place]
                cell = (hit // len(weight))[each] * len(self.marks) + mark
                value = np.where(self.whole[mark] | (at[-1][step] < s - 2), weight[step] * self.part[place], 0.0)
                out[part] = np.bincount(cell, value, len(part) * len(self.marks)).reshape(len(part), -1)
        return np.where(self.whole, out / np.sqrt(np.maximum(_own(shown), 1e-30))[:, None], np.minimum(out, 1.0))

    def gram(self) -> np.ndarray:
        """Rarity has no matrix of its own: the landmarks' likeness to each other, to the power that rarity has, both ways."""
        each = self._kernels([m if w else m + 2 * AFTER for m, w in zip(self.shown, self.whole, strict=True)]) ** POWER
        return (each + each.T) / 2

    def of(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks); values of words seen before are kept, up to a bound."""
        if len(self.known) > KNOWN:
            self.known, self.store = {}, self.store[:0]
        new = sorted({w for w in words if w not in self.known})
        if new:
            parts = [(i, p) for i, w in enumerate(new) for p in _pieces(w.decode()) if p]
            value = self._kernels([BEFORE + p + AFTER for _, p in parts])
            first = np.flatnonzero(np.diff([-1, *[i for i, _ in parts]]))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.store = np.vstack([self.store, np.maximum.reduceat(value, first, axis=0).astype(np.float32)])
        return self.store[np.fromiter((self.known[w] for w in words), np.int64, len(words))]


@dataclass
class Model:
    marks: list[bytes]
    whole: list[bool]
    curve: np.ndarray
    coef: np.ndarray
    intercept: float
    slope: np.ndarray | None = None
    shift: float = 0.0

    def margin(self, values: np.ndarray) -> np.ndarray:
        return rarity(values, self.curve) @ self.coef + self.intercept

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.slope + self.shift, -30, 30)))


def _steps(values: np.ndarray) -> np.ndarray:
    return np.clip(values * STEPS + 1e-3, 0, STEPS).astype(np.int64)


def _curve(seen: np.ndarray, n: int) -> np.ndarray:
    """(STEPS + 1, landmarks): the power of the logarithm of the part of clean sentences with at least that likeness, 0 for all and 1 for none.

    seen: of n clean sentences, how many have each step of likeness with each landmark.
    """
    count = seen[::-1].cumsum(0)[::-1]
    return ((np.log((n + 1) / (count + 1)) / math.log(n + 1)) ** POWER).astype(np.float32)


def rarity(values: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return curve[_steps(values), np.arange(curve.shape[1])]


def sentences(tokens: Tokens, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Rows and landmark vectors of the sentences that have a word."""
    if not len(tokens.start):
        return np.zeros(0, np.int64), np.zeros((0, len(like.marks)), np.float32)
    words, which = tokens.distinct()
    return _pooled(tokens, like.of(words), which)


def _pooled(tokens: Tokens, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sentences, and of their words' vectors the largest entries; values[which] are the words' vectors."""
    fresh = np.append(True, np.diff(tokens.sentence) != 0)
    number = np.cumsum(fresh) - 1
    out = np.zeros((number[-1] + 1, values.shape[1]), np.float32)
    for a in range(0, len(which), SLICE):
        n = number[a : a + SLICE]
        first = np.flatnonzero(np.append(True, np.diff(n) != 0))
        out[n[first]] = np.maximum(out[n[first]], np.maximum.reduceat(values[which[a : a + SLICE]], first, axis=0))
    return tokens.row[np.flatnonzero(fresh)], out


def _facts(tokens: Tokens, n: int, model: Model, like: Likeness) -> np.ndarray:
    """(n, 2): each row's worst sentence, and the logarithm of the part of its words that are toxic alone, smoothed."""
    worst, hits, count = np.full(n, model.intercept), np.zeros(n), np.zeros(n)
    if len(tokens.start):
        words, which = tokens.distinct()
        values = like.of(words)
        rows, vectors = _pooled(tokens, values, which)
        np.maximum.at(worst, rows, model.margin(vectors))
        hits = np.bincount(tokens.row, np.clip(model.margin(values), 0, 1)[which], n)
        count = np.bincount(tokens.row, minlength=n)
    return np.stack([worst, np.log(np.maximum((hits + HIT) / (count + FEW), LEAST))], 1)


def _beginnings(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of the first `size` characters of words that go on, of whole words for 0; once for each row."""
    heads = np.append(np.flatnonzero((tokens.letters & 0xC0) != 0x80), len(tokens.letters))
    first, past = np.searchsorted(heads, tokens.start), np.searchsorted(heads, tokens.end)
    ok = np.flatnonzero((past - first >= (size + 1 if size else SHORT)) & (tokens.end - tokens.start <= PIECE))
    start, end = tokens.start[ok], heads[first[ok] + size] if size else tokens.end[ok]
    h, row = RangeHash(BYTES[tokens.letters], WORDS).get(start, end), tokens.row[ok]
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(row) != 0))[: len(h)])
    return h[new], row[new], start[order][new], end[order][new]


def _candidates(held: list[tuple[int, Tokens]], toxic: np.ndarray, size: int) -> list[tuple[bytes, np.ndarray, float]]:
    """Words or beginnings (see _beginnings) that speak for a toxic document: the text, the toxic rows with it, its log odds.

    They stand in a hundredth of the toxic documents, in three at least, and at least four times as often there as elsewhere.
    """
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = []
    for c, (a, t) in enumerate(held):
        h, row, start, end = _beginnings(t, size)
        m = toxic[a + row] == 1
        found.append((h[m], a + row[m], np.full(m.sum(), c), start[m], end[m]))
    h, row, chunk, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    some, first, back, c1 = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if not len(some):
        return []
    c0 = np.zeros(len(some), np.int64)
    for a, t in held:
        h0, row0, _, _ = _beginnings(t, size)
        h0 = h0[toxic[a + row0] == 0]
        at = np.minimum(np.searchsorted(some, h0), len(some) - 1)
        c0 += np.bincount(at[some[at] == h0], minlength=len(some))
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    out = []
    for i in np.flatnonzero((c1 >= max(3, 0.01 * n1)) & (p1 > 4 * p0)):
        j = first[i]
        text = held[chunk[j]][1].letters[start[j] : end[j]].tobytes()
        out.append((text, np.unique(row[back == i]), float(np.log(p1[i] / p0[i]))))
    return out


def _landmarks(held: list[tuple[int, Tokens]], toxic: np.ndarray, most: int) -> tuple[list[bytes], list[bool]]:
    """Words and beginnings of words that together cover the toxic documents; the second list tells which are words.

    Greedy: the next landmark is the one with the largest sum, over toxic documents with it, of the root of its log odds
    over the square of one more than the landmarks that document has already. So words of a rare language get theirs,
    too. Of equal ones a word is taken before a beginning, a longer beginning before a shorter one; what begins a
    landmark, or begins like one, is left out.
    """
    best: dict[bytes, tuple[int, int, bytes, np.ndarray, float]] = {}
    for size in (0, *range(LONG, SHORT - 1, -1)):
        for text, rows, odds in _candidates(held, toxic, size):
            odds = math.sqrt(odds)
            best.setdefault(rows.tobytes() + np.float64(odds).tobytes(), (not size, len(text), text, rows, odds))
    pool = sorted(best.values(), key=lambda x: (-round(x[4] * len(x[3]), 6), not x[0], -x[1], x[2]))[:POOL]
    has = np.zeros((len(pool), len(toxic)), bool)
    for i, x in enumerate(pool):
        has[i, x[3]] = True
    odds, cover = np.array([x[4] for x in pool]), np.zeros(len(toxic))
    marks: list[bytes] = []
    whole: list[bool] = []
    free = np.ones(len(pool), bool)
    while len(marks) < most and free.any():
        gain = np.where(free, odds * (has @ (1 / (1 + cover) ** 2)), -1)
        k = int(np.argmax(gain))
        if marks and gain[k] < GAIN * toxic.sum():
            break
        word, _, text, _, _ = pool[k]
        marks.append(text)
        whole.append(bool(word))
        cover += has[k]
        free &= [not x[2].startswith(text) and not text.startswith(x[2]) for x in pool]
    return marks, whole


class _Sentences:
    """Sentences of labelled documents as the machine is trained on them: row, rarity vector, label. Those of clean documents
    that are like no landmark are counted only; an empty sentence counts for each clean document."""

    def __init__(self, held: list[tuple[int, Tokens]], toxic: np.ndarray, like: Likeness):
        n, seen = 0, np.zeros((STEPS + 1, len(like.marks)))
        self.blank = np.where(toxic == 1, 0.0, 1.0)
        for a, t in held:
            r, v = sentences(t, like)
            v = _steps(v[toxic[a + r] == 0])
            n += len(v)
            for k in range(v.shape[1]):
                seen[:, k] += np.bincount(v[:, k], minlength=STEPS + 1)
        seen[0] += self.blank.sum()
        self.curve = _curve(seen, n + int(self.blank.sum()))
        rows, values = [], []
        for a, t in held:
            r, v = sentences(t, like)
            r, v = r + a, rarity(v, self.curve)
            near = v.max(1) > FAINT
            self.blank += np.bincount(r[~near & (toxic[r] == 0)], minlength=len(toxic))
            rows.append(r[near])
            values.append(v[near])
        self.row, self.value, self.toxic = np.concatenate(rows), np.vstack(values), toxic
        self.first = self.value.max(1) if len(self.value) else np.zeros(0)

    def machine(self, to: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept from the documents in use: trained on toxic documents' likeliest sentences by rarity, then by margin."""
        like = self.first
        for _ in range(ROUNDS):
            best = np.full(len(self.toxic), -np.inf)
            np.maximum.at(best, self.row, like)
            bad = self.toxic[self.row] == 1
            keep = use[self.row] & (~bad | (like >= best[self.row] - 0.1 * np.abs(best[self.row])))
            value = np.vstack([self.value[keep], np.zeros((1, self.value.shape[1]), np.float32)])
            sign = np.append(np.where(bad[keep], 1.0, -1.0), -1.0)
            weight = np.append(np.where(bad[keep], 1 / np.maximum(np.bincount(self.row[keep & bad], minlength=len(use)), 1)[self.row[keep]], 1.0), self.blank[use].sum())
            weight = np.where(sign > 0, 0.5 * weight / max(weight[sign > 0].sum(), 1e-9), 0.5 * weight / weight[sign < 0].sum())
            coef, intercept = svm(value @ to, sign, weight)
            coef = to @ coef
            like = self.value @ coef + intercept
        return coef, intercept


def train(texts: list[str], toxic: np.ndarray, share: float, landmarks: int = LANDMARKS) -> Model | None:
    """A model of labelled texts; share is the part of toxic ones among all labelled rows, which the sample need not keep."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    column = pa.array(texts, pa.string())
    held = [(a, Tokens(raw, off)) for a, _, raw, off in chunks(column)]
    sizes = [b - a for a, b, _, _ in chunks(column)]
    marks, whole = _landmarks(held, toxic, landmarks)
    if not marks:
        return None
    like = Likeness(marks, whole)
    seen = _Sentences(held, toxic, like)
    to = inverse_root(like.gram(), 1e-3)
    facts, part = np.zeros((len(texts), 2)), np.random.default_rng(FOLDS).permutation(len(texts)) % FOLDS
    for k in range(FOLDS):
        if (toxic[part != k] == 1).any() and (toxic[part != k] == 0).any():
            model = Model(marks, whole, seen.curve, *seen.machine(to, part != k))
            some = np.concatenate([_facts(t, n, model, like) for (_, t), n in zip(held, sizes, strict=True)])
            facts[part == k] = some[part == k]
    model = Model(marks, whole, seen.curve, *seen.machine(to, np.ones(len(texts), bool)))
    weight = np.where(toxic == 1, share / toxic.sum(), (1 - share) / (toxic == 0).sum())
    model.slope, model.shift = logistic(facts, toxic.astype(float), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model | None:
    """A model of docs(doc_id, text) by labels(doc_id, toxic), from a bounded sample of labelled rows; None without both labels.

    The sample is drawn from the labels, so that only its ids meet the texts: they are broadcast, and no text is dealt out.
    """
    rows = labels.where("toxic in (0, 1)")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    some = bounded_sample(rows, "toxic", "doc_id", each).select("_h", "doc_id", "toxic")
    got = docs.where(F.length(F.coalesce("text", F.lit(""))) <= EACH_CHARS).join(small(some), "doc_id").select("_h", "doc_id", "toxic", "text").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["toxic", "_h", "doc_id"]).groupby("toxic").head(each)
    return train([t or "" for t in got["text"]], got["toxic"].to_numpy().astype(int), n[1] / (n[0] + n[1]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    like = Likeness(model.marks, model.whole)
    for batch in batches:
        out = [_facts(Tokens(raw, off), b - a, model, like) for a, b, raw, off in chunks(batch.column(1))]
        facts = np.concatenate(out) if out else np.zeros((0, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(facts))], ["doc_id", "score"])


def toxicity(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row of docs, over whole texts. Null, empty and blank texts score as a text without any likeness; without a model all score 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return rows.mapInArrow(lambda it: _score(it, model), f"doc_id {rows.schema[0].dataType.simpleString()}, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = held_out(F.col("doc_id"))
    model = fit(docs, labels.where(~held))
    out = toxicity(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
