"""What Python workers hold at once: results are those of the plain forms, for less."""

import tracemalloc

import numpy as np
import pyarrow as pa

from ovelia.llm import pieces, toxicity
from ovelia.llm.textarrays import U, mix64


def texts(n, size, seed=0):
    letters = np.random.default_rng(seed).choice(np.frombuffer(b"aaabcdeeeeghiklmnooprsttuv", np.uint8), (n, size))
    return [row.tobytes().decode() for row in letters]


def test_lattices_of_new_words_are_made_a_few_at_once():
    """A chunk of new words only: before, the lattices of all of them were made at once, some 400 bytes for each of theirs."""
    t = pieces._Tables.of(pieces.load())
    t.clear()
    raw = np.frombuffer(" ".join(texts(18_000, 12)).encode(), np.uint8)
    off = np.array([0, len(raw)])
    tracemalloc.start()
    ids, ends = t.encode(raw, off, mix64(np.array([7], U)))
    kept = sum(x.nbytes for k, x in vars(t).items() if k in ("first", "keys", "source", "piece", "base", "length"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - kept < 200 * len(raw)
    back, _ = t.decode(ids, np.array([0, len(ids)]))
    assert back.tobytes() == raw.tobytes()
    t.clear()
    assert (t.encode(raw[: len(raw) // 2], off // 2, mix64(np.array([7], U)))[0][:1000] == ids[:1000]).all()


def test_a_worker_keeps_no_lattices_after_its_task():
    """Before, they stayed beside the rows of whatever stage the worker served next, and each addition copied all of them."""
    v = pieces.load()
    t = pieces._Tables.of(v)
    t.clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([" ".join(texts(12_000, 12, s)) for s in (1, 2)])], ["doc_id", "k", "text"])
    tracemalloc.start()
    made = pieces._encode(iter([batch]), v, 3)
    first, second = next(made), next(made)
    kept = t.keys.nbytes
    raw = np.frombuffer(b" " + texts(1, 12, 3)[0].encode(), np.uint8)
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    t.add(raw, np.array([0, len(raw)]), np.array([7], U))
    assert tracemalloc.get_traced_memory()[1] - before < kept / 2
    tracemalloc.stop()
    assert not list(made) and not len(t.known) and not t.keys.nbytes
    alone = list(pieces._encode(iter([batch.slice(1)]), v, 3))
    assert first.num_rows == second.num_rows == 1 and alone[0].equals(second)


def plain(a, decay=0.5):
    """The kernel of each row with itself, cell by cell."""
    n, s = a.shape
    same = [[a[:, i] == a[:, j] for j in range(s)] for i in range(s)]
    inner, total = np.ones((s + 1, s + 1, n)), np.zeros(n)
    for p in range(1, 4):
        new = np.zeros((s + 1, s + 1, n))
        for i in range(1, s + 1):
            run = np.zeros(n)
            for j in range(1, s + 1):
                run = decay * run + np.where(same[i - 1][j - 1], decay * decay * inner[i - 1, j - 1], 0.0)
                new[i, j] = decay * new[i - 1, j] + run
                if p == 3:
                    total += np.where(same[i - 1][j - 1], decay * decay * inner[i - 1, j - 1], 0.0)
        inner = new
    return total


def test_own_kernels_stay_in_a_cache(monkeypatch):
    """Before, 512 words at once, padded to the longest, cell by cell."""
    words = texts(3_000, 40)
    mixed = [w[: 1 + k % 40] for k, w in enumerate(words)]
    held, kernel = [], toxicity._raw_kernel
    monkeypatch.setattr(toxicity, "_raw_kernel", lambda a, b: held.append((a.size * b.shape[1], (a == 0).any())) or kernel(a, b))
    for some in (words, mixed):
        got = toxicity._own(some)
        want = np.concatenate([plain(toxicity._padded([w])) for w in some[:120]])
        assert np.abs(got[:120] - want).max() < 1e-9
    assert max(n for n, _ in held) <= 1 << 15 and not any(padded for _, padded in held)
