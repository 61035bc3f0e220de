"""What a Python worker holds at once: before, a megabyte of text and its arrays, beside the executor's heap."""

import pyarrow as pa

from ovelia.llm.textarrays import chunks


def test_chunks_are_small_and_whole():
    texts = ["x" * (1 + k % 997) for k in range(4_000)]
    got = list(chunks(pa.array(texts)))
    assert [a for a, *_ in got] == [0, *[b for _, b, *_ in got][:-1]] and got[-1][1] == len(texts)
    assert all(len(raw) <= 1 << 18 for _, _, raw, _ in got)
    assert b"".join(raw.tobytes() for _, _, raw, _ in got).decode() == "".join(texts)
