"""The pipeline, stage by stage, each judged on what the stage before it left."""

import re
from collections import Counter

import corpus_pipeline
from ovelia.functions.stages import cut
from ovelia.llm import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def _shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        left[name] = docs
    columns = left["documents"].columns
    assert all(left[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    rows = {n: d.collect() for n, d in left.items()}
    ids = {n: Counter(r["doc_id"] for r in x) for n, x in rows.items()}

    # Language: all documents with a letter are in one of the languages learned.
    assert ids["language"] == Counter(r["doc_id"] for r in rows["documents"] if any(c.isalpha() for c in r["text"] or ""))

    # Exact: of equal texts the longest original, then the smallest id.
    best = {}
    for r in rows["language"]:
        best.setdefault(BLANK.sub("", r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    assert ids["exact"] == Counter(i for _, i in map(min, best.values()))

    # Near: of each class, by links of all pairs, the smallest id.
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows["exact"] if WORD.search(r["text"])}
    root = {i: i for i in ids["exact"]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) * 10 >= 8 * len(a | b):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    assert ids["near"] == Counter(i for i in ids["exact"] if root[i] == i)

    # Mix: rows are whole and at most three of each; a source's words miss its target by less than its smallest document left.
    size, source = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows["near"]}, {r["doc_id"]: r["source"] for r in rows["near"]}
    assert set(ids["mix"]) <= set(ids["near"]) and max(ids["mix"].values()) <= 3
    names = sorted(set(source.values()), key=lambda s: (s is None, s))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, Counter()
    for i, s in source.items():
        total[s] += size[i]
    want, free, rest = {}, set(names), float(sum(total.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        want |= {s: 3.0 * total[s] for s in over} if over else share
        rest -= sum(3.0 * total[s] for s in over)
        free -= over or free
    taken = Counter()
    for i, n in ids["mix"].items():
        taken[source[i]] += n * size[i]
    for s in names:
        assert 0 <= want[s] - taken[s] + 1e-6 and want[s] - taken[s] <= max(n for i, n in size.items() if source[i] == s)
    texts = {r["doc_id"]: r for r in rows["near"]}
    assert all(r == texts[r["doc_id"]] for r in rows["mix"])

    # Pieces: the same rows, and their texts come back.
    back = pieces.decode(left["pieces"], pieces.load()).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in rows["mix"])


def test_language_stage_drops_other_languages(spark, sf_dir):
    """Texts in no learned language go; before, the least score was below what any text has, and all of them stayed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "9f8a7b6c5d4e3f2a1b0c 9d8e7f6a5b4c3d2e1f 0a9b8c7d6e5f4a3b2c1d", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=" * 20,
    ]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(other)], "doc_id long, text string")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(rows, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in docs.select("doc_id").collect()}
