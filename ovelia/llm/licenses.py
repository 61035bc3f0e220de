"""Licence scans by a positional rare-token index.

The index holds, for each word of a notice's mandatory phrases, the notice and the positions at which the word stands in it.
A file is not compared with notices: of each notice whose mandatory words it has, its rarest words (by inverse document frequency
over all documents) are looked up. Each place of a rare word, less the word's position in the notice, is where the notice would
start; a start stays where a second rare word agrees on it, up to the notice's slack, and there the mandatory phrases are
verified. All of it is DataFrame expressions on one row; nothing is shuffled but the document frequencies of the notices'
own words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

#: Label, notice, mandatory phrases, slack (words by which phrases may stand apart from their places in the
#: notice, since files shorten and fill in notices). The first three are the base phrases, which have no slack.
NOTICES = [
    ("cc-by", "cc by", ["cc by"], 0),
    ("gpl", "general public license", ["general public license"], 0),
    ("reserved", "all rights reserved", ["all rights reserved"], 0),
    ("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["the mit license"], 0),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"], 8),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "version 2 0"], 6),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"], 12),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"], 0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", ["mozilla public license", "2 0"], 6),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that"], 6),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license", ["creative commons attribution share"], 0),
    ("cc0", "this work is marked with cc0 1 0 universal", ["cc0 1 0"], 0),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software", "into the public domain"], 4),
]
BASE = 3
#: A file's rarest words of a notice that are looked up; two of them have to agree on a start.
RARE, AGREE = 3, 2
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case. The one other letter whose lower case is of a-z is put out of the way first."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ"))), _APART), "")


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the vocabulary stands; the number of documents. At most len(vocabulary) + 1 rows reach the driver."""
    found = F.array_union(F.array_intersect(words(F.col(text)), F.lit(vocabulary)), F.array(F.lit("")))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    return df, df.pop("", 0)


def _find(ws: list[str], part: list[str]) -> int:
    return next(i for i in range(len(ws)) if ws[i : i + len(part)] == part)


def build_index(df: dict[str, int], n: int, notices=NOTICES) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """Postings (word, notice, position) of the words of mandatory phrases; for each notice its words, weights and phrases.

    A notice's mandatory words come rarest first; with all of them in a file, the file's rarest are the first ones. The
    pivot, whose places are the starts to agree on, is the rarest word of the first phrase.
    """
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    postings, entries = [], []
    for t, (label, notice, phrases, slack) in enumerate(notices):
        ws = notice.split()
        spans = [(_find(ws, p.split()), p.split()) for p in phrases]
        at = [(w, first + i) for first, part in spans for i, w in enumerate(part)]
        postings += [(w, t, i) for w, i in at]
        own = sorted({w for w, _ in at}, key=lambda w: (-idf(w), w))
        first, part = spans[0]
        pivot = min(range(len(part)), key=lambda i: (-idf(part[i]), part[i]))
        total = sum(idf(w) for w in set(ws))
        weights = [(w, idf(w) / total) for w in sorted(set(ws))]
        entries.append({"label": label, "own": own, "rare": list(dict.fromkeys([part[pivot], *own]))[:RARE], "pivot": (part[pivot], first + pivot), "size": len(ws), "weights": weights, "spans": spans, "slack": slack})
    return postings, entries


def _book(postings: list[tuple[str, int, int]], entries: list[dict], base: int) -> Column:
    """The index as one constant: for each notice what places() reads."""
    one = lambda **x: F.struct(*[F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in x.items()])
    book = []
    for t, e in enumerate(entries):
        rare = [one(w=[x], at=[i for v, u, i in postings if u == t and v == x]) for x in e["rare"]]
        spans = [one(at=i, words=p, slack=e["slack"] if k else 0) for k, (i, p) in enumerate(e["spans"])]
        weights = [one(w=x, x=float(v)) for x, v in e["weights"]]
        pivot, at = e["pivot"]
        book.append(one(label=e["label"], base=t < base, own=e["own"], pivot=pivot, at=at, first=e["spans"][0][0], size=e["size"], slack=e["slack"], need=min(AGREE, len(rare)), rare=F.array(*rare), spans=F.array(*spans), weights=F.array(*weights)))
    return F.array(*book)


def _near(w: Column, at: Column, part: Column, slack: Column) -> Column:
    """Whether part stands in w at position `at`, or up to slack words from it."""
    return F.exists(F.sequence(at - slack, at + slack), lambda p: (p >= 0) & (F.slice(w, F.greatest(p + 1, F.lit(1)), F.size(part)) == part))


def _places(e: Column, w: Column) -> Column:
    """Verified places of one notice e of the book in words w."""
    starts = F.filter(F.transform(w, lambda x, i: F.when(x == e["pivot"], i - e["at"])), lambda s: s.isNotNull())
    # Rare words that have a posting which gives this start, up to the slack; the pivot is one of them.
    agree = lambda s: F.size(F.filter(e["rare"], lambda r: F.exists(r["at"], lambda i: _near(w, s + i, r["w"], e["slack"])))) >= e["need"]
    holds = lambda s: F.forall(e["spans"], lambda p: _near(w, s + p["at"], p["words"], p["slack"]))
    around = lambda s: F.slice(w, F.greatest(s - e["slack"], F.lit(0)) + 1, e["size"] + 2 * e["slack"] + F.least(s - e["slack"], F.lit(0)))
    score = lambda s: bind(around(s), lambda z: F.aggregate(e["weights"], F.lit(0.0), lambda a, x: a + F.when(F.array_contains(z, x["w"]), x["x"]).otherwise(0.0)))
    found = F.filter(F.filter(starts, agree), holds)
    return F.transform(found, lambda s: F.struct(e["label"].alias("label"), e["base"].alias("base"), (s + e["first"]).cast("long").alias("start"), score(s).alias("score")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices=NOTICES, base: int = BASE) -> DataFrame:
    """One row per row of docs: n_words, hits (label, base, start word, score of each verified place), and sums of them.

    A place is one of a notice's first mandatory phrase; start is its first word. score of a place: the notice's different
    words that stand where the notice would, slack included, weighted by inverse document frequency; of a document: its
    best place, 0 without one. A notice of one mandatory word has no second word to agree, and needs none. Null and empty
    texts have no words and no labels. Overlapping places all count. Documents of any length take time in proportion to
    their words. An empty table gives an empty result; docs' other columns are not looked at.
    """
    vocabulary = sorted({w for _, n, _, _ in notices for w in n.split()})
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    postings, entries = build_index(*document_frequencies(src, "text", vocabulary), notices)
    mandatory = F.lit(sorted({p[0] for p in postings}))

    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    book = _book(postings, entries, base)
    # Only notices whose mandatory words all stand in the file are looked at.
    looked = lambda w, have: F.flatten(F.transform(F.filter(book, lambda e: F.forall(e["own"], lambda x: F.array_contains(have, x))), lambda e: _places(e, w)))
    hits = lambda w: bind(F.array_intersect(w, mandatory), lambda have: F.when(F.size(have) > 0, looked(w, have)).otherwise(none))
    both = bind(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits")))
    out = src.select("doc_id", both.alias("_x")).select("doc_id", "_x.*")
    plain = F.filter("hits", lambda h: h["base"])
    joined = lambda hits: F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(plain).cast("long").alias("n_base"),
        F.array_min(F.transform(plain, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(plain, lambda h: h["start"])).alias("last_word"),
        joined(plain).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0))), 6).alias("score"),
        "hits",
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("hits")


def _places_sql(t: int) -> str:
    """Places of one notice: its first mandatory phrase, and the others where the notice has them, up to the slack."""
    label, notice, phrases, slack = NOTICES[t]
    ws = notice.split()
    lists = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    spans = [(_find(ws, p.split()), p.split()) for p in phrases]
    at, first = spans[0]
    holds = [f"w[s + {at + 1}:s + {at + len(first)}] = {lists(first)}"]
    holds += [f"len(list_filter(range(-{slack}, {slack + 1}), lambda j: s + {a} + j >= 0 AND w[s + {a + 1} + j:s + {a + len(x)} + j] = {lists(x)})) > 0" for a, x in spans[1:]]
    score = " + ".join(f"CASE WHEN list_contains(z, '{x}') THEN (SELECT i FROM i WHERE w = '{x}') ELSE 0 END" for x in sorted(set(ws)))
    total = " + ".join(f"(SELECT i FROM i WHERE w = '{x}')" for x in sorted(set(ws)))
    return f"""SELECT doc_id, '{label}' AS label, {t < BASE} AS base, s + {at} AS s, ({score}) / ({total}) AS score FROM (
  SELECT doc_id, s, w[greatest(s - {slack}, 0) + 1:s + {len(ws) + slack}] AS z FROM (
  SELECT doc_id, w, u.p - {at + 1} AS s FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE list_contains(w, '{first[0]}') AND w[u.p] = '{first[0]}') WHERE {' AND '.join(holds)})"""


_VOCABULARY = ", ".join(f"('{w}')" for w in sorted({w for _, n, _, _ in NOTICES for w in n.split()}))
SQL3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS w FROM d) GROUP BY w),
i AS (SELECT v.w AS w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(f.n, 0) + 1)) + 1 AS i FROM (VALUES {_VOCABULARY}) AS v(w) LEFT JOIN f ON f.w = v.w),
h AS ({" UNION ALL ".join(_places_sql(t) for t in range(len(NOTICES)))}),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(score), 6) AS score FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)
"""
