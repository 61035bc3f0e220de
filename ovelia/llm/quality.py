"""Quality rules at host level: rule failures summed by domain, shrunk by an empirical beta prior, joined back.

All of it is DataFrame expressions; statistics of a document never leave its row (no explode, no shuffle of words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, cut, small

#: Host rules: name -> failure of one document, over the columns of statistics().
HOST_RULES = {
    "short": lambda: F.col("n_words") < 50,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "lengths": lambda: (F.col("n_words") > 0) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
}


def _repeats(w: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by a 64-bit hash of their words."""
    last = F.greatest(n - 2, F.lit(0))
    windows = F.transform(F.slice(w, F.lit(1), last), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(t):
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(pairs, lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda v: v.isNotNull()))
        spans = bind(F.sort_array(twice), lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3)))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    return bind(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(t)))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep's columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text (null: no words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = bind(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    words = bind(
        F.array_remove(F.split(t, f"[{SPACE}]+"), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w, F.size(w)).alias("n_repeat_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars")),
    )
    symbols = (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")
    return docs.select(*keep, words.alias("_w"), lines.alias("_l"), symbols.alias("n_symbols")).select(*keep, "_w.*", "n_symbols", "_l.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) of each rule by moments over hosts: mean rate, and the spread of rates beyond binomial noise.

    hosts: n and f_<rule> per host. One row reaches the driver. Where hosts differ by no more than noise the prior is
    as strong as a million documents; without documents it is (1, 1).
    """
    out = {}
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")]
    for r in HOST_RULES:
        rate = F.col(f"f_{r}") / F.col("n")
        aggs += [F.sum(f"f_{r}").alias(f"k_{r}"), F.var_pop(rate).alias(f"v_{r}"), F.avg(F.lit(1.0) / F.col("n")).alias(f"i_{r}")]
    row = hosts.where(F.col("n") > 0).agg(*aggs).first()
    for r in HOST_RULES:
        if not row["n"]:
            out[r] = (1.0, 1.0)
            continue
        m = min(max(row[f"k_{r}"] / row["n"], 1e-6), 1 - 1e-6)
        noise = m * (1 - m) * row[f"i_{r}"]
        spread = max((row[f"v_{r}"] or 0.0) - noise, 1e-6 * m * (1 - m))
        strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6)
        out[r] = (m * strength, (1 - m) * strength)
    return out


def host_verdicts(stats: DataFrame, host: str = "source", worst: float = 0.5) -> DataFrame:
    """One row per host: n, posterior failure rate p_<rule> of each rule, host_failed where one exceeds worst."""
    hosts = cut(stats.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(f(), 1).otherwise(0)).alias(f"f_{r}") for r, f in HOST_RULES.items()]))
    failed = F.lit(False)
    cols = []
    for r, (a, b) in beta_priors(hosts).items():
        p = (F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))
        cols.append(p.alias(f"p_{r}"))
        failed = failed | (p > worst)
    return hosts.select("_host", F.col("n").alias("host_docs"), *cols, failed.alias("host_failed"))


def quality(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", worst: float = 0.5) -> DataFrame:
    """Statistics, base_failed and kept of each row of docs.

    kept: not base_failed, and no rule's shrunken failure rate over the document's host exceeds worst. A null host is a
    host of its own. Null, empty and blank texts have no words and fail. Repeated rows count each. An empty table gives
    an empty result; further columns are ignored.
    """
    stats = cut(statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))))
    hosts = small(host_verdicts(stats, "source", worst))
    out = stats.join(hosts, stats["source"].eqNullSafe(hosts["_host"]), "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op10(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, u.i AS i, w[u.i] AS a, w[u.i + 1] AS b, w[u.i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l.l)::BIGINT AS n_lines,
  (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50)::INT AS f1, (100 * n_repeat_words > 50 * n_words)::INT AS f2, (10 * n_symbols > n_words)::INT AS f3,
  (10 * n_dup_lines > 3 * n_lines)::INT AS f4, (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT AS f5 FROM s),
k AS (SELECT source, unnest([1, 2, 3, 4, 5]) AS r, count(*) AS n, unnest([sum(f1), sum(f2), sum(f3), sum(f4), sum(f5)]) AS k FROM f GROUP BY source),
m AS (SELECT r, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v, avg(1.0 / n) AS i FROM k GROUP BY r),
p AS (SELECT r, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * i, 1e-6 * m * (1 - m)) - 1, 1.0), 1e6) AS z FROM m),
h AS (SELECT source, bool_or((k + m * z) / (n + z) > 0.5) AS bad FROM k JOIN p USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 + f2 > 0) AS base_failed, (f1 + f2 = 0 AND NOT bad) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""
