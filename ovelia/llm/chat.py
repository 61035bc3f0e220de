"""Chat formatting of reply trees.

Messages with parents are trees. Pointer doubling, by iterative self-joins, gives each leaf its path to the root in
log2(depth) joins; branches are ranked by score; each chosen path is formatted as one conversation, with control
strings in texts escaped reversibly, and with the spans of the text that a loss counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut

#: Strings that mark turns in this template and in others' templates. The first is the escape itself.
CONTROL = ["\\", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
_CODES = {c: f"\\{i}" for i, c in enumerate(CONTROL)}
_TEXTS = {v: k for k, v in _CODES.items()}
_ESCAPE = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(\d)")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _TEXTS[m[0]], text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans (code points) of texts of the role that a loss counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn|>{escape(role)}<|text|>", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|end|>"]
        at += len(head) + len(body) + len("<|end|>")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def once(messages: DataFrame) -> DataFrame:
    """messages(tree, node, parent, score, role, text) with one row for each tree and node: of several the least by
    parent, score, role and text, nulls first. It is chosen as a whole, whatever the partitions."""
    row = F.struct("parent", "score", "role", "text")
    return messages.groupBy("tree", "node").agg(F.min(row).alias("_m")).select("tree", "node", "_m.*")


def paths(messages: DataFrame) -> DataFrame:
    """messages(tree, node, parent, score) -> (tree, leaf, node, steps): all nodes from each leaf (steps 0) up to its root.

    A null parent, or one that the tree has not, makes a root. After k rounds a leaf has its nearest 2**k ancestors and
    `up` points 2**k levels up, so rounds grow with the logarithm of the depth. Nodes on a cycle have no leaf of their
    own and are left out; a tree below a cycle is cut where the cycle would close. Nodes must stand once in a tree (see once()).
    """
    m = messages.select("tree", "node", "parent")
    have = m.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    up = m.join(have, m["tree"].eqNullSafe(have["t2"]) & (F.col("parent") == F.col("n2")) & (F.col("node") != F.col("n2"))).select("tree", "node", F.col("n2").alias("up"))
    up = cut(up)
    # No path is longer than its tree, so a cycle ends when the steps reach the largest one.
    nodes = m.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    inner = up.select(F.col("tree").alias("t3"), F.col("up").alias("n3")).distinct()
    at = m.join(inner, m["tree"].eqNullSafe(inner["t3"]) & (F.col("node") == F.col("n3")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps"))
    at, span = cut(at), 1
    while span <= nodes:
        jump = up.select(F.col("tree").alias("t4"), F.col("node").alias("n4"), "up")
        more = cut(at.join(jump, at["tree"].eqNullSafe(jump["t4"]) & (F.col("node") == F.col("n4"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + span).alias("steps")))
        if more.isEmpty():
            break
        at = at.unionByName(more)
        twice = up.select(F.col("tree").alias("t5"), F.col("node").alias("n5"), F.col("up").alias("up2"))
        up = cut(up.join(twice, up["tree"].eqNullSafe(twice["t5"]) & (F.col("up") == F.col("n5"))).select("tree", "node", F.col("up2").alias("up")))
        span *= 2
    return at.dropDuplicates(["tree", "leaf", "node"])


def choose(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The paths of each tree, ranked: the mean score of a path's messages, then the leaf. best=None keeps all of them."""
    scored = messages.select(F.col("tree").alias("t6"), F.col("node").alias("n6"), F.coalesce("score", F.lit(0.0)).alias("score"))
    at = paths(messages)
    at = cut(at.join(scored, at["tree"].eqNullSafe(scored["t6"]) & (F.col("node") == F.col("n6"))).select("tree", "leaf", "node", "steps", "score"))
    ranked = at.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score")).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = ranked.select(F.col("tree").alias("t7"), F.col("leaf").alias("l7"), "rank", "path_score")
    return at.join(ranked, at["tree"].eqNullSafe(ranked["t7"]) & (F.col("leaf") == F.col("l7"))).select("tree", "leaf", "node", "steps", "rank", "path_score")


def _formatted(batches: Iterator[pd.DataFrame], learn: str) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = [format_turns([(t["role"] or "", t["text"] or "") for t in turns], learn) for turns in df["turns"]]
        df = df[["tree", "leaf", "rank"]].copy()
        df["formatted"] = [o[0] for o in out]
        df["spans"] = [[{"start": a, "stop": b} for a, b in o[1]] for o in out]
        yield df


def format_trees(messages: DataFrame, best: int | None = 1, learn: str = "assistant") -> DataFrame:
    """messages(tree, node, parent, score, role, text) -> tree, leaf, rank, formatted, spans: each chosen path as one conversation.

    A null role or text is empty. Of rows that repeat tree and node one counts (see once()). Trees may be null. An empty
    table gives an empty result; other columns are not looked at. A conversation is one row, so its turns meet in one task; a tree's other branches do not.
    """
    ship(messages.sparkSession)
    messages = cut(once(messages))
    at = choose(messages, best)
    body = messages.select(F.col("tree").alias("t8"), F.col("node").alias("n8"), "role", "text")
    at = at.join(body, at["tree"].eqNullSafe(body["t8"]) & (F.col("node") == F.col("n8")))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text")))
    one = at.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))
    kind = dict(messages.dtypes)
    return one.mapInPandas(lambda it: _formatted(it, learn), f"tree {kind['tree']}, leaf {kind['node']}, rank int, formatted string, spans array<struct<start:long,stop:long>>")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for df in batches:
        turns = [parse(f) for f in df["formatted"]]
        loss = [unescape("".join(f[s["start"] : s["stop"]] for s in spans)) for f, spans in zip(df["formatted"], df["spans"], strict=True)]
        yield pd.DataFrame(
            {
                "tree": df["tree"],
                "n_turns": [len(t) for t in turns],
                "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns],
                "loss_chars": [len(x) for x in loss],
                "loss_sha256": [sha(x) for x in loss],
                "formatted_chars": [len(f) for f in df["formatted"]],
            }
        )


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations(conv_id, turn, role, text) as reply trees in which each turn answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    n = F.row_number().over(w).cast("long")
    m = conversations.select("conv_id", "turn", "role", "text").withColumn("node", n)
    return m.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def op8(spark, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_trees(as_messages(talks))
    return out.mapInPandas(_digest, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("tree", "conv_id")


# The loss and turn digests do not depend on the template; formatted_chars does, by its marks and escapes.
SQL8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + length('<|turn|><|text|><|end|>')
  + sum_escapes(role) + sum_escapes(text) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _escapes(c: str) -> str:
    """SQL for the code points that escaping adds to a column: two per control string, less its own length."""
    inner = "".join(f"|{re.escape(x)}" for x in sorted(CONTROL, key=len, reverse=True))[1:].replace("'", "''")
    found = f"regexp_extract_all({c}, '{inner}')"
    return f"(2 * len({found}) - length(array_to_string({found}, '')))"


for _c in ("role", "text"):
    SQL8 = SQL8.replace(f"sum_escapes({_c})", _escapes(_c))
