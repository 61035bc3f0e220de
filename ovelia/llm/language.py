"""Language identification by string kernels.

A text is the set of its byte n-grams, hashed into slots; the kernel of two texts is the number of n-grams of all
lengths that both have, over the geometric mean of their own numbers. Nyström landmarks give each text a short vector,
on which kernel ridge regression fits one language against the rest. As the kernel is a product of presence vectors,
landmarks and coefficients fold into one matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import bounded_sample, held_out
from .nystrom import inverse_root, ridge
from .textarrays import chunks

SLOTS, LONGEST = 1 << 14, 3
LANDMARKS = 256
#: Bound of the rows that the model is fitted on, for each language.
EACH = 500
PENALTY = 1e-4
#: Score, 0.5 where a machine is undecided, below which a text is in none of the languages: no machine takes it for its own.
LEAST = 0.5
#: Texts in a matrix product.
ROWS = 256


def presence(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) booleans: which slots the n-grams of each whole text reach."""
    n = len(off) - 1
    out = np.zeros(n * SLOTS, bool)
    size = np.diff(off)
    base = np.repeat(np.arange(n, dtype=np.int64) * SLOTS, size)
    left = np.repeat(off[1:], size) - np.arange(len(raw))
    code = np.zeros(len(raw), np.uint32)
    for k in range(1, LONGEST + 1):
        if len(raw) < k:
            break
        code = code[: len(raw) - k + 1] * np.uint32(256) + raw[k - 1 :]
        slot = ((code + np.uint32(k << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
        at = base[: len(code)] + slot
        out[at[left[: len(code)] >= k]] = True
    return out.reshape(n, SLOTS)


@dataclass
class Model:
    languages: list[str]
    fold: np.ndarray  # (SLOTS, languages)
    intercept: np.ndarray

    def scores(self, have: np.ndarray) -> np.ndarray:
        x = have.astype(np.float32)
        root = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x @ self.fold / root + self.intercept


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in chunks(batch.column(2), rows=ROWS):
            bits = [x.tobytes() for x in np.packbits(presence(raw, off), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(bits, pa.binary())], ["h", "lang", "bits"])


def fit(labelled: DataFrame, each: int = EACH, landmarks: int = LANDMARKS) -> Model | None:
    """A model of labelled(doc_id, lang, text), from a bounded sample of its rows; None if it has none with a letter."""
    ship(labelled.sparkSession)
    rows = bounded_sample(labelled.where(F.col("text").rlike(r"\p{L}")), "lang", "doc_id", each)
    got = rows.select(F.col("_h").alias("h"), "lang", "text").mapInArrow(_packed, "h long, lang string, bits binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "h", "bits"]).groupby("lang").head(each)
    names = sorted(got["lang"].unique())
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]]), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    rank = got.groupby("lang").cumcount().to_numpy()
    marks = x[np.argsort(rank, kind="stable")[:landmarks]]
    to = inverse_root((marks @ marks.T).astype(np.float64))
    features = (x @ marks.T).astype(np.float64) @ to
    y = np.where(got["lang"].to_numpy()[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = got["lang"].map(1 / got["lang"].value_counts()).to_numpy()
    coef, intercept = ridge(features, y, share, PENALTY)
    return Model(names, (marks.T.astype(np.float64) @ (to @ coef)).astype(np.float32), intercept.astype(np.float32))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    for batch in batches:
        for a, b, raw, off in chunks(batch.column(1), rows=ROWS):
            s = model.scores(presence(raw, off))
            lang, score = names[s.argmax(1)], np.clip((s.max(1) + 1) / 2, 0, 1).astype(np.float64)
            letters = np.array(batch.column(2)[a:b].to_pylist(), bool)
            lang, score = np.where(letters, lang, "und"), np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row of docs. Texts that are null or have no letter are `und` with score 0; so is all without a model."""
    ship(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(lambda it: _predict(it, model), f"doc_id {kind}, lang_pred string, score double")


def learn(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _accept(batches: Iterator[pa.RecordBatch], model: Model, text: int, least: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows, without their last column, that have a letter by it and whose best score is not below least."""
    for batch in batches:
        ok = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
        for a, b, raw, off in chunks(batch.column(text), rows=ROWS):
            ok[a:b] &= (model.scores(presence(raw, off)).max(1) + 1) / 2 >= least
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(ok)).rename_columns(names)


def accepted(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs(doc_id, lang, text, ...) without rows in no language: null texts, texts without a letter, and those that the
    machine of no language scores at least `least`. All columns stay as they are, whatever their names. Where no row with
    a language and a letter is there to learn from, all rows with a letter stay."""
    ship(docs.sparkSession)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    model = learn(docs)
    if model is None:
        return docs.where(letters)
    at, schema = docs.columns.index(text), docs.schema
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return rows.withColumn("letters", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False))).mapInArrow(lambda it: _accept(it, model, at, least, schema.names), schema)
