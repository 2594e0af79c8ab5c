"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of a text's words, word borders included,
hashed into 2**18 slots; a text has a feature or has it not.  For every slot

    r = log((a + toxic texts with it) / |toxic|) - log((a + clean texts with it) / |clean|)

The slots whose r stands out most from its own uncertainty are kept, and a
logistic regression is fitted on features scaled by r.  Scoring looks each
text's slots up in one table of 2**18 numbers, without a shuffle.

The model is fitted on at most ``max_rows`` labelled rows (a documented bound:
those with the smallest seeded hash of the id); slot counts are aggregated by
Spark, the fit is Spark ML's.  Scoring covers every whole text, a very long one
in segments.

Defined cases: a null or empty text has no features and gets the score of the
intercept alone; labels that are null or not 0/1 are ignored, as are labels of
absent documents; a label row that repeats an id counts once, toxic if any
says so; with no row of one class every score is the smoothed share of toxic
rows; a null id is scored like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from staywise.llm.common import SMALL_BATCH_BYTES, in_batches, rows_of, texts_of
from staywise.session import stage

SLOT_BITS = 18
SIZES = (3, 4, 5, 6)
FEATURES = 20_000
MAX_ROWS = 20_000
LEAST_TEXTS = 3
SMOOTHING = 1.0
PENALTY = 0.001
SEED = 42
#: Characters of a text whose n-grams are worked out at a time.
SEGMENT = 1 << 16
#: Rows that the filter hands back at a time.
FILTERED_ROWS = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("slots", pa.list_(pa.int32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Weight of every slot (fitted coefficient times log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float


def slots_of(text: str) -> np.ndarray:
    """Distinct slots of the n-grams of a text's words, in ascending order."""
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    _mark(text, seen)
    return np.flatnonzero(seen)


def _mark(text: str, seen: np.ndarray) -> None:
    """Set the slots of a text.  An n-gram may have a blank at either end but none inside."""
    folded = " " + " ".join(text.lower().split()) + " "
    # A long text is read in segments, each with the beginning of the next, so that no n-gram is cut.
    for at in range(0, len(folded), SEGMENT):
        _mark_segment(folded[at : at + SEGMENT + max(SIZES) - 1], seen)


def _mark_segment(folded: str, seen: np.ndarray) -> None:
    chars = np.frombuffer(folded.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    blank = chars == 32
    grams = np.zeros(len(chars), dtype=np.uint64)
    inner = np.zeros(len(chars), dtype=bool)
    for n in range(1, max(SIZES) + 1):
        length = len(chars) - n + 1
        if length <= 0:
            break
        if n > 2:
            inner = inner[:length] | blank[n - 2 : n - 2 + length]
        else:
            inner = inner[:length]
        with np.errstate(over="ignore"):
            grams = grams[:length] * _STEP + chars[n - 1 :] + np.uint64(n)
            if n in SIZES:
                mixed = (grams ^ (grams >> np.uint64(29))) * _STEP
                seen[(mixed[~inner] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True


def labelled_rows(labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    """(doc_id, label), one row per id with a label of 0 or 1."""
    return (
        labels.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{label_column}`").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        # As arrays: a list would hold an object for every slot.
        (doc, label, slots_of(text).astype(np.int32))
        for doc, label, text in rows_of(batches, "doc_id", "label", "text")
    )
    return in_batches(_SLOTS, rows, lambda row: 4 * len(row[2]), SMALL_BATCH_BYTES)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_rows: int = MAX_ROWS,
    features: int = FEATURES,
    penalty: float = PENALTY,
) -> Model:
    """Fit on ``labels`` (doc_id, label), at most ``max_rows`` of them."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    # At most max_rows rows of two numbers: small by that parameter.
    chosen = F.broadcast(labels.orderBy(order, "doc_id").limit(max_rows))
    texts = texts_of(docs, id_column, text_column).join(chosen, "doc_id")
    rows = stage(texts.mapInArrow(_slot_rows, "doc_id bigint, label int, slots array<int>"), "toxic-rows")
    sizes = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = (toxic + SMOOTHING) / (toxic + clean + 2 * SMOOTHING)
        return Model(np.zeros(1 << SLOT_BITS), math.log(share / (1 - share)))
    counted = (
        rows.select("label", F.explode("slots").alias("slot"))
        .groupBy("slot")
        .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    )
    p, q = F.col("p") + SMOOTHING, F.col("q") + SMOOTHING
    ratio = F.log(p / (toxic + 2 * SMOOTHING)) - F.log(q / (clean + 2 * SMOOTHING))
    picked = (
        counted.where(F.col("p") + F.col("q") >= LEAST_TEXTS)
        .select("slot", ratio.alias("r"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("weight"))
        .orderBy(F.desc("weight"), "slot")
        .limit(features)
        .collect()  # at most ``features`` rows of the model itself
    )
    ratios = np.zeros(1 << SLOT_BITS)
    for row in picked:
        ratios[row["slot"]] = row["r"]
    slots = np.flatnonzero(ratios)
    if not len(slots):
        return Model(ratios, math.log((toxic + SMOOTHING) / (clean + SMOOTHING)))
    # A text's picked slots as ones, scaled by the ratios: both in the JVM.
    ones = CountVectorizerModel.from_vocabulary([str(slot) for slot in slots], inputCol="words", outputCol="ones")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratios[slots]), inputCol="ones", outputCol="features")
    training = rows.select(F.col("label").cast("double").alias("label"), F.col("slots").cast("array<string>").alias("words"))
    training = scaled.transform(ones.setBinary(True).setMinTF(1.0).transform(training)).select("label", "features")
    fitted = LogisticRegression(maxIter=60, regParam=penalty, standardization=False).fit(training)
    weights = np.zeros(1 << SLOT_BITS)
    weights[slots] = fitted.coefficients.toArray() * ratios[slots]
    return Model(weights, float(fitted.intercept))


def _scores(texts: Iterable[pa.StringScalar], model: Model) -> Iterator[float]:
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    for text in texts:
        _mark(text.as_py() or "", seen)
        found = np.flatnonzero(seen)
        seen[found] = False
        margin = model.intercept + float(model.weights[found].sum())
        yield 1 / (1 + math.exp(-margin)) if margin >= 0 else math.exp(margin) / (1 + math.exp(margin))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), _scores(batch.column("text"), model)))
        return in_batches(_SCORES, rows)

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, score double")


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row belongs to the part that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def penalty_losses(docs: DataFrame, labels: DataFrame, penalties: Sequence[float], folds: int = 4) -> dict[float, float]:
    """Mean log loss of every penalty over folds of ``labels``, rows of a fold scored by a model fitted on the others."""
    losses = dict.fromkeys(penalties, 0.0)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(folds))
    for k in range(folds):
        held = stage(texts_of(docs).join(labels.where(fold == k), "doc_id"), "toxic-fold")
        for penalty in penalties:
            scored = score(held, fit(docs, labels.where(fold != k), penalty=penalty)).join(labels, "doc_id")
            right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
            losses[penalty] += (scored.agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15))))).first()[0] or 0.0) / folds
    return losses


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents scored below ``threshold``, with all their columns; every row goes by its own text, whatever its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            # Handed back in small parts: the rows waiting in a task are then one batch and little else.
            for at in range(0, len(batch), FILTERED_ROWS):
                clean = [found < threshold for found in _scores(texts.slice(at, FILTERED_ROWS), model)]
                yield batch.slice(at, FILTERED_ROWS).filter(pa.array(clean, pa.bool_()))

    place = docs.columns.index(text_column)
    return docs.mapInArrow(run, docs.schema)
