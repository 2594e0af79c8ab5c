"""From raw documents to training tokens: five stages, each over all that the one before kept.

Defined cases: a null text is an empty one and goes through every stage; rows
with a null id, or sharing an id, are told apart by their text, and one of those
equal in both is kept; columns beyond those of ``documents`` are carried along,
whatever their names; a null source, or one without a weight, keeps its share;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm import exact_dedup, queries, simhash_dedup, toxicity
from staywise.llm.common import load
from staywise.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Spark's bound on what it sends to a Python worker at a time, and the bytes that the stages set it to.
BATCH_SETTING, STAGE_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20

#: The toxicity stage's model is not SQL.
ORACLE_SQL: str | None = None


def small_batches(spark: SparkSession) -> None:
    """Whole documents are long: by rows alone, the batches under way in a task would take much of its memory."""
    spark.conf.set(BATCH_SETTING, str(STAGE_BATCH_BYTES))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't reject; it learns from the labelled rows outside the held-out fifth."""
    small_batches(spark)
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.mixed(docs).select(*[F.col(f"`{name}`") for name in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = load(spark, sf_dir)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
