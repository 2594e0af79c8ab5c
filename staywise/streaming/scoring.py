"""Continuous scoring: arriving records are scored, refused ones are kept with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from staywise.functions.sql import quoted
from staywise.operators.contract import ACCEPTED, REFUSED, accepted, clean_columns, rejected, require_columns, violation_array
from staywise.operators.scoring import Scorecard, interventions, with_score, with_tiers
from staywise.roles import ColumnRoles, ContractSpec, RuleBook

COUNTS = "records bigint, accepted bigint, refused bigint"


def response_fields(roles: ColumnRoles, rules: RuleBook) -> list[Column]:
    """Fields of a response, from a record with score and tiers."""
    return [
        F.col("prediction"),
        F.col("churn_pct"),
        F.round(100.0 * (1.0 - F.col("churn_probability")), 2).alias("no_churn_pct"),
        F.col("risk_level"),
        F.transform(interventions(roles, rules), lambda x: x["action"]).alias("actions"),
    ]


def score_records(
    df: DataFrame, roles: ColumnRoles, spec: ContractSpec, rules: RuleBook, card: Scorecard, carry: Sequence[str] = ()
) -> DataFrame:
    """Response fields of the accepted records of a batch."""
    tiered = with_tiers(with_score(accepted(df, spec, [roles.id, *carry]), card))
    return tiered.select(roles.id, *carry, *response_fields(roles, rules))


def quarantined(df: DataFrame, roles: ColumnRoles, spec: ContractSpec) -> DataFrame:
    """Refused records as they arrived, every column, with the reasons."""
    return rejected(df, spec, [roles.id, *[name for name in df.columns if name not in {roles.id, *spec.required}]])


def judged(df: DataFrame, roles: ColumnRoles, spec: ContractSpec, rules: RuleBook, card: Scorecard) -> DataFrame:
    """Every record once: verdict, the response if accepted, the record as it arrived and the reasons if refused.

    A narrow projection, so both outcomes of a batch come from one scan of it.
    """
    require_columns(df.columns, spec)
    cleaned = clean_columns(df.schema, spec)
    rows = df.select(
        roles.id,
        *[cleaned[name].alias(name) for name in spec.required],
        F.struct(*[F.col(quoted(name)) for name in df.columns]).alias("_record"),
        violation_array(df.schema, spec).alias("_violations"),
    )
    refused = F.size("_violations") > 0
    response = F.struct(roles.id, *response_fields(roles, rules))
    return with_tiers(with_score(rows, card)).select(
        F.when(refused, REFUSED).otherwise(ACCEPTED).alias("verdict"),
        F.when(~refused, response).alias("response"),
        F.when(refused, F.col("_record")).alias("record"),
        F.when(refused, F.col("_violations")).alias("violations"),
    )


def _read_judged(spark: SparkSession, folder: str, arrivals: DataFrame, *how) -> DataFrame:
    # The verdict is a folder name, so either reader opens only its own files.
    return spark.read.schema(judged(arrivals, *how).schema).parquet(f"{folder}/judged")


def read_scored(spark: SparkSession, folder: str, arrivals: DataFrame, *how) -> DataFrame:
    """Responses of all batches; ``arrivals`` gives the schema, ``how`` is what the stream was started with."""
    return _read_judged(spark, folder, arrivals, *how).where(F.col("verdict") == ACCEPTED).select("response.*")


def read_quarantine(spark: SparkSession, folder: str, arrivals: DataFrame, *how) -> DataFrame:
    """Refused records of all batches as they arrived, with the reasons."""
    return _read_judged(spark, folder, arrivals, *how).where(F.col("verdict") == REFUSED).select("record.*", "violations")


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, records, accepted, refused): the rows that every batch has written."""
    return spark.read.schema(COUNTS + ", batch bigint").json(f"{folder}/counts")


def start_scoring(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    folder: str,
    roles: ColumnRoles,
    spec: ContractSpec,
    rules: RuleBook,
    card: Scorecard,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Score every file that has arrived under ``source`` and stop.

    Each micro-batch is scanned once and overwrites its own ``batch=<id>``
    folder, with a folder for each verdict below; what was written is counted
    and the counts kept next to it.  A batch repeated after a failure leaves the
    same result; progress lives in the checkpoint beside them.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/judged/batch={number}"
        rows = judged(batch, roles, spec, rules, card)
        rows.write.mode("overwrite").partitionBy("verdict").parquet(path)
        # No column of the written rows is read to count them.
        written = batch.sparkSession.read.schema(rows.schema).parquet(path)
        counts = [F.count("*").alias("records"), *[F.count_if(F.col("verdict") == v).alias(v) for v in (ACCEPTED, REFUSED)]]
        written.agg(*counts).coalesce(1).write.mode("overwrite").json(f"{folder}/counts/batch={number}")

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
