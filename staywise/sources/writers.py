"""Writers of templates, exports and analysis artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def schema_template(df: DataFrame, key: str, target: str, rows: int = 5) -> DataFrame:
    """First rows along the id without the target, as an upload template."""
    return df.orderBy(key).limit(rows).drop(target)


def scored_export(tiered: DataFrame, ids: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Id columns first, then the scores, then the remaining input columns."""
    return tiered.select(
        *ids,
        F.col("prediction").alias("Predicted_Churn"),
        F.col("churn_pct").alias("Churn_Probability_Pct"),
        F.col("risk_tier").alias("Risk_Tier"),
        *[name for name in rest if name not in ids],
    )


def write_analysis(folder: str, sweep: DataFrame, tables: dict[str, DataFrame]) -> None:
    """The sweep as CSV and JSON, every other result table as JSON, one folder each."""
    write_csv(sweep, f"{folder}/threshold_analysis_csv")
    write_json(sweep, f"{folder}/threshold_analysis")
    for name, table in tables.items():
        write_json(table, f"{folder}/{name}")
