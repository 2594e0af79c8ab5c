"""Model bundles on a shared file system: weights, manifest, hashes, active pointer."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.operators.features import FittedPreparation
from staywise.operators.scoring import Scorecard

WEIGHTS = "feature string, raw_feature string, level string, mean double, deviation double, weight double"
HEADER = "version string, intercept double, threshold double, drop_first boolean"
HASHES = "artifact string, sha256 string"


class BundleError(ValueError):
    """A bundle is missing, incomplete or does not match its manifest."""


def save_bundle(spark: SparkSession, card: Scorecard, path: str) -> None:
    """Write weights and header as JSON, then a manifest with the hash of every file."""
    rows = [
        (
            f.name,
            f.raw,
            f.level,
            None if f.level is not None else float(card.means[f.raw]),
            None if f.level is not None else float(card.deviations[f.raw]),
            float(card.weights[f.name]),
        )
        for f in card.features
    ]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.json(f"{path}/weights")
    header = [(card.version, float(card.intercept), float(card.threshold), card.drop_first)]
    spark.createDataFrame(header, HEADER).coalesce(1).write.json(f"{path}/header")
    write_manifest(spark, path, BUNDLE_PARTS)


BUNDLE_PARTS = ("weights", "header")
TRAINED_PARTS = ("model", "preparation")


def file_hashes(spark: SparkSession, path: str, parts: Sequence[str]) -> DataFrame:
    """(artifact, size, sha256) of every data file below the named folders; one task reads and hashes a file.

    Model files are small; Spark reads a file of at most 2 GB as one value.
    """
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .option("recursiveFileLookup", True)
        .load([f"{path}/{part}" for part in parts])
        .select(
            F.substring_index("path", f"/{base}/", -1).alias("artifact"),
            F.col("length").alias("size"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


def write_manifest(spark: SparkSession, path: str, parts: Sequence[str]) -> None:
    hashes = file_hashes(spark, path, parts)
    hashes.select("artifact", F.upper("sha256").alias("sha256")).coalesce(1).write.json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str, parts: Sequence[str] = BUNDLE_PARTS) -> DataFrame:
    """(artifact, matches): every file that the manifest names or that is there, hashes compared without regard to case.

    A file that only one side knows doesn't match.
    """
    expected = spark.read.schema(HASHES).json(f"{path}/manifest")
    actual = file_hashes(spark, path, parts).select("artifact", F.col("sha256").alias("actual"))
    return expected.join(actual, "artifact", "full_outer").select(
        "artifact", F.coalesce(F.lower("sha256") == F.lower("actual"), F.lit(False)).alias("matches")
    )


def require_intact(spark: SparkSession, path: str, parts: Sequence[str]) -> None:
    broken = [row["artifact"] for row in verify_bundle(spark, path, parts).where(~F.col("matches")).collect()]
    if broken:
        raise BundleError(f"hash mismatch in {', '.join(sorted(broken))}")


def load_bundle(spark: SparkSession, path: str) -> Scorecard:
    """Read a bundle back after checking its hashes; one row per feature, so small by construction."""
    require_intact(spark, path, BUNDLE_PARTS)
    header = spark.read.schema(HEADER).json(f"{path}/header").first()
    rows = spark.read.schema(WEIGHTS).json(f"{path}/weights").collect()
    if header is None or not rows:
        raise BundleError(f"no model in {path}")
    numbers = [row for row in rows if row["level"] is None]
    levels: dict[str, list[str]] = {}
    for row in rows:
        if row["level"] is not None:
            levels.setdefault(row["raw_feature"], []).append(row["level"])
    return Scorecard(
        version=header["version"],
        intercept=header["intercept"],
        numerics=tuple(row["raw_feature"] for row in numbers),
        means={row["raw_feature"]: row["mean"] for row in numbers},
        deviations={row["raw_feature"]: row["deviation"] for row in numbers},
        levels={name: tuple(found) for name, found in levels.items()},
        weights={row["feature"]: row["weight"] for row in rows},
        # Levels read back are exactly those with a weight, so none is left out again.
        drop_first=False,
        threshold=header["threshold"],
    )


PREPARED = "medians string, modes string, means string, deviations string, levels string"


def save_trained(spark: SparkSession, model: Model, fitted: FittedPreparation, path: str) -> None:
    """A fitted classifier of any kind next to the statistics its inputs were prepared with."""
    PipelineModel(stages=[model]).write().save(f"{path}/model")
    row = [tuple(json.dumps(part) for part in asdict(fitted).values())]
    spark.createDataFrame(row, PREPARED).coalesce(1).write.json(f"{path}/preparation")
    write_manifest(spark, path, TRAINED_PARTS)


def load_trained(spark: SparkSession, path: str) -> tuple[Model, FittedPreparation]:
    require_intact(spark, path, TRAINED_PARTS)
    row = spark.read.schema(PREPARED).json(f"{path}/preparation").first()
    if row is None:
        raise BundleError(f"no model in {path}")
    parts = {name: json.loads(row[name]) for name in row.asDict()}
    parts["levels"] = {name: tuple(levels) for name, levels in parts["levels"].items()}
    return PipelineModel.load(f"{path}/model").stages[0], FittedPreparation(**parts)


POINTER = "position bigint, active_version string"


def set_active(spark: SparkSession, folder: str, version: str) -> None:
    """Add a pointer behind all earlier ones: there is no moment without one, and the history stays."""
    try:
        last = spark.read.schema(POINTER).json(f"{folder}/active").agg(F.max("position")).first()[0] or 0
    except AnalysisException:  # the first pointer of this folder
        last = 0
    spark.createDataFrame([(last + 1, version)], POINTER).coalesce(1).write.mode("append").json(f"{folder}/active")


def active_version(spark: SparkSession, folder: str) -> str:
    """The version that the latest pointer names."""
    pointers = spark.read.schema(POINTER).json(f"{folder}/active")
    pointer = pointers.orderBy(F.desc("position"), F.desc("active_version")).first()
    if pointer is None or not pointer["active_version"]:
        raise BundleError(f"no active version in {folder}")
    return pointer["active_version"]


def load_active(spark: SparkSession, folder: str) -> Scorecard:
    """The scorecard bundle the latest pointer names."""
    return load_bundle(spark, f"{folder}/{active_version(spark, folder)}")


def load_active_trained(spark: SparkSession, folder: str) -> tuple[str, Model, FittedPreparation]:
    """The version the latest pointer names, its fitted classifier and what its inputs were prepared with."""
    version = active_version(spark, folder)
    return version, *load_trained(spark, f"{folder}/{version}")
