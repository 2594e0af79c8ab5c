"""Profiles: shape, missing values, descriptive statistics, correlation, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import is_missing, shuffled
from staywise.functions.sql import array, number, quoted, struct, text
from staywise.operators.ordering import measured, quantiles_of
from staywise.operators.portfolio import long_levels
from staywise.roles import ColumnRoles
from staywise.session import stage

DIGITS = 6
QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows and missing values, from one scan."""
    cells = F.array(
        *[
            F.struct(
                F.lit(field.name).alias("feature"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.count("*").alias("rows"),
                F.count_if(is_missing(field.name, field.dataType)).alias("missing"),
            )
            for field in df.schema.fields
        ]
    )
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


def describe_numeric(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (and group)."""
    keys = [*by, "feature"]
    values = measured(df, columns, by)
    moments = (
        values.groupBy(*keys)
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg("value"), DIGITS).alias("mean"),
            F.round(F.stddev_samp("value"), DIGITS).alias("std"),
            F.round(F.min("value"), DIGITS).alias("min"),
            F.round(F.max("value"), DIGITS).alias("max"),
        )
    )
    quartiles = (
        quantiles_of(values, QUARTILES, by)
        .groupBy(*keys)
        .agg(
            *[
                F.round(F.max(F.when(F.col("probability") == p, F.col("quantile"))), DIGITS).alias(f"p{int(100 * p)}")
                for p in QUARTILES
            ]
        )
    )
    return moments.join(quartiles, keys).select(
        *keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def box_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Five-number summary with 1.5 IQR fences and the number of values outside them."""
    keys = [*by, "feature"]
    values = measured(df, columns, by)
    quartiles = (
        quantiles_of(values, QUARTILES, by)
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(f"q{i}")
                for i, p in enumerate(QUARTILES, start=1)
            ]
        )
        .withColumn("low_fence", F.col("q1") - WHISKER * (F.col("q3") - F.col("q1")))
        .withColumn("high_fence", F.col("q3") + WHISKER * (F.col("q3") - F.col("q1")))
    )
    outside = (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    shape = ["q1", "q2", "q3", "low_fence", "high_fence"]
    return (
        values.join(stage(quartiles, "quartiles"), keys)
        .groupBy(*keys, *shape)
        .agg(
            F.count("*").alias("n"),
            F.round(F.min("value"), DIGITS).alias("min"),
            F.round(F.max("value"), DIGITS).alias("max"),
            F.count_if(outside).alias("outliers"),
        )
        .select(
            *keys,
            "n",
            "min",
            F.round("q1", DIGITS).alias("p25"),
            F.round("q2", DIGITS).alias("median"),
            F.round("q3", DIGITS).alias("p75"),
            "max",
            F.round("low_fence", DIGITS).alias("low_fence"),
            F.round("high_fence", DIGITS).alias("high_fence"),
            "outliers",
        )
    )


def describe_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, most frequent level and its frequency; ties go to the smaller level."""
    levels = (
        long_levels(df, columns).where(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count("*").alias("n"))
    )
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("level").alias("level")))
    return levels.groupBy("feature").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        first["level"].alias("top"),
        (-first["rank"]).alias("freq"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; the exact form reduces (column, value) pairs first."""
    if approximate:
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.approx_count_distinct(c).alias("distinct_values"))
                for c in columns
            ]
        )
        return df.agg(cells.alias("cells")).select(F.inline("cells"))
    return (
        long_levels(df, columns)
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count("*").alias("_n"))
        .groupBy("feature")
        .agg(F.count("*").alias("distinct_values"))
    )


#: Registers of a distinct-count sketch, as a power of two, and its relative error at one deviation.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, sketch): a bounded sketch of the distinct non-null values of every column, per part.

    One pass and one small row per part; values of any type are counted by their text.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(SKETCH_BITS)).alias("sketch"))
            for c in columns
        ]
    )
    return df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.inline("cells"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of any number of parts as one per feature; a value that several parts hold counts once."""
    return sketches.groupBy(*by, "feature").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, estimate) of stored sketches."""
    return merged_sketches(sketches, by).select(*by, "feature", F.hll_sketch_estimate("sketch").alias("estimate"))


def domain_discovery(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every level seen per category with its count, one row per level."""
    return (
        long_levels(df, columns)
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count("*").alias("n"))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], roles: ColumnRoles, digits: int = 3) -> DataFrame:
    """Pearson r of all pairs (numerics and the 0/1 target) as (x, y, r); NULL when a side is constant.

    Values are centred on the column means first so large magnitudes do not
    cancel, and a pair only counts rows where both sides are present.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = {c: f"(CAST({quoted(c)} AS DOUBLE) - {number(means[c] or 0.0)})" for c in columns}
    centred["churn"] = f"if({quoted(roles.target)} <=> {text(roles.positive)}, 1D, 0D)"
    names = list(centred)

    def pair(x: str, y: str) -> str:
        a, b = centred[x], centred[y]
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        return struct(
            {
                "x": text(x),
                "y": text(y),
                "n": f"CAST(count_if({both}) AS DOUBLE)",
                "a": f"sum(CASE WHEN {both} THEN {a} END)",
                "b": f"sum(CASE WHEN {both} THEN {b} END)",
                "aa": f"sum(CASE WHEN {both} THEN {a} * {a} END)",
                "bb": f"sum(CASE WHEN {both} THEN {b} * {b} END)",
                "ab": f"sum({a} * {b})",
            }
        )

    pairs = F.expr(array(pair(x, y) for i, x in enumerate(names) for y in names[i:]))
    moments = df.agg(pairs.alias("pairs")).select(F.inline("pairs"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    spread = F.sqrt((n * F.col("aa") - a * a) * (n * F.col("bb") - b * b))
    r = F.round(F.try_divide(n * F.col("ab") - a * b, spread), digits)
    upper = moments.select("x", "y", r.alias("r"))
    mirrored = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    )
    return upper.select(F.explode(mirrored).alias("xy"), "r").select("xy.x", "xy.y", "r")


def ordered_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The first ``rows`` subscribers of a shuffled order, a repeatable draw independent of any split."""
    return df.orderBy(shuffled(key, seed, ":sample"), key).limit(rows)
