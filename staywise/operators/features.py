"""Feature preparation: fitted statistics, one-hot expressions, feature dictionary, splits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.expressions import shuffled
from staywise.functions.sql import array, literal, number, quoted, struct, text
from staywise.operators.ordering import fit_medians
from staywise.operators.portfolio import long_levels
from staywise.session import stage


@dataclass(frozen=True)
class Feature:
    """One model input: a scaled number, or a 0/1 indicator of a category level."""

    name: str
    raw: str
    level: str | None
    label: str


@dataclass(frozen=True)
class FittedPreparation:
    """Statistics learned on training rows; a plain record, small by construction."""

    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    deviations: dict[str, float]
    levels: dict[str, tuple[str, ...]]


def feature_list(numerics: Sequence[str], levels: Mapping[str, Sequence[str]], drop_first: bool) -> list[Feature]:
    """Numerics first, then the levels of each category in ascending order."""
    found = [Feature(f"num__{name}", name, None, name) for name in numerics]
    for name, domain in levels.items():
        kept = sorted(domain)[1:] if drop_first else sorted(domain)
        found += [Feature(f"cat__{name}_{level}", name, level, f"{name} = {level}") for level in kept]
    return found


def feature_sql(
    feature: Feature,
    means: Mapping[str, float],
    deviations: Mapping[str, float],
    get: Callable[[str], str] = quoted,
) -> str:
    """The feature's value as expression text; ``get`` says where a raw column comes from."""
    raw = get(feature.raw)
    if feature.level is None:
        return f"((CAST({raw} AS DOUBLE) - {number(means[feature.raw])}) / {number(deviations[feature.raw] or 1.0)})"
    return f"if({raw} = {text(feature.level)}, 1D, 0D)"


def feature_column(feature: Feature, means: Mapping[str, float], deviations: Mapping[str, float]) -> Column:
    return F.expr(feature_sql(feature, means, deviations))


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, population std) of each column in one pass."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
            )
            for c in columns
        ]
    )
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mode); of equally frequent levels the smaller one wins."""
    counts = (
        long_levels(df, columns).where(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count("*").alias("n"))
    )
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("level").alias("level")))
    return counts.groupBy("feature").agg(first["level"].alias("mode"))


#: Levels that a learned dictionary may have per category; it becomes part of the model.
MOST_LEVELS = 1000


def learned_levels(train: DataFrame, columns: Sequence[str], most: int = MOST_LEVELS) -> dict[str, tuple[str, ...]]:
    """The levels each category shows in the training rows, ascending; null is no level.

    A level met later that isn't among them has none of the category's
    indicators.  A category with more than ``most`` levels is refused.
    """
    seen = long_levels(train, columns).where(F.col("level").isNotNull()).select("feature", "level").distinct()
    crowded = seen.groupBy("feature").count().where(F.col("count") > most).first()
    if crowded:
        raise ValueError(f"{crowded['feature']} has {crowded['count']} levels, more than {most}")
    found: dict[str, list[str]] = {name: [] for name in columns}
    for row in seen.collect():  # at most ``most`` levels per category
        found[row["feature"]].append(row["level"])
    return {name: tuple(sorted(levels)) for name, levels in found.items()}


def fit_preparation(train: DataFrame, numerics: Sequence[str], levels: Mapping[str, Sequence[str]]) -> FittedPreparation:
    """Learn imputers and the scaler on training rows only."""
    medians = fit_medians(train, numerics)
    modes = {row["feature"]: row["mode"] for row in most_frequent(train, list(levels)).collect()}
    filled = impute(train, medians, modes)
    spread = {row["feature"]: row for row in numeric_statistics(filled, numerics).collect()}
    return FittedPreparation(
        medians=medians,
        modes=modes,
        means={name: spread[name]["mean"] for name in numerics},
        deviations={name: spread[name]["std"] for name in numerics},
        levels={name: tuple(sorted(domain)) for name, domain in levels.items()},
    )


def impute(df: DataFrame, medians: Mapping[str, float], modes: Mapping[str, str]) -> DataFrame:
    filled = {name: F.coalesce(F.col(name).cast("double"), F.lit(float(value))) for name, value in medians.items()}
    filled |= {name: F.coalesce(F.col(name), F.lit(value)) for name, value in modes.items()}
    return df.withColumns(filled)


def encode(
    df: DataFrame,
    features: Sequence[Feature],
    means: Mapping[str, float],
    deviations: Mapping[str, float],
    carry: Sequence[str],
) -> DataFrame:
    """Wide numeric matrix: carried columns plus one double per feature."""
    return df.select(*carry, *[feature_column(f, means, deviations).alias(f.name) for f in features])


def feature_totals(encoded: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """(feature, raw_feature, level, label, rows, total) of an encoded matrix."""
    cells = array(
        struct(
            {
                "feature": text(f.name),
                "raw_feature": text(f.raw),
                "level": f"CAST({literal(f.level)} AS STRING)",
                "label": text(f.label),
                "rows": f"count({quoted(f.name)})",
                "total": f"sum({quoted(f.name)})",
            }
        )
        for f in features
    )
    return encoded.agg(F.expr(cells).alias("cells")).select(F.inline("cells"))


#: Hex digits of the shuffled order that make a slot; a stratum has at most 65,536.
SLOT_DIGITS = 4
#: A stratum becomes a branch of the split, so there must be few.
MOST_STRATA = 256


def cut_points(df: DataFrame, key: str, stratum: str, shares: Sequence[float], seed: int) -> list[dict]:
    """Where each stratum's shuffled order must be cut to hold the given cumulative shares.

    Slots of that order are counted first; only the rows of the slots a cut
    falls into are sorted, so no task ever sorts a whole stratum.
    """
    slotted = df.where(F.col(stratum).isNotNull()).select(
        F.col(stratum).alias("stratum"), F.col(key).alias("key"), shuffled(key, seed).alias("place")
    )
    slotted = slotted.withColumn("slot", F.substring("place", 1, SLOT_DIGITS))
    counts = stage(slotted.groupBy("stratum", "slot").agg(F.count("*").alias("n")), "slots")
    strata = [row["stratum"] for row in counts.select("stratum").distinct().limit(MOST_STRATA + 1).collect()]
    if len(strata) > MOST_STRATA:
        raise ValueError(f"{stratum} has more than {MOST_STRATA} values; a stratified split needs few")
    along = Window.partitionBy("stratum").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy("stratum")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    at_cut = (
        counts.select("*", F.sum("n").over(along).alias("upto"), F.sum("n").over(everything).alias("size"))
        .select("*", wanted.alias("w"))
        .select("stratum", "slot", "n", "upto", "w.cut", F.round(F.col("w.share") * F.col("size")).cast("bigint").alias("rank"))
        .where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        .select("stratum", "slot", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("within"))
    )
    last = (
        slotted.join(stage(at_cut, "cuts"), ["stratum", "slot"])
        .withColumn("position", F.row_number().over(Window.partitionBy("stratum", "slot", "cut").orderBy("place", "key")))
        .where(F.col("position") == F.col("within"))
        .select("stratum", "place", "key", "cut")
    )
    found = [row.asDict() for row in last.collect()]  # one row per stratum and cut
    # A share that rounds to no rows has no last row: the cut lies before everything.
    placed = {(cut["stratum"], cut["cut"]) for cut in found}
    found += [
        {"stratum": name, "cut": cut, "place": "", "key": None}
        for name in strata
        for cut in range(len(shares))
        if (name, cut) not in placed
    ]
    return found


def stratified_part(df: DataFrame, key: str, stratum: str, shares: Sequence[float], seed: int, name: str) -> DataFrame:
    """Number every row by the share interval it falls into: 0 up to the first share, 1 to the second, …

    The cut points are a handful of literals, so the split itself is a narrow
    projection: no shuffle and the same answer for a row in any batch layout.
    """
    cuts = cut_points(df, key, stratum, shares, seed)
    here = F.struct(shuffled(key, seed).alias("place"), F.col(key).alias("key"))
    part = F.lit(0)
    for cut in cuts:
        if cut["key"] is None:
            part = part + F.when(F.col(stratum) == cut["stratum"], 1).otherwise(0)
            continue
        at = F.struct(F.lit(cut["place"]).alias("place"), F.lit(cut["key"]).cast(df.schema[key].dataType).alias("key"))
        part = part + F.when((F.col(stratum) == cut["stratum"]) & (here > at), 1).otherwise(0)
    return df.where(F.col(stratum).isNotNull()).withColumn(name, part)


def stratified_split(df: DataFrame, key: str, stratum: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: round(share · n) rows of every stratum."""
    return stratified_part(df, key, stratum, [test_share], seed, "_part").withColumn(
        "is_test", F.col("_part") == 0
    ).drop("_part")


def stratified_folds(df: DataFrame, key: str, stratum: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0 … folds-1, equally sized within every stratum."""
    shares = [i / folds for i in range(1, folds)]
    return stratified_part(df, key, stratum, shares, seed, "fold")
