"""Exact order statistics that never gather a whole column in one task.

Spark's own ``median`` / ``percentile`` keep every distinct value in one
aggregation buffer, and an unpartitioned window sorts everything in one task.
Here quantiles are selected by counting buckets of leading bits; where every
row needs its rank, values are first reduced to distinct rows, then running
totals are formed per range slice and shifted by the totals of the slices
before.  There is one path, whatever the size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from staywise.functions.sql import array, number, quoted, struct, text
from staywise.session import stage


def running_totals(
    counted: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    slices: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Add ``upto_<sum>`` columns: inclusive running totals along ``order`` per group.

    ``counted`` holds one row per (``by``, ``order``) and is staged unless it
    already is.  Rows are range-partitioned into ``slices`` (as many as the
    session's shuffle partitions), whatever their number: totals run inside a
    slice and are shifted by the totals of the slices before.
    """
    by = list(by)
    counted = counted if staged else stage(counted, "counted")
    direction = F.col(order).desc() if descending else F.col(order).asc()
    slices = slices or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        counted.repartitionByRange(slices, *[F.col(name) for name in by], direction).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "sliced",
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_slice")
        .agg(*[F.sum(name).alias(f"_t_{name}") for name in sums])
        .select(
            *[F.col(name).alias(f"_by_{name}") for name in by],
            F.col("_slice").alias("_at"),
            *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums],
        )
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matches = F.col("_slice") == F.col("_at")
    for name in by:
        matches = matches & (F.col(name) == F.col(f"_by_{name}"))
    return (
        ranged.select("*", *[F.sum(name).over(inside).alias(f"_i_{name}") for name in sums])
        .join(offsets, matches)
        .select(
            *[F.col(name) for name in counted.columns],
            *[(F.col(f"_i_{name}") + F.col(f"_o_{name}")).alias(f"upto_{name}") for name in sums],
        )
    )


def numbered(df: DataFrame, key: str, name: str = "row", slices: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 along a unique key; only the key is shuffled to number it."""
    keys = df.select(F.col(key).alias("_key"), F.lit(1).cast("bigint").alias("one"))
    ranks = running_totals(keys, "_key", ["one"], slices=slices).select("_key", F.col("upto_one").alias(name))
    return df.join(ranks, F.col(key) == F.col("_key")).drop("_key")


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, value) with one row per non-missing measured value."""
    cells = array(
        struct({"feature": text(name), "value": f"CAST({quoted(name)} AS DOUBLE)"}) for name in columns
    )
    return df.select(*by, F.inline(F.expr(cells))).where("value IS NOT NULL AND NOT isnan(value)")


#: Bits of a value's place that each pass of a selection looks at, leading bits first; 64 in all.
WIDTHS = (16, 16, 16, 16)


def place_sql(value: str) -> str:
    """Place of a double in the order of all doubles, as a bigint: its exponent and fraction as one whole number.

    The exponent is found by a logarithm and set right where that is off by
    one; dividing by a power of two is exact.  Both zeros have place 0.
    """
    size = f"abs({value})"
    near = f"greatest(CAST(floor(ln({size}) / ln(2D)) AS INT), -1022)"
    exponent = f"{near} - if(pow(2D, {near}) > {size} AND {near} > -1022, 1, 0) + if(pow(2D, {near} + 1) <= {size}, 1, 0)"
    # Below 2**-1022 a double has no leading one, and the exponent field is 0.
    fraction = f"{size} / pow(2D, {exponent})"
    bits = f"CAST({exponent} + 1022 AS BIGINT) * {1 << 52}L + CAST({fraction} * {float(1 << 52)!r}D AS BIGINT)"
    infinite = f"{2047 << 52}L"
    whole = f"CASE WHEN {size} = 0 THEN 0L WHEN {size} = double('Infinity') THEN {infinite} ELSE {bits} END"
    return f"(CASE WHEN {value} < 0 THEN -({whole}) ELSE {whole} END)"


def measured(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Staged (by…, feature, value, place), for several passes."""
    return stage(long_values(df, columns, by).withColumn("place", F.expr(place_sql("value"))), "measured")


def quantiles_of(
    values: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), widths: Sequence[int] = WIDTHS
) -> DataFrame:
    """Linearly interpolated quantiles of ``measured`` values, found by radix selection.

    One aggregate counts the values by the leading bits of their place; the
    buckets that hold a wanted rank are looked into by the next bits, and so
    on until each holds one value only.  What is shuffled are bucket counts, at
    most 2**width a group and bucket, whatever the number of values; values
    themselves are neither sorted nor joined.
    """
    if sum(widths) != 64:
        raise ValueError("the widths must add up to 64 bits")
    groups = [*by, "feature"]
    shift = 64 - widths[0]
    counts = [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    buckets = values.groupBy(*groups, F.shiftright("place", shift).alias("prefix")).agg(*counts)
    whole = Window.partitionBy(*groups)
    position = F.col("probability") * (F.col("size") - 1)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), rank(position).cast("bigint").alias("rank")) for side, rank in (("below", F.floor), ("above", F.ceil))])
    wanted = (
        buckets.withColumns({"size": F.sum("n").over(whole), "upto": F.sum("n").over(_along(whole, "prefix"))})
        .withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("position", position)
        .select("*", F.inline(sides))
    )
    kept = [*groups, "probability", "position", "side", "rank"]
    state, unsettled = _staged(_holding(wanted, kept))
    for width in widths[1:]:
        if not unsettled:
            break
        open_ranks = state.where("low < high")
        # Buckets still looked into: at most two for each group and probability.
        inside = open_ranks.select(*[F.col(name).alias(f"_{name}") for name in groups], F.col("prefix").alias("_prefix"), F.col("before").alias("_before")).distinct()
        same = F.shiftright("place", shift) == F.col("_prefix")
        for name in groups:
            same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
        shift -= width
        finer = values.join(inside, same).groupBy(*groups, "_prefix", "_before", F.shiftright("place", shift).alias("prefix")).agg(*counts)
        upto = F.sum("n").over(_along(Window.partitionBy(*groups, "_prefix"), "prefix")) + F.col("_before")
        finer = finer.withColumn("upto", upto)
        ranks = open_ranks.select(*[F.col(name).alias(f"_{name}") for name in groups], F.col("prefix").alias("_bucket"), *kept[len(groups):])
        met = F.col("_prefix") == F.col("_bucket")
        for name in groups:
            met = met & F.col(name).eqNullSafe(F.col(f"_{name}"))
        state, unsettled = _staged(state.where("low = high").unionByName(_holding(finer.join(ranks, met), kept)))
    below, above = (F.max(F.when(F.col("side") == side, F.col("low"))) for side in ("below", "above"))
    # Weights of both neighbours, so that equal neighbours give exactly their value.
    weighed = (F.ceil("position") - F.col("position")) * F.col("below") + (F.col("position") - F.floor("position")) * F.col("above")
    return (
        state.groupBy(*groups, "probability", "position")
        .agg(below.alias("below"), above.alias("above"))
        .select(*groups, "probability", F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(weighed).alias("quantile"))
    )


def _along(window: WindowSpec, order: str) -> WindowSpec:
    return window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _staged(state: DataFrame) -> tuple[DataFrame, bool]:
    """The staged state, and whether ranks lie in buckets of several values."""
    staged = stage(state, "selected")
    return staged, not staged.where("low < high").isEmpty()


def _holding(buckets: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Of buckets paired with ranks, those where the bucket holds the rank."""
    before = F.col("upto") - F.col("n")
    held = buckets.where((before <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    return held.select(*kept, "prefix", before.alias("before"), "low", "high")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """(by…, feature, probability, quantile) of the measured columns."""
    return quantiles_of(measured(df, columns, by), probabilities, by, widths)


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians as fitted numbers: one per named column, so the result is small by construction."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {row["feature"]: row["quantile"] for row in rows}
