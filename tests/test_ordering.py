import random
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators.ordering import exact_quantiles, fit_medians, measured, numbered, place_sql, quantiles_of, running_totals

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def skewed(spark, rows=4000):
    """A third of all rows share one value; the others are spread unevenly."""
    number = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.pmod(F.col("id") * 7919, F.lit(1009)), F.lit(2.0)))
    return spark.range(rows).select(
        "id", number.alias("v"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g")
    )


@pytest.mark.parametrize("widths", [(16, 16, 16, 16), (4,) * 16, (12, 20, 32)])
def test_quantiles_match_linear_interpolation(spark, widths):
    df = skewed(spark).withColumn("w", F.when(F.col("id") % 10 == 1, None).otherwise(-F.col("v")))
    local = df.toPandas()
    found = exact_quantiles(df, ["v", "w"], PROBABILITIES, widths=widths).collect()
    assert len(found) == 2 * len(PROBABILITIES)
    for row in found:
        expected = np.quantile(local[row["feature"]].dropna(), row["probability"])
        assert row["quantile"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("widths", [(16, 16, 16, 16), (8,) * 8])
def test_grouped_quantiles(spark, widths):
    df = skewed(spark)
    local = df.toPandas()
    found = exact_quantiles(df, ["v"], (0.3, 0.5), ["g"], widths=widths).collect()
    assert len(found) == 2 * local["g"].nunique()
    for row in found:
        expected = np.quantile(local[local["g"] == row["g"]]["v"], row["probability"])
        assert row["quantile"] == pytest.approx(expected, abs=1e-9)


def test_place_follows_the_order_of_doubles(spark):
    r = random.Random(1)
    some = [struct.unpack("<d", r.randbytes(8))[0] for _ in range(5000)]
    some = [v for v in some if v == v]
    edges = [2.0**k for k in range(-1074, 1024)] + [0.0, -0.0, 5e-324, 2.225e-308, sys.float_info.max, float("inf"), 0.1, 1 / 3]
    values = [s * v for v in some + edges + [np.nextafter(e, 0) for e in edges] + [np.nextafter(e, np.inf) for e in edges[:-3]] for s in (1, -1)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", F.expr(place_sql("v")).alias("p")).collect()
    for row in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["p"] == (-bits if row["v"] < 0 else bits), row["v"]


def test_quantiles_of_close_and_huge_values(spark):
    """Values that agree in all but their last bits, infinities, a null group and groups of one value."""
    close = [1.0 + k * 2.0**-52 for k in range(31)]
    rows = [("a", v) for v in close] + [("b", v) for v in (-1e300, 1e-300, 0.0, -0.0, float("inf"), 7.0)] + [(None, 3.0), (None, 4.0), ("c", 2.5)]
    df = spark.createDataFrame(rows + [("c", float("nan")), ("a", None)], "g string, v double")
    found = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["v"], (0.5, 0.9), ["g"]).collect()}
    assert found[("a", 0.5)] == close[15] and found[("a", 0.9)] == close[27]
    assert found[("b", 0.5)] == 5e-301 and found[("b", 0.9)] == float("inf")
    assert found[(None, 0.5)] == 3.5 and found[("c", 0.9)] == 2.5 and len(found) == 8


def test_quantiles_neither_sort_nor_range_partition(spark, capsys):
    quantiles_of(measured(skewed(spark), ["v"]), (0.5,)).explain()
    assert "rangepartitioning" not in capsys.readouterr().out


def test_medians_of_an_empty_column(spark):
    df = spark.range(3).withColumn("v", F.lit(None).cast("double"))
    assert fit_medians(df, ["v"]) == {}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slices", [1, 60])
def test_running_totals(spark, slices, descending):
    counted = skewed(spark).groupBy("g", "v").agg(F.count("*").alias("n"))
    rows = running_totals(counted, "v", ["n"], ["g"], descending, slices).toPandas()
    ordered = rows.sort_values(["g", "v"], ascending=[True, not descending])
    assert (ordered.groupby("g")["n"].cumsum() == ordered["upto_n"]).all()


@pytest.mark.parametrize("slices", [1, 10])
def test_numbers_are_consecutive(spark, slices):
    df = spark.range(500).select((F.col("id") * 13 % 500 * 10).alias("k"))
    rows = numbered(df, "k", slices=slices).orderBy("k").collect()
    assert [r["row"] for r in rows] == list(range(1, 501))
