"""A raw text feed of the mart, as an upload would bring it: spellings, blanks, wrong levels.

Every subscriber appears once; which fault a record carries follows from its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.plans.mart import MART_ROLES

FLAG_SPELLINGS = {1: ("No", "Yes"), 2: ("false", " TRUE "), 3: ("0.0", "1.0"), 4: ("n", "Y"), 5: ("F", "t")}
MONTHLY_FAULTS = {
    5: "inf", 6: "-Infinity", 7: "1e4", 8: "12,000", 9: "  45000.5 ", 10: "1_000",
    11: "0x1F", 12: "2f", 13: "", 14: None, 15: "NaN", 16: "+38000.", 17: ".5e5",
}
LIFETIME_FAULTS = {3: " ", 4: "abc", 5: "inf"}
CONTRACT_FAULTS = {21: "Three year", 22: "month-to-month", 23: None, 24: "Two years"}
SEGMENT_FAULTS = {31: "FURNITURES", 32: None}
TARGET_FAULTS = {41: "maybe", 42: None}


def _replace(value: Column, faults: dict[int, str | None], period: int) -> Column:
    place = F.col("customerID") % period
    result = value
    for at, text in faults.items():
        result = F.when(place == at, F.lit(text).cast("string")).otherwise(result)
    return result


def raw_feed(mart: DataFrame) -> DataFrame:
    place = F.col("customerID") % 8
    flag = F.col("SeniorCitizen").cast("string")
    for at, (no, yes) in FLAG_SPELLINGS.items():
        flag = F.when(place == at, F.when(F.col("SeniorCitizen") == 1, yes).otherwise(no)).otherwise(flag)
    flag = F.when(place == 7, F.when(F.col("customerID") % 16 == 7, "maybe").otherwise("")).otherwise(flag)
    changed = {
        "SeniorCitizen": flag,
        "tenure": _replace(F.col("tenure").cast("string"), {13: "n/a"}, 50),
        "MonthlyCharges": _replace(F.floor("MonthlyCharges").cast("bigint").cast("string"), MONTHLY_FAULTS, 40),
        "TotalCharges": _replace(F.col("TotalCharges").cast("decimal(18,2)").cast("string"), LIFETIME_FAULTS, 25),
        "Contract": _replace(F.col("Contract"), CONTRACT_FAULTS, 60),
        "Segment": _replace(F.col("Segment"), SEGMENT_FAULTS, 70),
        "Churn": _replace(F.col("Churn"), TARGET_FAULTS, 90),
    }
    names = [*MART_ROLES.features, MART_ROLES.target]
    return mart.select("customerID", *[changed.get(n, F.col(n)).alias(n) for n in names], F.lit("upload").alias("channel"))


def text_feed(mart: DataFrame) -> DataFrame:
    """The mart's clean values as text."""
    return mart.select(
        "customerID",
        *[
            (
                F.floor("MonthlyCharges").cast("bigint").cast("string")
                if name == "MonthlyCharges"
                else F.col(name).cast("decimal(18,2)").cast("string")
                if name == "TotalCharges"
                else F.col(name).cast("string")
            ).alias(name)
            for name in MART_ROLES.features
        ],
    )
