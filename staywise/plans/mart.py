"""Subscriber mart derived from the customer, orders, lineitem and part tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.roles import ColumnRoles, ContractSpec, RuleBook
from staywise.session import stage

CUTOFF = "2000-08-01"
ADDON_WINDOW_START = "2000-02-01"
ADDON_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ADDONS = tuple(f"addon_{kind.lower()}" for kind in ADDON_TYPES)
NO_PAYMENT = "none"

# Stored statistic of the one imputable numeric, kept with the contract.
LIFETIME_MEDIAN = 2060092.33

MART_ROLES = ColumnRoles(
    id="customerID",
    target="Churn",
    categoricals=("Region", "Segment", "Contract", "PaymentMethod") + ADDONS,
    numerics=("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"),
    senior="SeniorCitizen",
    tenure="tenure",
    revenue="MonthlyCharges",
    lifetime="TotalCharges",
    contract="Contract",
    service="Segment",
    payment="PaymentMethod",
    support="addon_promo",
    security="addon_economy",
    addons=ADDONS,
)

MART_DOMAINS = {
    "Region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    "Segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaymentMethod": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", NO_PAYMENT),
    **{addon: ("No", "Yes") for addon in ADDONS},
}

MART_CONTRACT = ContractSpec(
    required=MART_ROLES.features,
    flags=("SeniorCitizen",),
    numerics=("tenure", "MonthlyCharges", "TotalCharges"),
    domains=MART_DOMAINS,
    imputed={"TotalCharges": LIFETIME_MEDIAN},
)

# The narrower flag spellings of the earlier, separate contract.
NARROW_ALIASES = {"yes": 1, "1": 1, "true": 1, "no": 0, "0": 0}

NARROW_CONTRACT = replace(MART_CONTRACT, aliases=NARROW_ALIASES)

MART_RULES = RuleBook(
    flexible_contract="Month-to-month",
    risky_service="MACHINERY",
    friction_payment="1-URGENT",
    automatic_payment="5-LOW",
    high_bill=40000.0,
    early_tenure=45,
    bill_floor=5000.0,
    monthly_credit=2500.0,
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def purchase_flags(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per customer: ``bought`` has a bit set per part type bought inside the window.

    The date filter keeps about a twelfth of the orders, so it is joined first
    and only the matching lines meet the part table.  Every stage carries keys and
    one integer; a customer with very many lines is combined map-side, and AQE
    splits the partition of an order or part that holds a large share of the lines.
    """
    window = orders.where(
        (F.col("o_orderdate") >= F.lit(ADDON_WINDOW_START).cast("date"))
        & (F.col("o_orderdate") < F.lit(CUTOFF).cast("date"))
    ).select("o_orderkey", "o_custkey")
    kind = F.lit(0)
    for i, name in enumerate(ADDON_TYPES):
        kind = F.when(F.col("p_type") == name, 1 << i).otherwise(kind)
    return (
        window.join(lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part.select("p_partkey", kind.alias("kind")), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey")
        .agg(F.bit_or("kind").alias("bought"))
    )


# The levels of an order's priority; any other is unknown, which the contract refuses.
PRIORITIES = MART_DOMAINS["PaymentMethod"][:5]
UNKNOWN_PRIORITY = "unknown"
#: Bits of the latest order's key beside its day (17 bits) and its priority's number (3).
KEY_BITS = 43


def order_history(orders: DataFrame) -> DataFrame:
    """One row per customer: spend, count, first date and latest priority before the cutoff.

    The latest order is found as one number made of day, key and priority: all
    buffers have a fixed width, so this is a hash aggregate without a sort.
    """
    cutoff = F.lit(CUTOFF).cast("date")
    before = F.col("o_orderdate") < cutoff
    level = F.lit(0)
    for number, name in enumerate(PRIORITIES, 1):
        level = F.when(F.col("o_orderpriority") == name, number).otherwise(level)
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    key = F.col("o_orderkey").cast("bigint")
    # A key that doesn't fit would run into the day and pick a wrong order, so the job fails instead.
    fits = F.when(key.between(0, (1 << KEY_BITS) - 1), key).when(
        key.isNotNull(), F.raise_error(F.concat(F.lit(f"order key beyond {KEY_BITS} bits: "), key.cast("string"))).cast("bigint")
    )
    packed = F.shiftleft(day, KEY_BITS + 3) + F.shiftleft(fits, 3) + level
    latest = F.pmod(F.max(F.when(before, packed)), F.lit(8))
    named = F.when(latest.isNotNull(), F.coalesce(F.get(F.array(*[F.lit(p) for p in PRIORITIES]), latest.cast("int") - 1), F.lit(UNKNOWN_PRIORITY)))
    return orders.groupBy("o_custkey").agg(
        F.sum(F.when(before, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("spend"),
        F.count_if(before).alias("n_before"),
        F.count_if(~before).alias("n_after"),
        F.min(F.when(before, F.col("o_orderdate").cast("date"))).alias("first_date"),
        named.alias("last_priority"),
    )


def subscriber_mart(spark: SparkSession, folder: str) -> DataFrame:
    """Declare the mart; joins whose columns a query never reads are pruned by Catalyst."""
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    orders = read_table(spark, folder, "orders")
    history = order_history(orders).withColumnRenamed("o_custkey", "h_custkey")
    flags = purchase_flags(
        read_table(spark, folder, "lineitem"), read_table(spark, folder, "part"), orders
    ).withColumnRenamed("o_custkey", "f_custkey")

    joined = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(history, F.col("c_custkey") == F.col("h_custkey"), "left")
        .join(flags, F.col("c_custkey") == F.col("f_custkey"), "left")
    )
    n_before = F.coalesce("n_before", F.lit(0))
    tenure = F.coalesce(
        F.floor(F.date_diff(F.lit(CUTOFF).cast("date"), F.col("first_date")) / 30), F.lit(0)
    ).cast("int")
    return joined.select(
        F.col("c_custkey").alias("customerID"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("SeniorCitizen"),
        F.col("r_name").alias("Region"),
        F.col("c_mktsegment").alias("Segment"),
        tenure.alias("tenure"),
        F.when(n_before <= 6, "Month-to-month")
        .when(n_before <= 10, "One year")
        .otherwise("Two year")
        .alias("Contract"),
        F.coalesce("last_priority", F.lit(NO_PAYMENT)).alias("PaymentMethod"),
        *[
            F.when(F.col("bought").bitwiseAND(1 << i) > 0, "Yes").otherwise("No").alias(name)
            for i, name in enumerate(ADDONS)
        ],
        (F.col("spend") / F.greatest(F.lit(1), tenure)).alias("MonthlyCharges"),
        F.col("spend").alias("TotalCharges"),
        F.when(F.coalesce("n_after", F.lit(0)) == 0, "Yes").otherwise("No").alias("Churn"),
    )


_staged: dict[tuple[str, str], DataFrame] = {}


def load_mart(spark: SparkSession, folder: str) -> DataFrame:
    """The mart as a table, built once per application and folder, and scanned by every report.

    Call :func:`subscriber_mart` to read tables that have changed since.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _staged:
        _staged[key] = stage(subscriber_mart(spark, folder), "subscribers")
    return _staged[key]
