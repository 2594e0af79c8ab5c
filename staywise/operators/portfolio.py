"""Portfolio aggregates: revenue at risk, churn by segment, rollups, quadrants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import is_positive, percent
from staywise.functions.sql import array, quoted, struct, text
from staywise.operators.ordering import fit_medians
from staywise.roles import ColumnRoles, RuleBook

MONEY = 2
RATE = 2

# Share of flexible contracts assumed convertible, months per year.
CONVERSION_SHARE = 0.15
MONTHS = 12


def money(column: Column) -> Column:
    return F.round(F.coalesce(column, F.lit(0.0)), MONEY)


def portfolio_kpis(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    churned = is_positive(roles.target, roles.positive)
    retained = is_positive(roles.target, roles.negative)
    totals = df.agg(
        F.count("*").alias("accounts"),
        F.coalesce(F.sum(churned), F.lit(0)).alias("churned"),
        F.coalesce(F.sum(retained), F.lit(0)).alias("retained"),
        F.sum(roles.revenue).alias("mrr"),
        F.sum(F.when(churned == 1, F.col(roles.revenue))).alias("risk"),
        F.avg(roles.revenue).alias("avg_mrr"),
        F.avg(roles.tenure).alias("avg_tenure"),
        F.avg(roles.lifetime).alias("avg_lifetime"),
    )
    return totals.select(
        "accounts",
        "churned",
        "retained",
        percent(F.col("churned"), F.col("accounts")).alias("churn_rate_pct"),
        money(F.col("mrr")).alias("total_mrr"),
        money(F.col("avg_mrr")).alias("mean_mrr"),
        money(F.col("risk")).alias("at_risk_mrr"),
        percent(F.col("risk"), F.col("mrr")).alias("at_risk_mrr_pct"),
        F.round(F.coalesce("avg_tenure", F.lit(0.0)), 4).alias("mean_tenure"),
        money(F.col("avg_lifetime")).alias("mean_lifetime_spend"),
    )


def revenue_by_contract(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return (
        df.where(F.col(roles.contract).isNotNull() & F.col(roles.target).isNotNull())
        .groupBy(roles.contract, roles.target)
        .agg(money(F.sum(roles.revenue)).alias("mrr"))
    )


def known_shares(df: DataFrame, name: str, groups: dict[str, Column]) -> DataFrame:
    """Size and share of each named predicate among the rows matching any, in one pass."""
    anywhere = F.lit(False)
    for test in groups.values():
        anywhere = anywhere | F.coalesce(test, F.lit(False))
    cells = F.array(
        *[F.struct(F.lit(label).alias(name), F.count_if(test).alias("customers")) for label, test in groups.items()]
    )
    counted = df.agg(cells.alias("cells"), F.count_if(anywhere).alias("total"))
    return counted.select("total", F.inline("cells")).select(
        name, "customers", percent(F.col("customers"), F.col("total")).alias("share_pct")
    )


def churn_distribution(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    status = F.col(roles.target)
    groups = {"Churned Customers": status == roles.positive, "Retained Customers": status == roles.negative}
    return known_shares(df, "status", groups)


def histogram(
    df: DataFrame, column: str, low: float, width: float, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per fixed-width bucket; bounds are given, so no pass over the data to find them."""
    value = F.col(column).cast("double")
    bucket = F.floor((value - low) / width).cast("bigint")
    return (
        df.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(*by, bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(
            *by,
            "bucket",
            (F.lit(float(low)) + F.col("bucket") * float(width)).alias("lower"),
            (F.lit(float(low)) + (F.col("bucket") + 1) * float(width)).alias("upper"),
            "n",
        )
    )


def segment_signals(df: DataFrame, roles: ColumnRoles, segments: dict[str, Column]) -> DataFrame:
    """Size, churn rate and revenue per named predicate, all in one pass."""
    churned = is_positive(roles.target, roles.positive)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("segment"),
                F.count_if(test).alias("customers"),
                F.coalesce(F.sum(F.when(test, churned)), F.lit(0)).alias("churned"),
                F.coalesce(F.sum(F.when(test, F.col(roles.revenue))), F.lit(0.0)).alias("revenue"),
            )
            for name, test in segments.items()
        ]
    )
    return (
        df.agg(rows.alias("rows"))
        .select(F.inline("rows"))
        .select(
            "segment",
            "customers",
            "churned",
            percent(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
            money(F.col("revenue")).alias("mrr"),
        )
    )


def strategic_signals(df: DataFrame, roles: ColumnRoles, rules: RuleBook) -> DataFrame:
    """Churn of the three strategic segments and the yearly saving of contract migration."""
    flexible = F.col(roles.contract) == rules.flexible_contract
    signals = segment_signals(
        df,
        roles,
        {
            "flexible_contract": flexible,
            "risky_service": F.col(roles.service) == rules.risky_service,
            "friction_payment": F.col(roles.payment) == rules.friction_payment,
        },
    )
    saving = F.when(
        F.col("segment") == "flexible_contract", F.round(F.col("mrr") * CONVERSION_SHARE * MONTHS, MONEY)
    )
    return signals.withColumn("annual_saving", saving)


def vulnerability_stats(df: DataFrame, roles: ColumnRoles, rules: RuleBook) -> DataFrame:
    """Portfolio headline plus the vulnerability list, computed in one pass."""
    return segment_signals(
        df,
        roles,
        {
            "portfolio": F.lit(True),
            "flexible_contract": F.col(roles.contract) == rules.flexible_contract,
            "risky_service_without_support": (F.col(roles.service) == rules.risky_service)
            & (F.col(roles.support) == rules.addon_no),
            "friction_payment": F.col(roles.payment) == rules.friction_payment,
        },
    ).withColumn("annual_mrr", F.round(F.col("mrr") * MONTHS, MONEY))


def revenue_at_risk(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    churned = is_positive(roles.target, roles.positive)
    return df.agg(
        F.count("*").alias("customers"),
        percent(F.coalesce(F.sum(churned), F.lit(0)), F.count("*")).alias("churn_rate_pct"),
        money(F.sum(F.when(churned == 1, F.col(roles.revenue)))).alias("monthly_revenue_at_risk"),
        money(MONTHS * F.sum(F.when(churned == 1, F.col(roles.revenue)))).alias("annual_revenue_at_risk"),
    )


def long_levels(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(carry…, feature, level), one row per category cell, from a single scan."""
    cells = array(struct({"feature": text(c), "level": f"CAST({quoted(c)} AS STRING)"}) for c in columns)
    return df.select(*carry, F.inline(F.expr(cells)))


def churn_by_category(df: DataFrame, roles: ColumnRoles, columns: Sequence[str]) -> DataFrame:
    churned = is_positive(roles.target, roles.positive)
    return (
        long_levels(df, columns, [roles.target])
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(
            F.count(roles.target).alias("total"),
            F.sum(churned).alias("churned"),
            F.count("*").alias("_rows"),
        )
        .select("feature", "level", "total", "churned", percent(F.col("churned"), F.col("_rows")).alias("churn_rate_pct"))
    )


def contingency(df: DataFrame, column: str, roles: ColumnRoles) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("level"))
        .agg(
            F.count_if(F.col(roles.target) == roles.negative).alias("retained"),
            F.count_if(F.col(roles.target) == roles.positive).alias("churned"),
        )
    )


def revenue_hierarchy(df: DataFrame, levels: Sequence[str], revenue: str) -> DataFrame:
    """Revenue at every depth of a level path; ``depth`` tells a rolled-up NULL from a missing one."""
    present = df
    for name in levels:
        present = present.where(F.col(name).isNotNull())
    keys = F.grouping_id(*levels)
    depth = F.lit(len(levels)) - F.bit_count(F.col("_rolled"))
    return (
        present.rollup(*levels)
        .agg(F.sum(revenue).alias("_sum"), keys.alias("_rolled"))
        .select(*levels, depth.cast("int").alias("depth"), money(F.col("_sum")).alias("mrr"))
    )


def addon_shield(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Churn by how many add-ons a subscriber holds."""
    held = sum((F.coalesce((F.col(a) == "Yes").cast("int"), F.lit(0)) for a in roles.addons), F.lit(0))
    churned = is_positive(roles.target, roles.positive)
    return (
        df.groupBy(held.cast("int").alias("addon_count"))
        .agg(F.count(roles.target).alias("total"), percent(F.sum(churned), F.count("*")).alias("churn_rate_pct"))
    )


def payment_friction(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return (
        churn_by_category(df, roles, [roles.payment])
        .select(F.col("level").alias(roles.payment), "total", "churn_rate_pct")
        .orderBy("churn_rate_pct", roles.payment)
    )


def with_quadrant(df: DataFrame, roles: ColumnRoles, medians: dict[str, float]) -> DataFrame:
    """Place each subscriber by spend and tenure; a value equal to the median counts as high."""
    spender = F.col(roles.revenue) >= medians[roles.revenue]
    settled = F.col(roles.tenure) >= medians[roles.tenure]
    return df.where(F.col(roles.revenue).isNotNull() & F.col(roles.tenure).isNotNull()).withColumn(
        "quadrant",
        F.when(spender & ~settled, "VIP Flight Risk")
        .when(spender & settled, "Core Crown Jewels")
        .when(~spender & ~settled, "Trial Churners")
        .otherwise("Stable Budget Anchors"),
    )


def value_quadrants(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    medians = fit_medians(df, [roles.revenue, roles.tenure])
    churned = is_positive(roles.target, roles.positive)
    return (
        with_quadrant(df, roles, medians)
        .groupBy("quadrant")
        .agg(
            F.count("*").alias("customers"),
            percent(F.sum(churned), F.count("*")).alias("churn_rate_pct"),
            money(F.sum(roles.revenue)).alias("mrr"),
        )
    )


def cohort_slice(df: DataFrame, roles: ColumnRoles, contracts: Sequence[str], services: Sequence[str]) -> DataFrame:
    return df.where(F.col(roles.contract).isin(list(contracts)) & F.col(roles.service).isin(list(services)))


def cohort_coverage(df: DataFrame, roles: ColumnRoles, contracts: Sequence[str], services: Sequence[str]) -> DataFrame:
    inside = F.col(roles.contract).isin(list(contracts)) & F.col(roles.service).isin(list(services))
    counted = df.agg(F.count_if(inside).alias("selected"), F.count("*").alias("total"))
    return counted.withColumn("coverage_pct", percent(F.col("selected"), F.col("total")))


def keyword_search(df: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns matches the case-insensitive regular expression."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.col(name).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(found)


def churned_preview(df: DataFrame, roles: ColumnRoles, rows: int = 100) -> DataFrame:
    """First churned subscribers along the id, for display."""
    return df.where(F.col(roles.target) == roles.positive).orderBy(roles.id).limit(rows)
