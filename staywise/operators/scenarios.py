"""What-if re-scoring of whole cohorts and campaign economics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import percent, ratio
from staywise.functions.sql import inside, literal
from staywise.operators.portfolio import MONTHS, money, segment_signals
from staywise.operators.scoring import Scorecard
from staywise.roles import ColumnRoles, RuleBook

# Fixed value: flat average monthly bill of the browser's campaign calculator.
FLAT_BILL = 75.0

DIGITS = 6


@dataclass(frozen=True)
class Scenario:
    """One intervention; fields left at their defaults change nothing."""

    name: str
    contract: str | None = None
    add_protection: bool = False
    automatic_payment: bool = False
    credit: float = 0.0


def changed_columns(roles: ColumnRoles, rules: RuleBook, scenario: Scenario) -> dict[str, Column]:
    """Model columns after the intervention.

    The bill never falls below the floor, and lifetime spend is always derived
    again from the resulting bill.
    """
    columns = {name: F.col(name) for name in roles.features}
    if scenario.contract is not None:
        columns[roles.contract] = F.lit(scenario.contract)
    if scenario.add_protection:
        columns[roles.support] = F.lit(rules.addon_yes)
        columns[roles.security] = F.lit(rules.addon_yes)
    if scenario.automatic_payment:
        columns[roles.payment] = F.lit(rules.automatic_payment)
    bill = F.greatest(F.lit(rules.bill_floor), F.col(roles.revenue) - float(scenario.credit))
    columns[roles.revenue] = bill
    columns[roles.lifetime] = bill * F.greatest(F.lit(1), F.col(roles.tenure).cast("int"))
    return columns


def scenario_states(
    clean: DataFrame, roles: ColumnRoles, rules: RuleBook, scenarios: Sequence[Scenario], baseline: Scenario
) -> DataFrame:
    """One row per subscriber and scenario holding the state before and after as structs.

    Scenarios are literals inside the row, so there is no join and nothing to shuffle.
    """

    def state(scenario: Scenario) -> Column:
        columns = changed_columns(roles, rules, scenario)
        return F.struct(*[column.alias(name) for name, column in columns.items()])

    options = F.array(
        *[F.struct(F.lit(s.name).alias("scenario"), state(s).alias("after")) for s in scenarios]
    )
    return clean.select(roles.id, state(baseline).alias("before"), F.explode(options).alias("option")).select(
        roles.id, "before", F.col("option.scenario").alias("scenario"), F.col("option.after").alias("after")
    )


def _state_probability(card: Scorecard, side: str) -> Column:
    return card.probability(inside(side))


def rescored(states: DataFrame, card: Scorecard, roles: ColumnRoles) -> DataFrame:
    """Probability before and after, change in points, and the reduction when there is one."""
    scored = states.select(
        roles.id,
        "scenario",
        _state_probability(card, "before").alias("p0"),
        _state_probability(card, "after").alias("p1"),
    )
    change = 100.0 * (F.col("p1") - F.col("p0"))
    return scored.select(
        roles.id,
        "scenario",
        F.round("p0", DIGITS).alias("baseline_probability"),
        F.round("p1", DIGITS).alias("simulated_probability"),
        F.round(change, 4).alias("delta_points"),
        F.round(F.greatest(-change, F.lit(0.0)), 4).alias("reduction_points"),
    )


def scenario_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("scenario").agg(
        F.count("*").alias("customers"),
        F.round(F.avg("delta_points"), 4).alias("mean_delta_points"),
        F.count_if(F.col("reduction_points") > 0).alias("customers_helped"),
    )


def best_scenario(
    clean: DataFrame,
    roles: ColumnRoles,
    rules: RuleBook,
    card: Scorecard,
    scenarios: Sequence[Scenario],
) -> DataFrame:
    """Scenario with the lowest probability per subscriber, found inside the row."""
    states = {f"s{i}": F.struct(*[c.alias(n) for n, c in changed_columns(roles, rules, s).items()]) for i, s in enumerate(scenarios)}
    wide = clean.select(roles.id, *[state.alias(name) for name, state in states.items()])
    options = F.array(
        *[
            F.struct(_state_probability(card, f"s{i}").alias("p"), F.lit(s.name).alias("scenario"))
            for i, s in enumerate(scenarios)
        ]
    )
    return wide.select(roles.id, F.array_min(options).alias("best")).select(
        roles.id, F.col("best.scenario").alias("scenario"), F.round("best.p", DIGITS).alias("simulated_probability")
    )


def campaign_economics(cohorts: DataFrame, keys: Sequence[str], rates: Sequence[int], offers: Sequence[float]) -> DataFrame:
    """Economics of every cohort (``customers``, ``bill``) for each acceptance rate and offer cost.

    Saved customers are truncated to whole people; ROI is 0 when nothing is spent.
    """
    grid = F.array(
        *[
            F.struct(F.lit(int(r)).alias("rate_pct"), F.lit(float(o)).alias("offer_cost"))
            for r in rates
            for o in offers
        ]
    )
    saved = F.floor(F.col("customers") * (F.col("rate_pct") / 100)).cast("bigint")
    cost = F.col("customers") * F.col("offer_cost")
    planned = (
        cohorts.select(*keys, "customers", "bill", F.explode(grid).alias("plan"))
        .select(*keys, "customers", "bill", "plan.rate_pct", "plan.offer_cost")
        .withColumn("saved_customers", saved)
        .withColumn("campaign_cost", money(cost))
        .withColumn("revenue_saved", F.col("saved_customers") * F.col("bill") * MONTHS)
        .withColumn("net", F.col("revenue_saved") - F.col("campaign_cost"))
    )
    return planned.select(
        *keys,
        "customers",
        "rate_pct",
        "offer_cost",
        "saved_customers",
        "campaign_cost",
        money(F.col("revenue_saved")).alias("revenue_saved"),
        money(F.col("net")).alias("net_profit"),
        F.round(ratio(100.0 * F.col("net"), F.col("campaign_cost")), 2).alias("roi_pct"),
    )


def flat_bill_economics(cohorts: DataFrame, keys: Sequence[str], rates: Sequence[int], bill: float = FLAT_BILL) -> DataFrame:
    """The simpler calculator: saved customers are rounded and every bill is the same."""
    saved = F.round(F.col("customers") * (F.col("rate_pct") / 100)).cast("bigint")
    return (
        cohorts.select(*keys, "customers", F.explode(F.array(*[F.lit(int(r)) for r in rates])).alias("rate_pct"))
        .withColumn("saved_customers", saved)
        .withColumn("annual_revenue_saved", money(F.col("saved_customers") * (bill * MONTHS)))
    )


def cohort_sizes(tiered: DataFrame, roles: ColumnRoles, by: Sequence[str]) -> DataFrame:
    return tiered.groupBy(*by).agg(F.count("*").alias("customers"), F.round(F.avg(roles.revenue), 2).alias("bill"))


def playbook_pillars(df: DataFrame, roles: ColumnRoles, rules: RuleBook) -> DataFrame:
    """Size, churn and revenue of the four playbook segments, in one pass."""
    return segment_signals(
        df,
        roles,
        {
            "contract_migration": F.col(roles.contract) == rules.flexible_contract,
            "security_shield": F.col(roles.service) == rules.risky_service,
            "first_90_days": F.col(roles.tenure) <= rules.early_tenure,
            "autopay_migration": F.col(roles.payment) == rules.friction_payment,
        },
    )


def archetype_positions(
    scored: DataFrame, card: Scorecard, archetypes: dict[str, dict[str, object]], probability: str
) -> DataFrame:
    """Score named profiles and count the subscribers who score lower.

    A profile's score is an expression of literals, folded once by the
    optimiser, so the cohort is read in a single pass whatever their number.
    """
    cells = []
    for name, profile in archetypes.items():
        own = card.probability(lambda raw, profile=profile: literal(profile[raw]))
        cells.append(
            F.struct(
                F.lit(name).alias("archetype"),
                own.alias("own"),
                F.count("*").alias("customers"),
                F.count_if(F.col(probability) < own).alias("customers_below"),
            )
        )
    placed = scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return placed.select(
        "archetype",
        F.round(100.0 * F.col("own"), 2).alias("churn_pct"),
        "customers",
        "customers_below",
        percent(F.col("customers_below"), F.col("customers")).alias("percentile"),
    )
