"""Scoring and decisions: linear scorecards, labels, tiers, actions, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import logistic, percent
from staywise.functions.sql import array, number, quoted, struct, text
from staywise.operators.contract import accepted
from staywise.operators.features import Feature, feature_list, feature_sql
from staywise.operators.ordering import numbered
from staywise.operators.portfolio import histogram, known_shares, money
from staywise.roles import ColumnRoles, ContractSpec, RuleBook

PROBABILITY = "churn_probability"

# Spellings of a class label that mean the positive or the negative class.
CLASS_ALIASES = {"1": "Yes", "yes": "Yes", "true": "Yes", "0": "No", "no": "No", "false": "No"}

# Upper bounds and names of the three tier policies, on the rounded percentage.
BULK_TIERS = ((30.0, "Low Risk"), (60.0, "Moderate Risk"), (100.0, "High Risk"))
API_LEVELS = ((30.0, "Low Risk"), (60.0, "Medium Risk"), (80.0, "High Risk"), (None, "Critical Risk"))
VIEW_STATUS = ((30.0, "LOW RISK"), (60.0, "MODERATE RISK"), (None, "HIGH RISK"))

# Retention actions of the scoring API as (action, impact, description, priority).
CONTRACT_ACTION = (
    "Contract Upgrade Incentive",
    "Reduces churn risk by ~30%",
    "Offer 15% discount on an annual contract lock-in.",
    "HIGH",
)
SUPPORT_ACTION = (
    "Complimentary Premium Tech Support",
    "Reduces churn risk by ~18%",
    "Include free 3-month VIP technical onboarding to resolve connectivity friction.",
    "HIGH",
)
PAYMENT_ACTION = (
    "Autopay / Credit Card Migration",
    "Reduces payment churn by ~12%",
    "Provide a $5 monthly bill credit for switching to automated bank transfer or credit card.",
    "MEDIUM",
)
BILL_ACTION = (
    "Plan Right-Sizing Review",
    "Prevents bill-shock churn",
    "Review unutilized streaming/add-on services and tailor a balanced loyalty bundle.",
    "MEDIUM",
)
LOYALTY_ACTION = (
    "Loyalty Appreciation",
    "Reinforces retention",
    "Send quarterly satisfaction check-in and loyalty milestone reward.",
    "LOW",
)
ACTIONS = (CONTRACT_ACTION, SUPPORT_ACTION, PAYMENT_ACTION, BILL_ACTION, LOYALTY_ACTION)

# Next-best-action headlines of the single view.
LOCK_IN = "Offer 1-Year Contract Lock-in"
CYBER_CARE = "Bundle Cyber-Care Package"
AUTO_PAY = "Incentivize Auto-Pay"
CONCIERGE = "First-90-Day Concierge Outreach"


@dataclass(frozen=True)
class Scorecard:
    """A linear model in the open: scaling constants and one weight per feature."""

    version: str
    intercept: float
    numerics: tuple[str, ...]
    means: Mapping[str, float]
    deviations: Mapping[str, float]
    levels: Mapping[str, tuple[str, ...]]
    weights: Mapping[str, float]
    drop_first: bool
    threshold: float = 0.5

    @property
    def features(self) -> list[Feature]:
        return feature_list(self.numerics, self.levels, self.drop_first)

    def value(self, feature: Feature, get: Callable[[str], str] = quoted) -> str:
        return feature_sql(feature, self.means, self.deviations, get)

    def margin(self, get: Callable[[str], str] = quoted) -> str:
        """Log-odds as expression text: scaled numerics plus one CASE per category."""
        terms = [number(self.intercept)]
        by_category: dict[str, list[Feature]] = {name: [] for name in self.levels}
        for feature in self.features:
            if feature.level is None:
                terms.append(f"{number(self.weights[feature.name])} * {self.value(feature, get)}")
            else:
                by_category[feature.raw].append(feature)
        for name, listed in by_category.items():
            points = " ".join(f"WHEN {text(f.level)} THEN {number(self.weights[f.name])}" for f in listed)
            terms.append(f"CASE {get(name)} {points} ELSE 0D END")
        return " + ".join(terms)

    def probability(self, get: Callable[[str], str] = quoted) -> Column:
        return logistic(F.expr(self.margin(get)))


def probability_percent(probability: Column) -> Column:
    return F.round(100.0 * probability, 2)


def decide(probability: Column, threshold: float) -> Column:
    return F.when(probability >= threshold, "Yes").otherwise("No")


def with_score(df: DataFrame, card: Scorecard, prefix: str = "") -> DataFrame:
    """Adds margin, probability, percentage and label; a narrow projection."""
    margin, probability = f"{prefix}margin", f"{prefix}{PROBABILITY}"
    return (
        df.withColumn(margin, F.expr(card.margin()))
        .withColumn(probability, logistic(F.col(margin)))
        .withColumns(
            {
                f"{prefix}churn_pct": probability_percent(F.col(probability)),
                f"{prefix}prediction": decide(F.col(probability), card.threshold),
            }
        )
    )


def score_batch(df: DataFrame, spec: ContractSpec, card: Scorecard, carry: Sequence[str] = ()) -> DataFrame:
    """Contract, then score: one narrow stage from scan to probability."""
    return with_score(accepted(df, spec, carry), card)


def both_classes(scored: DataFrame, key: str) -> DataFrame:
    """Single-record form: percentages of both classes to two digits."""
    return scored.select(
        key,
        "prediction",
        F.col("churn_pct"),
        F.round(100.0 * (1.0 - F.col(PROBABILITY)), 2).alias("no_churn_pct"),
    )


def positive_index(labels: Sequence[object], positive: str = "Yes") -> int:
    """Index of the one class label that stands for the positive class."""
    canonical = [CLASS_ALIASES.get(str(label).strip().lower(), str(label)) for label in labels]
    if len(canonical) != 2 or canonical.count(positive) != 1:
        raise ValueError(f"expected two classes with one positive, got {list(labels)}")
    return canonical.index(positive)


def class_labels(df: DataFrame, column: str) -> list[str]:
    """Class labels, by index, that an indexed label column carries in its metadata; refused where it has none."""
    labels = df.schema[column].metadata.get("ml_attr", {}).get("vals")
    if not labels:
        raise ValueError(f"{column} names no class labels")
    return list(labels)


def model_probability(vector: str, labels: Sequence[object]) -> Column:
    """Positive-class entry of a fitted classifier's probability vector."""
    return vector_to_array(F.col(vector)).getItem(positive_index(labels))


def class_semantics(df: DataFrame, target: str, positive: str = "Yes") -> DataFrame:
    """Classes present in the target in ascending order, with their canonical meaning."""
    canonical = F.lit(None).cast("string")
    token = F.lower(F.trim(F.col("label")))
    for alias, meaning in CLASS_ALIASES.items():
        canonical = F.when(token == alias, F.lit(meaning)).otherwise(canonical)
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(
        F.count("*").alias("records")
    )
    ordered = numbered(counts, "label", "position")
    return ordered.select(
        "label",
        (F.col("position") - 1).cast("bigint").alias("class_index"),
        F.coalesce(canonical, F.col("label")).alias("canonical"),
        (F.coalesce(canonical, F.col("label")) == positive).alias("is_positive"),
        "records",
    )


def bulk_tier(pct: str = "churn_pct") -> Column:
    """Right-closed intervals: exactly 30 is Low, exactly 60 is Moderate."""
    tier = F.lit(None).cast("string")
    for bound, name in reversed(BULK_TIERS):
        tier = F.when(F.col(pct) <= bound, name).otherwise(tier)
    return tier


def _left_closed(pct: str, policy: Sequence[tuple[float | None, str]]) -> Column:
    level = F.lit(policy[-1][1])
    for bound, name in reversed(policy[:-1]):
        level = F.when(F.col(pct) < bound, name).otherwise(level)
    return level


def api_level(pct: str = "churn_pct") -> Column:
    """Left-closed intervals: exactly 30 is Medium, 60 High, 80 Critical."""
    return _left_closed(pct, API_LEVELS)


def view_status(pct: str = "churn_pct") -> Column:
    return _left_closed(pct, VIEW_STATUS)


def with_tiers(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {"risk_tier": bulk_tier(), "risk_level": api_level(), "risk_status": view_status()}
    )


def _action(test: str, action: tuple[str, str, str, str]) -> str:
    fields = dict(zip(("action", "impact", "description", "priority"), map(text, action)))
    return f"CASE WHEN {test} THEN {struct(fields)} END"


def interventions(roles: ColumnRoles, rules: RuleBook) -> Column:
    """array<struct<action, impact, description, priority>> in rule order; a loyalty action when no rule fires."""
    contract, service, support = quoted(roles.contract), quoted(roles.service), quoted(roles.support)
    payment, bill = quoted(roles.payment), quoted(roles.revenue)
    risky = f"{service} = {text(rules.risky_service)} AND {support} = {text(rules.addon_no)}"
    found = F.expr(
        "array_compact("
        + array(
            [
                _action(f"{contract} = {text(rules.flexible_contract)}", CONTRACT_ACTION),
                _action(risky, SUPPORT_ACTION),
                _action(f"{payment} = {text(rules.friction_payment)}", PAYMENT_ACTION),
                _action(f"CAST({bill} AS DOUBLE) > {number(rules.high_bill)}", BILL_ACTION),
            ]
        )
        + ")"
    )
    return F.when(F.size(found) == 0, F.expr(array([_action("true", LOYALTY_ACTION)]))).otherwise(found)


def next_best_actions(roles: ColumnRoles, rules: RuleBook) -> Column:
    """array<string> of the headlines that apply; may be empty."""
    unprotected = (F.col(roles.support) != rules.addon_yes) | (F.col(roles.security) != rules.addon_yes)
    return F.array_compact(
        F.array(
            F.when(F.col(roles.contract) == rules.flexible_contract, LOCK_IN),
            F.when(unprotected, CYBER_CARE),
            F.when(F.col(roles.payment) == rules.friction_payment, AUTO_PAY),
            F.when(F.col(roles.tenure) <= rules.early_tenure, CONCIERGE),
        )
    )


def batch_summary(tiered: DataFrame) -> DataFrame:
    churned = F.count_if(F.col("prediction") == "Yes")
    return tiered.agg(
        F.count("*").alias("total"),
        churned.alias("predicted_churn"),
        F.count_if(F.col("prediction") == "No").alias("predicted_retain"),
        percent(churned, F.count("*")).alias("predicted_churn_pct"),
        F.count_if(F.col("risk_tier") == "High Risk").alias("high_risk"),
        F.count_if(F.col("churn_pct") >= 60.0).alias("critical_high_risk"),
        F.round(F.coalesce(F.avg(PROBABILITY), F.lit(0.0)) * 100.0, 4).alias("mean_churn_pct"),
    )


def high_risk_revenue(tiered: DataFrame, roles: ColumnRoles) -> DataFrame:
    high = F.col("risk_tier") == "High Risk"
    return tiered.agg(
        F.count_if(high).alias("high_risk_accounts"),
        percent(F.count_if(high), F.count("*")).alias("high_risk_pct"),
        money(F.sum(F.when(high, F.col(roles.revenue)))).alias("high_risk_mrr"),
    )


def tier_distribution(tiered: DataFrame) -> DataFrame:
    """Every tier with its size and share, empty ones included."""
    return known_shares(tiered, "risk_tier", {name: F.col("risk_tier") == name for _, name in BULK_TIERS})


def probability_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(scored, "churn_pct", 0.0, 100.0 / bins)


def annual_value(roles: ColumnRoles) -> Column:
    return F.col(roles.revenue) * 12


def value_at_risk_by_tier(tiered: DataFrame, roles: ColumnRoles) -> DataFrame:
    return tiered.groupBy("risk_tier").agg(
        F.count("*").alias("customers"), money(F.sum(annual_value(roles))).alias("annual_value_at_risk")
    )


def result_records(tiered: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One output record per subscriber with the context columns that are present."""
    context = [c for c in (roles.tenure, roles.contract, roles.revenue, roles.service) if c in tiered.columns]
    return numbered(tiered, roles.id, "row").select(
        "row",
        roles.id,
        "prediction",
        (F.col("prediction") == "Yes").alias("churn"),
        "churn_pct",
        "risk_level",
        *context,
    )


def synthesized_ids(df: DataFrame, key: str, name: str = "synthetic_id") -> DataFrame:
    """``CUST-0001`` style ids along a unique ordering key."""
    rows = numbered(df, key, "row")
    digits = F.greatest(F.length(F.col("row").cast("string")), F.lit(4))
    return rows.withColumn(name, F.concat(F.lit("CUST-"), F.lpad(F.col("row").cast("string"), digits, F.lit("0"))))


def batch_invariance(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Largest difference between a record's score in the whole batch and in a part of it."""
    left = whole.select(F.col(key).alias("_key"), F.col(PROBABILITY).alias("in_whole"))
    right = part.select(F.col(key).alias("_key"), F.col(PROBABILITY).alias("in_part"))
    return left.join(right, "_key").agg(
        F.count("*").alias("records"),
        F.coalesce(F.max(F.abs(F.col("in_whole") - F.col("in_part"))), F.lit(0.0)).alias("max_difference"),
    )
