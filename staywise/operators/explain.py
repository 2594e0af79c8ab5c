"""Exact attributions of linear scores in log-odds space.

Every attribution depends on one row and a fitted background only, so the
whole explanation of a subscriber is built inside the row: no shuffle, no
join, and ordering by magnitude is an array sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import logistic
from staywise.functions.sql import array, inside, number, quoted, struct, text
from staywise.operators.features import Feature, encode
from staywise.operators.ordering import fit_medians
from staywise.operators.profile import ordered_sample
from staywise.operators.scoring import Scorecard

BACKGROUND_ROWS = 200
BACKGROUND_SEED = 42
DIGITS = 9

INCREASES = "increases churn"
DECREASES = "decreases churn"


@dataclass(frozen=True)
class Background:
    """Feature means of the reference sample and the log-odds they stand for."""

    means: Mapping[str, float]
    base: float

    @property
    def base_probability(self) -> Column:
        return logistic(F.lit(self.base))


def fit_background(
    clean: DataFrame, card: Scorecard, key: str, rows: int | None = BACKGROUND_ROWS, seed: int = BACKGROUND_SEED
) -> Background:
    """Means of the encoded features over a seeded sample, or over everything when ``rows`` is None."""
    sample = clean if rows is None else ordered_sample(clean, key, rows, seed)
    row = sample.select(*[F.expr(f"avg({card.value(f)})").alias(f"f{i}") for i, f in enumerate(card.features)]).first()
    means = {f.name: float(row[f"f{i}"] or 0.0) for i, f in enumerate(card.features)}
    base = card.intercept + sum(card.weights[name] * mean for name, mean in means.items())
    return Background(means=means, base=base)


def contribution(
    card: Scorecard, background: Background, feature: Feature, get: Callable[[str], str] = quoted
) -> str:
    """Weight times distance from the background mean, as expression text."""
    return f"{number(card.weights[feature.name])} * ({card.value(feature, get)} - {number(background.means[feature.name])})"


def contributions(card: Scorecard, background: Background) -> Column:
    """array<struct> with one entry per feature, largest magnitude first, the name deciding a tie.

    The sort key leads the struct, so ordering is a plain array sort in the row.
    """
    items = []
    for f in card.features:
        phi = contribution(card, background, f)
        items.append(
            struct(
                {
                    "order": f"-abs({phi})",
                    "feature": text(f.name),
                    "label": text(f.label),
                    "raw_feature": text(f.raw),
                    "value": f"CAST({quoted(f.raw)} AS STRING)",
                    "contribution": phi,
                }
            )
        )
    return F.expr(f"sort_array({array(items)})")


def explain_rows(clean: DataFrame, card: Scorecard, background: Background, key: str, top: int | None = None) -> DataFrame:
    """Long form: one row per subscriber and feature, ranked by magnitude."""
    ordered = contributions(card, background)
    if top is not None:
        ordered = F.slice(ordered, 1, top)
    phi = F.col("item.contribution")
    shift = logistic(F.lit(background.base) + phi) - background.base_probability
    return clean.select(key, F.posexplode(ordered).alias("position", "item")).select(
        key,
        (F.col("position") + 1).cast("bigint").alias("rank"),
        "item.feature",
        "item.label",
        "item.raw_feature",
        "item.value",
        F.round(phi, DIGITS).alias("contribution"),
        F.round(F.abs(phi), DIGITS).alias("abs_contribution"),
        F.round(shift, DIGITS).alias("probability_shift"),
        F.when(phi > 0, INCREASES).otherwise(DECREASES).alias("direction"),
    )


def explain_nested(clean: DataFrame, card: Scorecard, background: Background, key: str) -> DataFrame:
    """One row per subscriber: totals, and the ordered lists of what raises and lowers the score."""
    ordered = contributions(card, background)
    total = F.aggregate(F.col("ordered"), F.lit(0.0), lambda acc, x: acc + x["contribution"])
    names = lambda keep: F.transform(F.filter(F.col("ordered"), keep), lambda x: x["feature"])
    return clean.select(key, F.expr(card.margin()).alias("log_odds"), ordered.alias("ordered")).select(
        key,
        F.lit(background.base).alias("base_value"),
        "log_odds",
        (F.lit(background.base) + total - F.col("log_odds")).alias("reconstruction_error"),
        "ordered",
        names(lambda x: x["contribution"] > 0).alias("top_increasing"),
        names(lambda x: x["contribution"] < 0).alias("top_decreasing"),
    )


def additivity(clean: DataFrame, card: Scorecard, background: Background, key: str) -> DataFrame:
    """Largest |base + sum of contributions - log-odds| over all rows."""
    error = F.abs("reconstruction_error")
    return explain_nested(clean, card, background, key).agg(
        F.count("*").alias("records"), F.max(error).alias("max_error")
    )


def global_importance(clean: DataFrame, card: Scorecard, background: Background) -> DataFrame:
    """Mean magnitude per feature in one pass; refuses values that are not finite."""
    cells = array(
        struct(
            {
                "feature": text(f.name),
                "label": text(f.label),
                "mean_abs": f"avg(abs({contribution(card, background, f)}))",
            }
        )
        for f in card.features
    )
    finite = F.assert_true(F.coalesce(F.col("mean_abs") < float("inf"), F.lit(False)), F.lit("attribution is not finite"))
    return (
        clean.agg(F.expr(cells).alias("cells"))
        .select(F.inline("cells"))
        .where(finite.isNull())
        .select("feature", "label", F.round("mean_abs", DIGITS).alias("mean_abs_contribution"))
    )


def global_direction(clean: DataFrame, card: Scorecard, background: Background) -> DataFrame:
    """Mean contribution while a feature is active: indicator set, or number above its median.

    A feature counts as an indicator when both 0 and 1 occur and nothing else
    does.  One that is never active falls back to its weight against the mean.
    """
    numbers = [f for f in card.features if f.level is None]
    encoded = encode(clean, numbers, card.means, card.deviations, [])
    medians = fit_medians(encoded, [f.name for f in numbers]) if numbers else {}
    cells = []
    for f in card.features:
        x, phi = card.value(f), contribution(card, background, f)
        if f.level is None:
            above = f"avg(CASE WHEN {x} > {number(medians.get(f.name, 0.0))} THEN {phi} END)"
            present = f"avg(CASE WHEN {x} = 1 THEN {phi} END)"
            binary = f"min({x}) = 0 AND max({x}) = 1 AND count_if({x} NOT IN (0D, 1D)) = 0"
            effect = f"coalesce(if({binary}, {present}, {above}), 0D)"
        else:
            # A linear model gives every active row of an indicator the same contribution.
            active = number(card.weights[f.name] * (1.0 - background.means[f.name]))
            effect = f"if(min({x}) = 0 AND max({x}) = 1, {active}, 0D)"
        cells.append(struct({"feature": text(f.name), "effect": effect}))
    return (
        clean.agg(F.expr(array(cells)).alias("cells"))
        .select(F.inline("cells"))
        .select(
            "feature",
            F.round("effect", DIGITS).alias("active_effect"),
            F.when(F.col("effect") > 0, INCREASES).otherwise(DECREASES).alias("direction"),
        )
    )


def attribution_deltas(
    before_after: DataFrame,
    card: Scorecard,
    background: Background,
    key: str,
    carry: Sequence[str] = (),
    top: int = 5,
    before: str = "before",
    after: str = "after",
) -> DataFrame:
    """Features whose contribution changes most between two states held in one row.

    ``before`` and ``after`` are structs with the model's raw columns; both sides
    use the same background, so the difference comes from changed columns only.
    """

    sides = []
    items = []
    for i, f in enumerate(card.features):
        sides.append(F.expr(contribution(card, background, f, inside(before))).alias(f"o{i}"))
        sides.append(F.expr(contribution(card, background, f, inside(after))).alias(f"n{i}"))
        items.append(
            struct(
                {
                    "order": f"-abs(n{i} - o{i})",
                    "feature": text(f.name),
                    "raw_feature": text(f.raw),
                    "baseline_contribution": f"o{i}",
                    "simulated_contribution": f"n{i}",
                    "delta": f"n{i} - o{i}",
                }
            )
        )
    # Both sides are projected once, then compared, ordered and cut within the row.
    before_after = before_after.select(key, *carry, *sides)
    ordered = F.expr(f"slice(sort_array({array(items)}), 1, {int(top)})")
    return before_after.select(key, *carry, F.posexplode(ordered).alias("position", "item")).select(
        key,
        *carry,
        (F.col("position") + 1).cast("bigint").alias("rank"),
        "item.feature",
        "item.raw_feature",
        F.round("item.baseline_contribution", DIGITS).alias("baseline_contribution"),
        F.round("item.simulated_contribution", DIGITS).alias("simulated_contribution"),
        F.round("item.delta", DIGITS).alias("delta"),
        F.round(F.abs("item.delta"), DIGITS).alias("abs_delta"),
    )
