"""Two frozen scorecards over the mart and the named profiles scored with them."""

from __future__ import annotations

from staywise.operators.scenarios import Scenario
from staywise.operators.scoring import Scorecard
from staywise.plans.mart import ADDONS, MART_DOMAINS, MART_ROLES

MEANS = {"SeniorCitizen": 0.08, "tenure": 59.0, "MonthlyCharges": 36000.0, "TotalCharges": 2130000.0}
DEVIATIONS = {"SeniorCitizen": 0.27, "tenure": 8.5, "MonthlyCharges": 14000.0, "TotalCharges": 830000.0}


def _weights(numbers: dict[str, float], levels: dict[str, dict[str, float]]) -> dict[str, float]:
    named = {f"num__{name}": weight for name, weight in numbers.items()}
    for column, points in levels.items():
        named |= {f"cat__{column}_{level}": weight for level, weight in points.items()}
    return named


# Version 1 leaves out the first level of each category.
SCORECARD_V1 = Scorecard(
    version="v1",
    intercept=0.6,
    numerics=MART_ROLES.numerics,
    means=MEANS,
    deviations=DEVIATIONS,
    levels=MART_DOMAINS,
    weights=_weights(
        {"SeniorCitizen": 0.25, "tenure": -0.55, "MonthlyCharges": 0.45, "TotalCharges": -0.35},
        {
            "Region": {"AMERICA": 0.12, "ASIA": -0.08, "EUROPE": 0.05, "MIDDLE EAST": 0.21},
            "Segment": {"BUILDING": -0.15, "FURNITURE": 0.1, "HOUSEHOLD": -0.3, "MACHINERY": 0.4},
            "Contract": {"One year": -0.7, "Two year": -1.4},
            "PaymentMethod": {"2-HIGH": -0.1, "3-MEDIUM": -0.25, "4-NOT SPECIFIED": -0.2, "5-LOW": -0.45, "none": 0.6},
            "addon_economy": {"Yes": -0.3},
            "addon_large": {"Yes": -0.1},
            "addon_medium": {"Yes": -0.2},
            "addon_promo": {"Yes": -0.5},
            "addon_small": {"Yes": 0.05},
            "addon_standard": {"Yes": -0.15},
        },
    ),
    drop_first=True,
)

# Version 2 has a weight for every level.
SCORECARD_V2 = Scorecard(
    version="v2",
    intercept=-0.35,
    numerics=MART_ROLES.numerics,
    means=MEANS,
    deviations=DEVIATIONS,
    levels=MART_DOMAINS,
    weights=_weights(
        {"SeniorCitizen": 0.2, "tenure": -0.4, "MonthlyCharges": 0.5, "TotalCharges": -0.3},
        {
            "Region": {"AFRICA": -0.05, "AMERICA": 0.1, "ASIA": -0.1, "EUROPE": 0.02, "MIDDLE EAST": 0.15},
            "Segment": {"AUTOMOBILE": 0.05, "BUILDING": -0.2, "FURNITURE": 0.15, "HOUSEHOLD": -0.25, "MACHINERY": 0.35},
            "Contract": {"Month-to-month": 0.8, "One year": -0.05, "Two year": -0.75},
            "PaymentMethod": {
                "1-URGENT": 0.3, "2-HIGH": 0.1, "3-MEDIUM": -0.1, "4-NOT SPECIFIED": -0.05, "5-LOW": -0.3, "none": 0.5,
            },
            "addon_economy": {"No": 0.2, "Yes": -0.15},
            "addon_large": {"No": 0.05, "Yes": -0.05},
            "addon_medium": {"No": 0.1, "Yes": -0.12},
            "addon_promo": {"No": 0.25, "Yes": -0.3},
            "addon_small": {"No": -0.02, "Yes": 0.04},
            "addon_standard": {"No": 0.08, "Yes": -0.1},
        },
    ),
    drop_first=False,
)

CARDS = {card.version: card for card in (SCORECARD_V1, SCORECARD_V2)}

BASELINE = Scenario("unchanged")
SCENARIOS = (
    BASELINE,
    Scenario("one_year_contract", contract="One year"),
    Scenario("two_year_contract", contract="Two year"),
    Scenario("add_protection", add_protection=True),
    Scenario("automatic_payment", automatic_payment=True),
    Scenario("monthly_credit", credit=2500.0),
    Scenario("full_package", contract="Two year", add_protection=True, automatic_payment=True, credit=2500.0),
)


def _profile(contract: str, payment: str, segment: str, tenure: int, bill: float, senior: int, held: tuple[str, ...]):
    return {
        "Region": "ASIA",
        "Segment": segment,
        "Contract": contract,
        "PaymentMethod": payment,
        **{addon: "Yes" if addon in held else "No" for addon in ADDONS},
        "SeniorCitizen": senior,
        "tenure": tenure,
        "MonthlyCharges": bill,
        "TotalCharges": bill * max(1, tenure),
    }


ARCHETYPES = {
    "high_risk_newcomer": _profile("Month-to-month", "1-URGENT", "MACHINERY", 2, 52000.0, 0, ()),
    "loyal_family": _profile("Two year", "5-LOW", "HOUSEHOLD", 64, 38000.0, 0, ADDONS),
    "high_spend_streamer": _profile("Month-to-month", "1-URGENT", "MACHINERY", 40, 61000.0, 1, ("addon_large", "addon_small")),
    "budget_saver": _profile("One year", "3-MEDIUM", "BUILDING", 55, 21000.0, 0, ("addon_economy",)),
}
