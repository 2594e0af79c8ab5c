"""The telecom subscriber table: 21 columns, accepted levels, rule levels."""

from __future__ import annotations

from pyspark.sql import types as T

from staywise.roles import ColumnRoles, ContractSpec, RuleBook

# Accepted levels per category, in ascending order.
YES_NO = ("No", "Yes")
PHONE_ADDON = ("No", "No phone service", "Yes")
INTERNET_ADDON = ("No", "No internet service", "Yes")
TELCO_DOMAINS = {
    "gender": ("Female", "Male"),
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": PHONE_ADDON,
    "InternetService": ("DSL", "Fiber optic", "No"),
    "OnlineSecurity": INTERNET_ADDON,
    "OnlineBackup": INTERNET_ADDON,
    "DeviceProtection": INTERNET_ADDON,
    "TechSupport": INTERNET_ADDON,
    "StreamingTV": INTERNET_ADDON,
    "StreamingMovies": INTERNET_ADDON,
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": YES_NO,
    "PaymentMethod": (
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ),
}

# Fixed value: stored training median of the one imputable numeric.
TOTAL_CHARGES_MEDIAN = 1394.925

TELCO_ROLES = ColumnRoles(
    id="customerID",
    target="Churn",
    categoricals=tuple(TELCO_DOMAINS),
    numerics=("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"),
    senior="SeniorCitizen",
    tenure="tenure",
    revenue="MonthlyCharges",
    lifetime="TotalCharges",
    contract="Contract",
    service="InternetService",
    payment="PaymentMethod",
    support="TechSupport",
    security="OnlineSecurity",
    addons=(
        "OnlineSecurity",
        "OnlineBackup",
        "DeviceProtection",
        "TechSupport",
        "StreamingTV",
        "StreamingMovies",
    ),
)

TELCO_CONTRACT = ContractSpec(
    required=TELCO_ROLES.features,
    flags=("SeniorCitizen",),
    numerics=("tenure", "MonthlyCharges", "TotalCharges"),
    domains=TELCO_DOMAINS,
    imputed={"TotalCharges": TOTAL_CHARGES_MEDIAN},
)

TELCO_RULES = RuleBook(
    flexible_contract="Month-to-month",
    risky_service="Fiber optic",
    friction_payment="Electronic check",
    automatic_payment="Credit card (automatic)",
    high_bill=80.0,
)

TELCO_SCHEMA = T.StructType(
    [T.StructField("customerID", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in TELCO_DOMAINS]
    + [
        T.StructField("SeniorCitizen", T.IntegerType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.StringType()),
        T.StructField("Churn", T.StringType()),
    ]
)
