"""Literal telecom records used across the tests."""

from staywise.telco import TELCO_ROLES

COLUMNS = (
    "customerID gender SeniorCitizen Partner Dependents tenure PhoneService MultipleLines InternetService "
    "OnlineSecurity OnlineBackup DeviceProtection TechSupport StreamingTV StreamingMovies Contract "
    "PaperlessBilling PaymentMethod MonthlyCharges TotalCharges"
).split()

# Own records: every service level and contract, each payment method, no and long tenure.
SAMPLE = """\
C-0001,Male,1,No,No,3,Yes,No,Fiber optic,No,No,No,No,No,No,Month-to-month,Yes,Electronic check,74.15,222.45
C-0002,Female,0,Yes,Yes,61,Yes,Yes,DSL,Yes,Yes,Yes,Yes,No,No,Two year,No,Bank transfer (automatic),64.5,3934.5
C-0003,Female,0,No,Yes,18,Yes,No,No,No internet service,No internet service,No internet service,No internet service,No internet service,No internet service,One year,No,Mailed check,20.05,360.9
C-0004,Male,0,Yes,No,0,No,No phone service,DSL,No,No,No,No,Yes,Yes,Month-to-month,Yes,Credit card (automatic),45.3,45.3
C-0005,Female,1,Yes,No,27,Yes,Yes,Fiber optic,Yes,No,No,Yes,Yes,No,One year,Yes,Electronic check,95.6,2581.2
C-0006,Male,0,No,No,72,Yes,Yes,Fiber optic,Yes,Yes,Yes,Yes,Yes,Yes,Two year,Yes,Bank transfer (automatic),116.8,8409.6
C-0007,Male,0,No,No,9,Yes,No,DSL,No,Yes,No,No,No,Yes,Month-to-month,No,Electronic check,58.9,530.1
C-0008,Female,1,No,No,14,Yes,Yes,Fiber optic,No,No,Yes,No,Yes,Yes,Month-to-month,Yes,Electronic check,101.25,1417.5"""

ROWS = [dict(zip(COLUMNS, line.split(","))) for line in SAMPLE.splitlines()]
BASE = ROWS[1]


def text_frame(spark, rows, columns=None):
    names = columns or COLUMNS
    schema = ", ".join(f"`{name}` string" for name in names)
    return spark.createDataFrame([tuple(None if row[n] is None else str(row[n]) for n in names) for row in rows], schema)


def mutated(changes):
    """One copy of the base record per (column, value), with its own id."""
    return [{**BASE, "customerID": f"case-{i}", column: value} for i, (column, value) in enumerate(changes)]


ROLES = TELCO_ROLES
