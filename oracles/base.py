"""Shared common table expressions."""

from __future__ import annotations

from staywise.plans import feed as feed_data
from staywise.plans.mart import ADDON_TYPES, ADDONS, LIFETIME_MEDIAN, MART_DOMAINS, MART_ROLES, MART_RULES

CUT = "DATE '2000-08-01'"
RULES = MART_RULES


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def dbl(value: float) -> str:
    return f"({float(value)!r})::DOUBLE"


def smooth(expression: str, digits: int) -> str:
    """Round a value that is never an exact tie; adding zero turns -0.0 into 0.0."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0::DOUBLE)"


def exact(expression: str, digits: int) -> str:
    """Round a value that may be a decimal tie, half away from zero on its decimal form."""
    return f"(round(CAST(({expression}) AS DECIMAL(38,{digits + 6})), {digits})::DOUBLE + 0::DOUBLE)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return exact(f"coalesce(CASE WHEN ({whole}) <> 0 THEN 100::DOUBLE * ({part}) / ({whole}) END, 0)", digits)


def div(part: str, whole: str, digits: int) -> str:
    return smooth(f"coalesce(CASE WHEN ({whole}) <> 0 THEN ({part})::DOUBLE / ({whole}) END, 0)", digits)


def money(expression: str) -> str:
    return smooth(f"coalesce({expression}, 0)", 2)


_flags = ",\n    ".join(f"max(CASE WHEN p_type = {q(k)} THEN 1 ELSE 0 END) AS {n}" for k, n in zip(ADDON_TYPES, ADDONS))
_addons = ",\n    ".join(f"CASE WHEN f.{n} = 1 THEN 'Yes' ELSE 'No' END AS {n}" for n in ADDONS)

MART = f"""
hist AS (
  SELECT o_custkey,
    sum(CASE WHEN o_orderdate < {CUT} THEN CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS spend,
    count(*) FILTER (WHERE o_orderdate < {CUT}) AS n_before,
    count(*) FILTER (WHERE o_orderdate >= {CUT}) AS n_after,
    min(CASE WHEN o_orderdate < {CUT} THEN CAST(o_orderdate AS DATE) END) AS first_date
  FROM orders GROUP BY o_custkey),
latest AS (
  SELECT o_custkey, o_orderpriority FROM (
    SELECT o_custkey, o_orderpriority,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE o_orderdate < {CUT}) WHERE rn = 1),
bought AS (
  SELECT o_custkey,
    {_flags}
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_orderdate >= DATE '2000-02-01' AND o_orderdate < {CUT} GROUP BY o_custkey),
shaped AS (
  SELECT c.*, r.r_name, h.spend, coalesce(h.n_before, 0) AS n_before, coalesce(h.n_after, 0) AS n_after,
    coalesce(floor(date_diff('day', h.first_date, {CUT}) / 30), 0)::INTEGER AS tenure,
    coalesce(l.o_orderpriority, 'none') AS last_priority,
    {_addons}
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN hist h ON c.c_custkey = h.o_custkey LEFT JOIN latest l ON c.c_custkey = l.o_custkey
  LEFT JOIN bought f ON c.c_custkey = f.o_custkey),
mart AS (
  SELECT c_custkey AS customerID, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS SeniorCitizen,
    r_name AS Region, c_mktsegment AS Segment, tenure,
    CASE WHEN n_before <= 6 THEN 'Month-to-month' WHEN n_before <= 10 THEN 'One year' ELSE 'Two year' END AS Contract,
    last_priority AS PaymentMethod, {', '.join(ADDONS)},
    spend / greatest(1, tenure) AS MonthlyCharges, spend AS TotalCharges,
    CASE WHEN n_after = 0 THEN 'Yes' ELSE 'No' END AS Churn
  FROM shaped)"""

CLEAN = (
    MART
    + f""",
clean AS (
  SELECT customerID, Churn, Region, Segment, Contract, PaymentMethod, {', '.join(ADDONS)}, SeniorCitizen,
    tenure::DOUBLE AS tenure, MonthlyCharges, coalesce(TotalCharges, {dbl(LIFETIME_MEDIAN)}) AS TotalCharges
  FROM mart WHERE MonthlyCharges IS NOT NULL)"""
)


def feature_value(card, feature, get=lambda c: c) -> str:
    if feature.level is None:
        return f"((({get(feature.raw)})::DOUBLE - {dbl(card.means[feature.raw])}) / {dbl(card.deviations[feature.raw])})"
    return f"(CASE WHEN {get(feature.raw)} = {q(feature.level)} THEN 1::DOUBLE ELSE 0::DOUBLE END)"


def margin(card, get=lambda c: c) -> str:
    terms = [dbl(card.intercept)]
    terms += [f"{dbl(card.weights[f.name])} * {feature_value(card, f, get)}" for f in card.features if f.level is None]
    for column in card.levels:
        whens = " ".join(
            f"WHEN {get(column)} = {q(f.level)} THEN {dbl(card.weights[f.name])}" for f in card.features if f.raw == column and f.level
        )
        terms.append(f"(CASE {whens} ELSE 0::DOUBLE END)")
    return " + ".join(terms)


def sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END)"


def scored_cte(card, source: str = "clean", name: str = "scored") -> str:
    return f""",
{name}_m AS (SELECT *, {margin(card)} AS margin FROM {source}),
{name}_p AS (SELECT *, {sigmoid('margin')} AS p FROM {name}_m),
{name} AS (
  SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label, {smooth('100 * p', 2)} AS churn_pct,
    CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END AS prediction,
    CASE WHEN {smooth('100 * p', 2)} <= 30 THEN 'Low Risk' WHEN {smooth('100 * p', 2)} <= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_tier,
    CASE WHEN {smooth('100 * p', 2)} < 30 THEN 'Low Risk' WHEN {smooth('100 * p', 2)} < 60 THEN 'Medium Risk'
         WHEN {smooth('100 * p', 2)} < 80 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_level
  FROM {name}_p)"""


def _fault(value: str, faults: dict, period: int) -> str:
    whens = " ".join(f"WHEN {at} THEN {'NULL' if t is None else q(t)}" for at, t in faults.items())
    return f"CASE customerID % {period} {whens} ELSE {value} END"


_flag = " ".join(
    f"WHEN {at} THEN CASE WHEN SeniorCitizen = 1 THEN {q(yes)} ELSE {q(no)} END"
    for at, (no, yes) in feed_data.FLAG_SPELLINGS.items()
)
_changed = {
    "SeniorCitizen": f"CASE customerID % 8 {_flag} WHEN 7 THEN CASE WHEN customerID % 16 = 7 THEN 'maybe' ELSE '' END ELSE SeniorCitizen::VARCHAR END",
    "tenure": _fault("tenure::VARCHAR", {13: "n/a"}, 50),
    "MonthlyCharges": _fault("floor(MonthlyCharges)::BIGINT::VARCHAR", feed_data.MONTHLY_FAULTS, 40),
    "TotalCharges": _fault("CAST(TotalCharges AS DECIMAL(18,2))::VARCHAR", feed_data.LIFETIME_FAULTS, 25),
    "Contract": _fault("Contract", feed_data.CONTRACT_FAULTS, 60),
    "Segment": _fault("Segment", feed_data.SEGMENT_FAULTS, 70),
    "Churn": _fault("Churn", feed_data.TARGET_FAULTS, 90),
}
FEED = (
    MART
    + ",\nfeed AS (SELECT customerID, "
    + ", ".join(f"{_changed.get(n, n)} AS {n}" for n in [*MART_ROLES.features, "Churn"])
    + " FROM mart)"
)


def parsed(column: str) -> str:
    pattern = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    token = f"trim({column})"
    return (
        f"(CASE WHEN regexp_full_match({token}, {q(pattern)}) THEN try_cast({token} AS DOUBLE)"
        f" WHEN lower({token}) IN ('inf', '+inf', 'infinity', '+infinity') THEN 'inf'::DOUBLE"
        f" WHEN lower({token}) IN ('-inf', '-infinity') THEN '-inf'::DOUBLE END)"
    )


def flag(column: str, wide: bool = True) -> str:
    token = f"lower(trim({column}))"
    zeros = "'0','0.0','no','false','n','f'" if wide else "'0','no'"
    ones = "'1','1.0','yes','true','y','t'" if wide else "'1','yes','true'"
    return f"(CASE WHEN {token} IN ({zeros}) THEN 0 WHEN {token} IN ({ones}) THEN 1 END)"


def in_domain(column: str) -> str:
    return f"{column} IN (" + ", ".join(q(v) for v in MART_DOMAINS[column]) + ")"


# Every broken rule of a feed row as a (feature, rule, value) union.
def findings(source: str = "feed") -> str:
    blank = "(SeniorCitizen IS NULL OR trim(SeniorCitizen) = '')"
    parts = [
        f"SELECT customerID, 'SeniorCitizen' AS feature, 'missing' AS rule, SeniorCitizen AS value FROM {source} WHERE {blank}",
        f"SELECT customerID, 'SeniorCitizen', 'unknown_value', SeniorCitizen FROM {source} WHERE NOT {blank} AND {flag('SeniorCitizen')} IS NULL",
    ]
    for column in ("tenure", "MonthlyCharges"):
        parts.append(f"SELECT customerID, {q(column)}, 'missing', {column} FROM {source} WHERE {parsed(column)} IS NULL")
    for column in ("tenure", "MonthlyCharges", "TotalCharges"):
        parts.append(f"SELECT customerID, {q(column)}, 'infinite', {column} FROM {source} WHERE isinf({parsed(column)})")
    for column in MART_DOMAINS:
        parts.append(f"SELECT customerID, {q(column)}, 'missing', {column} FROM {source} WHERE {column} IS NULL")
        parts.append(f"SELECT customerID, {q(column)}, 'unknown_value', {column} FROM {source} WHERE NOT {in_domain(column)}")
    return "\n UNION ALL ".join(parts)


FEED_FOUND = FEED + f",\nfound AS ({findings()}),\nbad AS (SELECT DISTINCT customerID FROM found)"

FEED_ACCEPTED = (
    FEED_FOUND
    + f""",
taken AS (
  SELECT customerID, Churn, Region, Segment, Contract, PaymentMethod, {', '.join(ADDONS)},
    {flag('SeniorCitizen')} AS SeniorCitizen, {parsed('tenure')} AS tenure, {parsed('MonthlyCharges')} AS MonthlyCharges,
    coalesce({parsed('TotalCharges')}, {dbl(LIFETIME_MEDIAN)}) AS TotalCharges
  FROM feed WHERE customerID NOT IN (SELECT customerID FROM bad))"""
)

SPLIT_ORDER = "md5(customerID::VARCHAR || ':42'), customerID"
SAMPLE_ORDER = "md5(customerID::VARCHAR || ':42:sample'), customerID"

SPLIT = (
    MART
    + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY {SPLIT_ORDER}) AS rn,
    count(*) OVER (PARTITION BY Churn) AS size FROM mart),
split AS (SELECT *, rn <= round(0.2::DOUBLE * size) AS is_test FROM placed),
train AS (SELECT * FROM split WHERE NOT is_test)"""
)


def background_cte(card, source: str = "clean") -> str:
    means = ", ".join(f"avg({feature_value(card, f)}) AS m{i}" for i, f in enumerate(card.features))
    base = " + ".join(f"{dbl(card.weights[f.name])} * m{i}" for i, f in enumerate(card.features))
    return f""",
sampled AS (SELECT * FROM {source} ORDER BY {SAMPLE_ORDER} LIMIT 200),
means AS (SELECT {means} FROM sampled),
base AS (SELECT {dbl(card.intercept)} + {base} AS base FROM means)"""


def contribution_rows(card, source: str = "clean", get=lambda c: c, keys: str = "customerID", name: str = "phi") -> str:
    parts = [
        f"SELECT {keys}, {q(f.name)} AS feature, {q(f.label)} AS label, {q(f.raw)} AS raw_feature, {feature_value(card, f, get)} AS x,"
        f" {dbl(card.weights[f.name])} * ({feature_value(card, f, get)} - m{i}) AS {name} FROM {source}, means"
        for i, f in enumerate(card.features)
    ]
    return "\n UNION ALL ".join(parts)


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().lstrip(',')}\n{body}"
