"""One SQL statement per job."""

from __future__ import annotations

from math import factorial

from oracles.base import (
    CLEAN,
    FEED,
    FEED_ACCEPTED,
    FEED_FOUND,
    MART,
    RULES,
    SAMPLE_ORDER,
    SPLIT,
    background_cte,
    contribution_rows,
    dbl,
    div,
    exact,
    feature_value,
    flag,
    in_domain,
    margin,
    money,
    parsed,
    pct,
    q,
    scored_cte,
    sigmoid,
    smooth,
    with_,
)
from staywise.plans import catalog
from staywise.functions.expressions import FLAG_ALIASES
from staywise.plans.mart import ADDONS, LIFETIME_MEDIAN, MART_DOMAINS, MART_ROLES, NARROW_ALIASES
from staywise.plans.scorecards import ARCHETYPES, SCENARIOS, SCORECARD_V1, SCORECARD_V2

NUMERICS = MART_ROLES.numerics
CATEGORIES = MART_ROLES.categoricals
SCORED = CLEAN + scored_cte(SCORECARD_V1)
BOTH = (
    CLEAN
    + f""",
both_m AS (SELECT *, {margin(SCORECARD_V1)} AS z1, {margin(SCORECARD_V2)} AS z2 FROM clean),
both_p AS (SELECT *, {sigmoid('z1')} AS p1, {sigmoid('z2')} AS p2 FROM both_m),
versions AS (SELECT *, CASE WHEN p1 >= 0.5 THEN 'Yes' ELSE 'No' END AS l1, CASE WHEN p2 >= 0.5 THEN 'Yes' ELSE 'No' END AS l2,
  CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM both_p)"""
)
BY_MODEL = (
    BOTH
    + """,
model_rows AS (SELECT 'scorecard_v1' AS model, label, p1 AS s FROM versions
  UNION ALL SELECT 'scorecard_v2', label, p2 FROM versions)"""
)


def union(parts) -> str:
    return "\n UNION ALL ".join(parts)


def levels_of(columns, source: str = "mart") -> str:
    return union(f"SELECT {q(c)} AS feature, {c} AS level, Churn FROM {source}" for c in columns)


def values_of(columns, keys: str = "", source: str = "mart") -> str:
    return union(f"SELECT {keys}{q(c)} AS feature, {c}::DOUBLE AS v FROM {source} WHERE {c} IS NOT NULL" for c in columns)


CHURN_RATE = pct("sum(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END)", "count(*)")
CHURNED = "(sum(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END))::BIGINT"


def signals(segments: dict[str, str], extra: str = "") -> str:
    return with_(
        MART,
        union(
            f"""SELECT {q(name)} AS segment, count(*) FILTER (WHERE {test}) AS customers,
  count(*) FILTER (WHERE ({test}) AND Churn = 'Yes') AS churned,
  {pct(f"count(*) FILTER (WHERE ({test}) AND Churn = 'Yes')", f"count(*) FILTER (WHERE {test})")} AS churn_rate_pct,
  {money(f'sum(CASE WHEN {test} THEN MonthlyCharges END)')} AS mrr{extra.replace('@', q(name)).replace('#', f'sum(CASE WHEN {test} THEN MonthlyCharges END)')}
FROM mart"""
            for name, test in segments.items()
        ),
    )


FLEX = f"Contract = {q(RULES.flexible_contract)}"
RISKY = f"Segment = {q(RULES.risky_service)}"
FRICTION = f"PaymentMethod = {q(RULES.friction_payment)}"


def histogram(column: str, width: float) -> str:
    bucket = f"floor({column}::DOUBLE / {dbl(width)})::BIGINT"
    return with_(
        MART,
        f"""SELECT Churn, {bucket} AS bucket, {bucket} * {dbl(width)} AS lower, ({bucket} + 1) * {dbl(width)} AS upper, count(*) AS n
FROM mart WHERE {column} IS NOT NULL GROUP BY Churn, {bucket}""",
    )


def box(columns, keys: list[str]) -> str:
    names = ", ".join(keys)
    match = " AND ".join(f"v.{k} = b.{k}" for k in [*keys, "feature"])
    return with_(
        MART
        + f""",
vals AS ({values_of(columns, names + ', ')}),
b AS (SELECT {names}, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
  FROM vals GROUP BY {names}, feature),
fenced AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)""",
        f"""SELECT {', '.join('v.' + k for k in keys)}, v.feature, count(*) AS n, {smooth('min(v.v)', 6)} AS min, {smooth('any_value(q1)', 6)} AS p25,
  {smooth('any_value(q2)', 6)} AS median, {smooth('any_value(q3)', 6)} AS p75, {smooth('max(v.v)', 6)} AS max,
  {smooth('any_value(lo)', 6)} AS low_fence, {smooth('any_value(hi)', 6)} AS high_fence,
  count(*) FILTER (WHERE v.v < lo OR v.v > hi) AS outliers
FROM vals v JOIN fenced b ON {match} GROUP BY {', '.join('v.' + k for k in keys)}, v.feature""",
    )


def pearson() -> str:
    columns = {c: c for c in NUMERICS} | {"churn": "(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END)"}
    return with_(
        MART,
        union(
            f"SELECT {q(x)} AS x, {q(y)} AS y, {smooth(f'corr(({a})::DOUBLE, ({b})::DOUBLE)', 3)} AS r FROM mart"
            for x, a in columns.items()
            for y, b in columns.items()
        ),
    )


def rates(tp: str, fp: str, tn: str, fn: str) -> str:
    return f"""{div(f'{tp} + {tn}', f'{tp} + {fp} + {tn} + {fn}', 9)} AS accuracy, {div(tp, f'{tp} + {fp}', 9)} AS precision,
  {div(tp, f'{tp} + {fn}', 9)} AS recall, {div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}', 9)} AS f1"""


def sweep_cte(thresholds, source: str = "scored", score: str = "p", by: str = "") -> str:
    listed = ", ".join(f"({dbl(t)})" for t in thresholds)
    return f""",
cuts(threshold) AS (VALUES {listed}),
counted AS (SELECT {by}threshold, count(*) FILTER (WHERE {score} >= threshold AND label = 1) AS tp,
  count(*) FILTER (WHERE {score} >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE {score} < threshold AND label = 0) AS tn,
  count(*) FILTER (WHERE {score} < threshold AND label = 1) AS fn
  FROM {source} CROSS JOIN cuts GROUP BY {by}threshold),
sweep AS (SELECT {by}threshold, {rates('tp', 'fp', 'tn', 'fn')}, tp, fp, tn, fn,
  tp + fp AS n_predicted_positive, tn + fn AS n_predicted_negative FROM counted)"""


GRID = [i / 100 for i in range(10, 95, 5)]

STEPS = """,
tot AS (SELECT sum(label)::BIGINT AS np, (count(*) - sum(label))::BIGINT AS nn FROM scored),
dist AS (SELECT p AS s, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM scored GROUP BY p),
steps AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM dist)"""


def ranking(source: str, score: str, by: str = "", label: str = "label") -> str:
    part = f"PARTITION BY {by[:-2]} " if by else ""
    group = f"GROUP BY {by[:-2]}" if by else ""
    join = f"USING ({by[:-2]})" if by else "ON TRUE"
    return f""",
ranked AS (SELECT {by}{label} AS y, rank() OVER ({part}ORDER BY {score})
  + (count(*) OVER (PARTITION BY {by}{score}) - 1) / 2.0::DOUBLE AS r FROM {source}),
auc AS (SELECT {by}sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives,
  CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
    / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS a FROM ranked {group}),
points AS (SELECT {by}{score} AS s, sum({label}) AS pos, count(*) AS n FROM {source} GROUP BY {by}{score}),
climb AS (SELECT {by}pos, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part}ORDER BY s DESC) AS called FROM points),
ap AS (SELECT {by}sum(pos * tp::DOUBLE / called) AS g, sum(pos) AS np FROM climb {group}),
ranking AS (SELECT {by}positives, negatives, {smooth('a', 9)} AS roc_auc,
  {smooth('coalesce(CASE WHEN np > 0 THEN g / np END, 0)', 9)} AS pr_auc FROM auc JOIN ap {join})"""


CALIBRATION_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
BIN = "(" + " + ".join(f"(CASE WHEN p >= {dbl(e)} THEN 1 ELSE 0 END)" for e in CALIBRATION_EDGES[1:]) + ")"

CALIBRATION = (
    f""",
binned AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(label::DOUBLE) AS rate FROM scored GROUP BY 1),
calibration AS (SELECT b.i::INTEGER AS bin, {smooth('b.i / 10.0::DOUBLE', 12)} AS lower, {smooth('(b.i + 1) / 10.0::DOUBLE', 12)} AS upper,
  coalesce(n, 0)::BIGINT AS count, {smooth('mp', 9)} AS mean_predicted_probability, {smooth('rate', 9)} AS observed_churn_rate,
  {smooth('mp - rate', 9)} AS calibration_gap FROM range(10) b(i) LEFT JOIN binned ON binned.bin = b.i),
calibration_summary AS (SELECT (SELECT count(*) FROM scored) AS n,
  (SELECT {smooth('avg((p - label) * (p - label))', 9)} FROM scored) AS brier_score,
  (SELECT {smooth('avg(p)', 9)} FROM scored) AS overall_mean_predicted_probability,
  (SELECT {smooth('avg(label::DOUBLE)', 9)} FROM scored) AS overall_observed_churn_rate,
  (SELECT {smooth('avg(abs(mp - rate))', 9)} FROM binned) AS mean_absolute_calibration_gap)"""
)


def recall_rows(floors) -> str:
    parts = []
    for floor in floors:
        best = f"(SELECT * FROM sweep WHERE precision >= {dbl(floor)} ORDER BY recall DESC, f1 DESC, threshold LIMIT 1)"
        near = "(SELECT * FROM sweep ORDER BY precision DESC, threshold LIMIT 1)"
        parts.append(
            f"""SELECT {dbl(floor)} AS min_precision, b.threshold IS NOT NULL AS found, b.threshold, b.precision, b.recall, b.f1,
  CASE WHEN b.threshold IS NULL THEN x.precision END AS max_precision, CASE WHEN b.threshold IS NULL THEN x.threshold END AS max_precision_threshold
FROM {near} x LEFT JOIN {best} b ON TRUE"""
        )
    return union(parts)


def unpivoted(table: str, section: str, item: str | None, columns) -> str:
    place = "NULL::DOUBLE" if item is None else f"{item}::DOUBLE"
    return union(
        f"SELECT {q(section)} AS section, {place} AS item, {q(c)} AS metric, CAST({c} AS DOUBLE) AS value FROM {table}" for c in columns
    )


def report() -> str:
    sweep_columns = ["accuracy", "precision", "recall", "f1", "tp", "fp", "tn", "fn", "n_predicted_positive", "n_predicted_negative"]
    ctes = (
        SCORED
        + sweep_cte(GRID)
        + ranking("scored", "p")
        + CALIBRATION
        + f""",
split_all AS (SELECT count(*) AS n_total, count(*) FILTER (WHERE label = 1) AS n_actual_positive,
  count(*) FILTER (WHERE label = 0) AS n_actual_negative, {smooth('avg(label::DOUBLE)', 9)} AS observed_positive_rate FROM scored),
f1_best AS (SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1),
recalls AS ({recall_rows([0.6, 0.65, 0.7])})"""
    )
    return with_(
        ctes,
        union(
            [
                unpivoted("split_all", "split", None, ["n_total", "n_actual_positive", "n_actual_negative", "observed_positive_rate"]),
                unpivoted("sweep", "sweep", "threshold", sweep_columns),
                unpivoted("ranking", "ranking", None, ["positives", "negatives", "roc_auc", "pr_auc"]),
                unpivoted("f1_best", "f1_maximizing", None, ["threshold", "f1", "precision", "recall", "accuracy"]),
                unpivoted(
                    "recalls", "recall_at_precision", "min_precision",
                    ["found", "threshold", "precision", "recall", "f1", "max_precision", "max_precision_threshold"],
                ),
                unpivoted(
                    "calibration", "calibration", "bin",
                    ["lower", "upper", "count", "mean_predicted_probability", "observed_churn_rate", "calibration_gap"],
                ),
                unpivoted(
                    "calibration_summary", "calibration_summary", None,
                    ["n", "brier_score", "overall_mean_predicted_probability", "overall_observed_churn_rate", "mean_absolute_calibration_gap"],
                ),
            ]
        ),
    )


def model_metrics() -> str:
    return (
        BY_MODEL
        + ranking("model_rows", "s", "model, ")
        + sweep_cte([0.5], "model_rows", "s", "model, ")
        + """,
metrics AS (SELECT model, roc_auc, pr_auc, accuracy, precision, recall, f1 FROM ranking JOIN sweep USING (model))"""
    )


MEASURES = ["roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1"]


def indicator_totals(card) -> str:
    return with_(
        CLEAN,
        union(
            f"SELECT {q(f.name)} AS feature, {q(f.raw)} AS raw_feature, {q(f.level)} AS level, {q(f.label)} AS label, count(*) AS rows,"
            f" count(*) FILTER (WHERE {f.raw} = {q(f.level)})::DOUBLE AS total FROM clean"
            for f in card.features
            if f.level is not None
        ),
    )


def action_rows() -> list[tuple[int, str, str, str]]:
    return [
        (1, FLEX, "Contract Upgrade Incentive", "HIGH"),
        (2, f"{RISKY} AND addon_promo = 'No'", "Complimentary Premium Tech Support", "HIGH"),
        (3, FRICTION, "Autopay / Credit Card Migration", "MEDIUM"),
        (4, f"MonthlyCharges > {dbl(RULES.high_bill)}", "Plan Right-Sizing Review", "MEDIUM"),
    ]


def actions_cte(source: str = "scored") -> str:
    fired = union(
        f"SELECT customerID, risk_level, {rank} AS place, {q(action)} AS action, {q(priority)} AS priority FROM {source} WHERE {test}"
        for rank, test, action, priority in action_rows()
    )
    return f""",
fired AS ({fired}),
acts AS (SELECT * FROM fired UNION ALL SELECT customerID, risk_level, 9, 'Loyalty Appreciation', 'LOW' FROM {source}
  WHERE customerID NOT IN (SELECT customerID FROM fired))"""


BEST_ACTIONS = [
    (FLEX, "Offer 1-Year Contract Lock-in"),
    ("addon_promo <> 'Yes' OR addon_economy <> 'Yes'", "Bundle Cyber-Care Package"),
    (FRICTION, "Incentivize Auto-Pay"),
    (f"tenure <= {RULES.early_tenure}", "First-90-Day Concierge Outreach"),
]


def state_of(scenario):
    """Column expressions after a scenario, from the untouched row."""
    bill = f"greatest({dbl(RULES.bill_floor)}, MonthlyCharges - {dbl(scenario.credit)})"
    changed = {"MonthlyCharges": bill, "TotalCharges": f"({bill} * greatest(1, tenure::INTEGER))"}
    if scenario.contract:
        changed["Contract"] = q(scenario.contract)
    if scenario.add_protection:
        changed["addon_promo"] = changed["addon_economy"] = "'Yes'"
    if scenario.automatic_payment:
        changed["PaymentMethod"] = q(RULES.automatic_payment)
    return lambda c: changed.get(c, c)


def what_if_cte() -> str:
    start = state_of(SCENARIOS[0])
    rows = union(
        f"SELECT customerID, {q(s.name)} AS scenario, {margin(SCORECARD_V1, start)} AS z0, {margin(SCORECARD_V1, state_of(s))} AS z1 FROM clean"
        for s in SCENARIOS
    )
    return (
        CLEAN
        + f""",
zs AS ({rows}),
ps AS (SELECT customerID, scenario, {sigmoid('z0')} AS p0, {sigmoid('z1')} AS p1 FROM zs),
outcomes AS (SELECT customerID, scenario, {smooth('p0', 6)} AS baseline_probability, {smooth('p1', 6)} AS simulated_probability,
  {smooth('100 * (p1 - p0)', 4)} AS delta_points, {smooth('greatest(-(100 * (p1 - p0)), 0)', 4)} AS reduction_points FROM ps)"""
    )


def scenario_deltas() -> str:
    start = state_of(SCENARIOS[0])
    parts = []
    for s in SCENARIOS[1:]:
        after = state_of(s)
        for i, f in enumerate(SCORECARD_V1.features):
            w = dbl(SCORECARD_V1.weights[f.name])
            old = f"{w} * ({feature_value(SCORECARD_V1, f, start)} - m{i})"
            new = f"{w} * ({feature_value(SCORECARD_V1, f, after)} - m{i})"
            parts.append(
                f"SELECT customerID, {q(s.name)} AS scenario, {q(f.name)} AS feature, {q(f.raw)} AS raw_feature, {old} AS o, {new} AS n FROM clean, means"
            )
    return with_(
        CLEAN
        + background_cte(SCORECARD_V1)
        + f""",
changes AS ({union(parts)}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY customerID, scenario ORDER BY abs(n - o) DESC, feature) AS rank FROM changes)""",
        f"""SELECT customerID, scenario, rank, feature, raw_feature, {smooth('o', 9)} AS baseline_contribution, {smooth('n', 9)} AS simulated_contribution,
  {smooth('n - o', 9)} AS delta, {smooth('abs(n - o)', 9)} AS abs_delta FROM ordered WHERE rank <= 5""",
    )


def archetypes() -> str:
    rows = union(
        "SELECT " + q(name) + " AS archetype, "
        + margin(SCORECARD_V1, lambda c, p=profile: q(p[c]) if isinstance(p[c], str) else str(p[c]))
        + " AS z"
        for name, profile in ARCHETYPES.items()
    )
    return with_(
        SCORED + f", named AS ({rows}), own AS (SELECT archetype, {sigmoid('z')} AS own FROM named)",
        f"""SELECT archetype, {smooth('100 * any_value(own)', 2)} AS churn_pct, count(*) AS customers,
  count(*) FILTER (WHERE p < own) AS customers_below, {pct('count(*) FILTER (WHERE p < own)', 'count(*)')} AS percentile
FROM scored CROSS JOIN own GROUP BY archetype""",
    )


def contract_declared() -> str:
    """Items of both versions' contract and encoder with the subscribers they concern, one aggregate over the mart."""
    sides: list[set] = []
    for aliases, card in ((FLAG_ALIASES, SCORECARD_V1), (NARROW_ALIASES, SCORECARD_V2)):
        features = MART_ROLES.categoricals + MART_ROLES.numerics
        items = {("required", c, "*", f"{c} IS NOT NULL") for c in features}
        items |= {("flag", "SeniorCitizen", "*", "SeniorCitizen IS NOT NULL"), ("imputed", "TotalCharges", repr(float(LIFETIME_MEDIAN)), "TotalCharges IS NOT NULL")}
        items |= {("numeric", c, "*", f"{c} IS NOT NULL") for c in ("tenure", "MonthlyCharges", "TotalCharges")}
        items |= {("category", c, "*", f"{c} IS NOT NULL") for c in MART_DOMAINS}
        items |= {("alias", "SeniorCitizen", f"{k}={v}", f"SeniorCitizen::VARCHAR = {q(k)}") for k, v in aliases.items()}
        items |= {("level", c, level, f"{c} = {q(level)}") for c, levels in MART_DOMAINS.items() for level in levels}
        items |= {("encoded level", f.raw, f.level, f"{f.raw}::VARCHAR = {q(f.level)}") for f in card.features if f.level is not None}
        items |= {("scaling", c, f"{float(card.means[c])}, {float(card.deviations[c])}", f"{c} IS NOT NULL") for c in NUMERICS}
        items |= {("setting", None, f"drop_first={card.drop_first}", "TRUE"), ("setting", None, f"threshold={float(card.threshold)}", "TRUE")}
        sides.append(items)
    cells = ", ".join(
        f"{{'section': {q(section)}, 'feature': {q(c) if c else 'NULL::VARCHAR'}, 'item': {q(item)}, 'in_v1': {row in sides[0]},"
        f" 'in_v2': {row in sides[1]}, 'records': count(*) FILTER (WHERE {test})}}"
        for row in sorted(sides[0] | sides[1], key=str)
        for section, c, item, test in [row]
    )
    return with_(MART, f"SELECT unnest(items, recursive := true) FROM (SELECT [{cells}] AS items FROM mart)")


def contract_probes() -> str:
    """Fourteen probes of every record against the wide and the narrow contract."""
    mutations = {
        "reordered_columns": {}, "extra_column": {}, "absent_column": {"tenure": "NULL::VARCHAR"},
        "flag_text_1": {"SeniorCitizen": "'1'"}, "flag_text_yes": {"SeniorCitizen": "'Yes'"},
        "flag_text_no": {"SeniorCitizen": "'No'"}, "flag_text_false": {"SeniorCitizen": "'false'"},
        "imputed_missing": {"TotalCharges": "NULL::VARCHAR"}, "imputed_text": {"TotalCharges": "'640.25'"},
        "imputed_infinite": {"TotalCharges": "'inf'"}, "measured_missing": {"MonthlyCharges": "NULL::VARCHAR"},
        "category_missing": {"Contract": "NULL::VARCHAR"}, "category_unknown": {"Contract": "'Five year'"},
        "category_case_typo": {"Contract": "'TWO YEAR'"},
    }
    texts = {"MonthlyCharges": "floor(MonthlyCharges)::BIGINT::VARCHAR", "TotalCharges": "CAST(TotalCharges AS DECIMAL(18,2))::VARCHAR"}
    parts = []
    for name, change in mutations.items():
        columns = ", ".join(f"{change.get(c, texts.get(c, c + '::VARCHAR'))} AS {c}" for c in MART_ROLES.features)
        parts.append(f"SELECT {q(name)} AS probe, {columns} FROM mart")
    rest = " AND ".join(
        [f"{parsed(c)} IS NOT NULL AND NOT isinf({parsed(c)})" for c in ("tenure", "MonthlyCharges")]
        + [f"NOT coalesce(isinf({parsed('TotalCharges')}), FALSE)"]
        + [f"coalesce({in_domain(c)}, FALSE)" for c in MART_DOMAINS]
    )
    return with_(
        MART
        + f""",
cases AS ({union(parts)}),
judged AS (SELECT probe, ({flag('SeniorCitizen')} IS NOT NULL AND {rest}) AS ok1, ({flag('SeniorCitizen', False)} IS NOT NULL AND {rest}) AS ok2 FROM cases)""",
        """SELECT probe, count(*) AS records, count(*) FILTER (WHERE ok1) AS v1_accepted, count(*) FILTER (WHERE ok2) AS v2_accepted,
  count(*) FILTER (WHERE ok1 <> ok2) AS decided_differently, CASE WHEN count(*) FILTER (WHERE ok1 <> ok2) = 0 THEN 'SAME' ELSE 'DIFFERENT' END AS status
FROM judged GROUP BY probe""",
    )


def expected_value(tree, node: int, known: frozenset, columns) -> str:
    """Conditional expectation of a tree when only the known features are observed."""
    n = tree.nodes[node]
    if n.is_leaf:
        return dbl(n.value)
    left, right = expected_value(tree, n.left, known, columns), expected_value(tree, n.right, known, columns)
    if n.feature in known:
        return f"(CASE WHEN {columns[n.feature]} <= {dbl(n.threshold)} THEN {left} ELSE {right} END)"
    share = tree.nodes[n.left].cover / n.cover
    return f"({dbl(share)} * {left} + {dbl(tree.nodes[n.right].cover / n.cover)} * {right})"


def shapley_columns(columns: list[str]) -> list[str]:
    """Average marginal effect of each input over all subsets of the others, tree by tree."""
    everyone = range(len(columns))
    selected = []
    for j in everyone:
        others = [k for k in everyone if k != j]
        terms = []
        for bits in range(2 ** len(others)):
            subset = frozenset(k for i, k in enumerate(others) if bits >> i & 1)
            size = len(subset)
            weight = factorial(size) * factorial(len(columns) - size - 1) / factorial(len(columns))
            for tree in catalog.FIXED_TREES:
                terms.append(
                    f"{dbl(weight * tree.weight)} * ({expected_value(tree, 0, subset | {j}, columns)} - {expected_value(tree, 0, subset, columns)})"
                )
        selected.append(smooth(" + ".join(terms), 9))
    return selected


FROZEN = [f"{c}::DOUBLE" for c in catalog.FIXED_INPUTS]


def frozen_value(known: frozenset) -> str:
    return " + ".join(f"{dbl(tree.weight)} * {expected_value(tree, 0, known, FROZEN)}" for tree in catalog.FIXED_TREES)


def brute_force_shapley() -> str:
    selected = [f"{phi} AS phi_{name}" for phi, name in zip(shapley_columns(FROZEN), catalog.FIXED_INPUTS)]
    return with_(CLEAN, f"SELECT customerID, {', '.join(selected)} FROM clean")


def ranked_shapley() -> str:
    cells = union(
        f"SELECT customerID, {q(name)} AS feature, {smooth(value, 8)} AS value, {phi} AS contribution FROM clean"
        for name, value, phi in zip(catalog.FIXED_INPUTS, FROZEN, shapley_columns(FROZEN))
    )
    return with_(
        CLEAN + f", cells AS ({cells}), ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(contribution) DESC, feature) AS rank FROM cells)",
        "SELECT customerID, rank, feature, value, contribution FROM ranked WHERE rank <= 2",
    )


def shapley_change() -> str:
    later = ["(tenure + 12)::DOUBLE" if c == "tenure" else f"{c}::DOUBLE" for c in catalog.FIXED_INPUTS]
    cells = union(
        f"SELECT customerID, {q(name)} AS feature, {smooth(f'{new} - {old}', 9)} AS delta FROM clean"
        for name, old, new in zip(catalog.FIXED_INPUTS, shapley_columns(FROZEN), shapley_columns(later))
    )
    return with_(
        CLEAN + f", cells AS ({cells}), ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(delta) DESC, feature) AS rank FROM cells)",
        "SELECT customerID, feature, delta FROM ranked WHERE rank = 1",
    )


def direction(card) -> str:
    parts = []
    for i, f in enumerate(card.features):
        x = feature_value(card, f)
        phi = f"{dbl(card.weights[f.name])} * ({x} - m{i})"
        binary = f"(min({x}) = 0 AND max({x}) = 1 AND count(*) FILTER (WHERE {x} NOT IN (0, 1)) = 0)"
        if f.level is None:
            limit = f"(SELECT median({x}) FROM clean)"
            other = f"avg(CASE WHEN {x} > {limit} THEN {phi} END)"
        else:
            other = f"CASE WHEN max({x}) = min({x}) THEN 0 ELSE avg(CASE WHEN {x} > 0 THEN {phi} END) END"
        parts.append(
            f"SELECT {q(f.name)} AS feature, coalesce(CASE WHEN {binary} THEN avg(CASE WHEN {x} = 1 THEN {phi} END) ELSE {other} END, 0) AS e FROM clean, means"
        )
    return with_(
        CLEAN + background_cte(card) + f", effects AS ({union(parts)})",
        f"SELECT feature, {smooth('e', 9)} AS active_effect, CASE WHEN e > 0 THEN 'increases churn' ELSE 'decreases churn' END AS direction FROM effects",
    )


def importance(source: str) -> str:
    rows = contribution_rows(SCORECARD_V1, source)
    return with_(
        CLEAN + background_cte(SCORECARD_V1) + f", phis AS ({rows})",
        f"SELECT feature, label, {smooth('avg(abs(phi))', 9)} AS mean_abs_contribution FROM phis GROUP BY feature, label",
    )


PHIS = CLEAN + background_cte(SCORECARD_V1) + f", phis AS ({contribution_rows(SCORECARD_V1)})"

COMPARISON = f"""SELECT customerID, {smooth('p1', 6)} AS v1_probability, {smooth('p2', 6)} AS v2_probability,
  {smooth('abs(p1 - p2)', 6)} AS absolute_probability_difference, l1 AS v1_label, l2 AS v2_label, l1 = l2 AS labels_agree, Churn AS true_label"""

REASONS = "SELECT customerID, string_agg(feature || ':' || rule, '|' ORDER BY feature || ':' || rule) AS reasons FROM found GROUP BY customerID"


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    sql = s.__setitem__

    # --- sources and sinks
    sql("subscriber_table", with_(MART, f"SELECT * REPLACE ({smooth('MonthlyCharges', 8)} AS MonthlyCharges) FROM mart"))
    sql(
        "csv_scan_imputed",
        with_(
            MART
            + """,
file AS (SELECT customerID, Contract, tenure, Churn, CASE WHEN customerID % 25 IN (3, 4) THEN NULL ELSE TotalCharges END AS t FROM mart),
middle AS (SELECT median(t) AS m FROM file)""",
            f"SELECT customerID, Contract, tenure, {smooth('coalesce(t, m)', 4)} AS TotalCharges, Churn FROM file, middle",
        ),
    )
    taken = f"customerID, Region, Segment, Contract, PaymentMethod, {', '.join(ADDONS)}, SeniorCitizen, tenure, MonthlyCharges, TotalCharges"
    sql("csv_upload_checked", with_(FEED_ACCEPTED, f"SELECT {taken} FROM taken"))
    sql("contract_accepted", s["csv_upload_checked"])
    sql("json_lines_scan", with_(MART, f"SELECT Contract, Segment, count(*) AS records, {smooth('sum(TotalCharges)', 2)} AS lifetime FROM mart GROUP BY 1, 2"))
    texts = """, texts AS (SELECT * REPLACE (CASE WHEN customerID % 5 = 0 THEN Segment || ', "new"' || chr(10) || 'unit' ELSE Segment END AS Segment) FROM mart)"""
    sql(
        "json_request_records",
        with_(
            MART + texts,
            "SELECT customerID, Contract, Segment, tenure::VARCHAR AS tenure, CAST(TotalCharges AS DECIMAL(18,2))::VARCHAR AS TotalCharges FROM texts WHERE customerID % 10 <> 4",
        ),
    )
    sql("refused_requests", with_(MART, "SELECT customerID, 'not json ' || customerID AS body, 'unreadable' AS reason FROM mart WHERE customerID % 10 = 4"))
    summary = f"""SELECT count(*) AS total, count(*) FILTER (WHERE prediction = 'Yes') AS predicted_churn,
  count(*) FILTER (WHERE prediction = 'No') AS predicted_retain, {pct("count(*) FILTER (WHERE prediction = 'Yes')", 'count(*)')} AS predicted_churn_pct,
  count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk, count(*) FILTER (WHERE churn_pct >= 60) AS critical_high_risk,
  {smooth('coalesce(avg(p), 0) * 100', 4)} AS mean_churn_pct FROM scored"""
    sql("empty_batch_summary", with_(SCORED, summary + " WHERE Contract = 'Five year'"))
    sql("batch_summary", with_(SCORED, summary))
    inputs = f"SeniorCitizen, Region, Segment, tenure, Contract, PaymentMethod, {', '.join(ADDONS)}, MonthlyCharges, TotalCharges"
    rounded = inputs.replace("MonthlyCharges", f"{smooth('MonthlyCharges', 8)} AS MonthlyCharges")
    sql("upload_template", with_(MART, f"SELECT customerID, {inputs} FROM mart ORDER BY customerID LIMIT 5"))
    sql("filtered_export", with_(MART, f"SELECT customerID, {rounded}, Churn FROM mart WHERE Churn = 'Yes'"))
    sql(
        "scored_export",
        with_(SCORED, f"SELECT customerID, prediction AS Predicted_Churn, churn_pct AS Churn_Probability_Pct, risk_tier AS Risk_Tier, {rounded} FROM scored"),
    )
    sql("threshold_sweep", with_(SCORED + sweep_cte(GRID), "SELECT * FROM sweep"))
    sql("analysis_artifacts", s["threshold_sweep"])
    sql("version_scores", with_(BOTH, COMPARISON + " FROM versions"))
    sql("shadow_export", with_(BOTH, COMPARISON + ", 0.5::DOUBLE AS threshold FROM versions"))
    number = "row_number() OVER (ORDER BY customerID)"
    sql(
        "synthesized_ids",
        with_(MART, f"SELECT customerID, {number} AS row, 'CUST-' || CASE WHEN {number} < 10000 THEN lpad(({number})::VARCHAR, 4, '0') ELSE ({number})::VARCHAR END AS synthetic_id FROM mart"),
    )

    # --- contract
    sql("contract_rejected", with_(FEED_FOUND, REASONS))
    sql("flag_normalised", with_(FEED, f"SELECT lower(trim(SeniorCitizen)) AS token, {flag('SeniorCitizen')} AS flag, count(*) AS records FROM feed GROUP BY 1, 2"))
    sql(
        "missing_value_counts",
        with_(FEED, union(f"SELECT {q(c)} AS feature, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS missing FROM feed" for c in [*MART_ROLES.features, "Churn"])),
    )
    n = parsed("MonthlyCharges")
    sql(
        "numeric_coercion",
        with_(FEED, f"""SELECT customerID, CASE WHEN {n} IS NULL THEN 'missing' WHEN isinf({n}) THEN 'infinite' ELSE 'number' END AS kind,
  CASE WHEN {n} IS NOT NULL AND NOT isinf({n}) THEN {n} END AS value FROM feed"""),
    )
    t = parsed("TotalCharges")
    sql(
        "imputed_lifetime",
        with_(FEED, f"""SELECT customerID, {t} IS NULL AS imputed,
  CASE WHEN {t} IS NULL THEN {dbl(LIFETIME_MEDIAN)} WHEN NOT isinf({t}) THEN {smooth(t, 4)} END AS TotalCharges FROM feed"""),
    )
    sql("missing_measurements", with_(FEED_FOUND, "SELECT customerID, feature, coalesce(value, '') AS value FROM found WHERE rule = 'missing' AND feature IN ('tenure', 'MonthlyCharges')"))
    sql(
        "infinity_report",
        with_(FEED, union(f"SELECT {q(c)} AS feature, count(*) FILTER (WHERE isinf({parsed(c)})) AS infinite FROM feed" for c in ("tenure", "MonthlyCharges", "TotalCharges"))),
    )
    allowed = " ".join(f"WHEN {q(c)} THEN {q(', '.join(v))}" for c, v in MART_DOMAINS.items())
    sql(
        "category_bad_values",
        with_(FEED_FOUND, f"""SELECT feature, value, count(*) AS records, CASE feature {allowed} END AS allowed FROM found
WHERE rule = 'unknown_value' AND feature <> 'SeniorCitizen' GROUP BY feature, value"""),
    )
    sql(
        "strict_batches",
        with_(FEED_FOUND + ", counted AS (SELECT feature, rule, count(*) AS n FROM found GROUP BY 1, 2)", """SELECT 'feed' AS batch, 0::BIGINT AS records,
  (SELECT string_agg(feature || ': ' || rule || ' in ' || n || ' record(s)', '; ' ORDER BY feature, rule) FROM counted) || '; every value is in the report' AS refusal
UNION ALL SELECT 'conforming', (SELECT count(*) FROM feed WHERE customerID NOT IN (SELECT customerID FROM bad)), NULL"""),
    )
    sql(
        "guarded_batches",
        with_(FEED_FOUND + """, counted AS (SELECT feature, rule, count(*) AS n FROM found GROUP BY 1, 2),
sizes AS (SELECT count(*) FILTER (WHERE customerID NOT IN (SELECT customerID FROM bad)) AS good,
  count(*) FILTER (WHERE customerID IN (SELECT customerID FROM bad)) AS refused, (SELECT count(*) FROM found) AS findings,
  (SELECT string_agg(feature || ': ' || rule || ' in ' || n || ' record(s)', '; ' ORDER BY feature, rule) FROM counted) || '; every value is in the report' AS refusal
  FROM feed)""", """SELECT 'feed' AS batch, 'accepted' AS part, good AS counted, good AS written, 0::BIGINT AS findings, refusal FROM sizes
UNION ALL SELECT 'feed', 'refused', refused, refused, findings, refusal FROM sizes
UNION ALL SELECT 'conforming', 'accepted', good, good, 0, NULL FROM sizes
UNION ALL SELECT 'conforming', 'refused', 0, 0, 0, NULL
UNION ALL SELECT 'empty', 'accepted', 0, 0, 0, 'no records provided'
UNION ALL SELECT 'empty', 'refused', 0, 0, 0, 'no records provided'"""),
    )
    needed = "feature <> 'Churn'"
    sql(
        "required_columns",
        f"""SELECT upload, feature, upload <> 'incomplete' OR feature NOT IN ('tenure', 'Contract') AS present,
  CASE WHEN upload <> 'incomplete' OR feature NOT IN ('tenure', 'Contract') THEN missing END AS missing,
  CASE WHEN upload = 'incomplete' THEN 'missing required columns: ' || (SELECT string_agg(feature, ', ' ORDER BY list_position({list(catalog.SPEC.required)!r}, feature)) FROM (VALUES ('tenure'), ('Contract')) AS t(feature)) END AS refusal
FROM ({s['missing_value_counts']}) CROSS JOIN (VALUES ('complete'), ('incomplete'), ('reordered')) AS u(upload) WHERE {needed}""",
    )
    sql("violation_report", with_(FEED_FOUND, "SELECT feature, rule, count(*) AS records FROM found GROUP BY 1, 2"))
    sql(
        "label_encoding",
        with_(FEED, """SELECT Churn AS raw, CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS strict,
  CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS loose, count(*) AS records FROM feed GROUP BY 1, 2, 3"""),
    )
    sql("lifetime_spend_proxy", with_(MART, f"SELECT customerID, {smooth('MonthlyCharges * greatest(1, tenure)', 4)} AS lifetime_proxy FROM mart"))
    member = "Contract IN ('Month-to-month', 'Two year') AND Segment IN ('BUILDING', 'MACHINERY')"
    sql("cohort_members", with_(MART, f"SELECT customerID, Contract, Segment, Churn FROM mart WHERE {member}"))
    sql("cohort_coverage", with_(MART, f"SELECT count(*) FILTER (WHERE {member}) AS selected, count(*) AS total, {pct(f'count(*) FILTER (WHERE {member})', 'count(*)')} AS coverage_pct FROM mart"))
    everything = ["customerID", "Churn", *inputs.split(", ")]
    hit = " OR ".join(f"coalesce(regexp_matches({c}::VARCHAR, {q(catalog.SEARCH_PATTERN)}, 'i'), false)" for c in everything)
    sql("keyword_search", with_(MART, f"SELECT customerID, Segment, PaymentMethod FROM mart WHERE {hit}"))
    sql("search_match_count", with_(MART, f"SELECT count(*) AS matches, count(*) FILTER (WHERE Churn = 'Yes') AS churned_matches FROM mart WHERE {hit}"))
    sql("churned_preview", with_(MART, "SELECT customerID, Region, Segment, Contract, tenure, Churn FROM mart WHERE Churn = 'Yes' ORDER BY customerID LIMIT 100"))
    sql("domain_discovery", with_(MART + f", cells AS ({levels_of(CATEGORIES)})", "SELECT feature, level, count(*) AS n FROM cells WHERE level IS NOT NULL GROUP BY 1, 2"))
    described = [
        (c, "category", "reject", ", ".join(MART_DOMAINS[c]), f"{c} IS NULL", in_domain(c)) for c in CATEGORIES
    ] + [
        ("SeniorCitizen", "flag", "reject", "0, 1", "SeniorCitizen IS NULL", "SeniorCitizen IN (0, 1)"),
        ("tenure", "numeric", "reject", "finite number", "tenure IS NULL", "tenure IS NOT NULL"),
        ("MonthlyCharges", "numeric", "reject", "finite number", "MonthlyCharges IS NULL", "MonthlyCharges IS NOT NULL"),
        ("TotalCharges", "numeric", "impute", "finite number", "TotalCharges IS NULL", "TotalCharges IS NOT NULL"),
    ]
    sql(
        "contract_description",
        with_(MART, union(
            f"SELECT {q(c)} AS feature, {q(role)} AS role, {q(policy)} AS missing_policy, {q(levels)} AS accepted,"
            f" count(*) FILTER (WHERE {gone}) AS missing, count(*) FILTER (WHERE {fits}) AS conforming FROM mart"
            for c, role, policy, levels, gone, fits in described
        )),
    )

    # --- portfolio and profile
    at_risk = "sum(CASE WHEN Churn = 'Yes' THEN MonthlyCharges END)"
    sql(
        "portfolio_kpis",
        with_(MART, f"""SELECT count(*) AS accounts, {CHURNED} AS churned, count(*) FILTER (WHERE Churn = 'No') AS retained, {CHURN_RATE} AS churn_rate_pct,
  {money('sum(MonthlyCharges)')} AS total_mrr, {money('avg(MonthlyCharges)')} AS mean_mrr, {money(at_risk)} AS at_risk_mrr,
  {smooth(f'100 * {at_risk} / sum(MonthlyCharges)', 2)} AS at_risk_mrr_pct, {exact('avg(tenure)', 4)} AS mean_tenure,
  {money('avg(TotalCharges)')} AS mean_lifetime_spend FROM mart"""),
    )
    sql("revenue_by_contract", with_(MART, f"SELECT Contract, Churn, {money('sum(MonthlyCharges)')} AS mrr FROM mart GROUP BY 1, 2"))
    sql(
        "churn_distribution",
        with_(MART, f"""SELECT status, count(Churn) AS customers, {pct('count(Churn)', '(SELECT count(*) FROM mart)')} AS share_pct
FROM (VALUES ('Churned Customers', 'Yes'), ('Retained Customers', 'No')) v(status, code) LEFT JOIN mart ON Churn = code GROUP BY 1"""),
    )
    sql("tenure_histogram", histogram("tenure", 2.0))
    sql("bill_histogram", histogram("MonthlyCharges", 6000.0))
    sql(
        "strategic_signals",
        signals(
            {"flexible_contract": FLEX, "risky_service": RISKY, "friction_payment": FRICTION},
            f", CASE WHEN @ = 'flexible_contract' THEN {exact(money('#') + ' * 0.15::DOUBLE * 12', 2)} END AS annual_saving",
        ),
    )
    sql(
        "revenue_at_risk",
        with_(MART, f"""SELECT count(*) AS customers, {CHURN_RATE} AS churn_rate_pct, {money(at_risk)} AS monthly_revenue_at_risk,
  {money(f'12 * {at_risk}')} AS annual_revenue_at_risk FROM mart"""),
    )
    sql(
        "vulnerability_stats",
        signals(
            {"portfolio": "TRUE", "flexible_contract": FLEX, "risky_service_without_support": f"{RISKY} AND addon_promo = 'No'", "friction_payment": FRICTION},
            f", {exact(money('#') + ' * 12', 2)} AS annual_mrr",
        ),
    )
    sql(
        "playbook_pillars",
        signals({"contract_migration": FLEX, "security_shield": RISKY, "first_90_days": f"tenure <= {RULES.early_tenure}", "autopay_migration": FRICTION}),
    )
    by_category = f"SELECT feature, level, count(*) AS total, {CHURNED} AS churned, {CHURN_RATE} AS churn_rate_pct FROM cells GROUP BY 1, 2"
    sql("churn_by_category", with_(MART + f", cells AS ({levels_of(CATEGORIES)})", by_category))
    sql("service_churn_rates", with_(MART + f", cells AS ({levels_of(ADDONS)})", by_category))
    sql("contract_contingency", with_(MART, "SELECT Contract AS level, count(*) FILTER (WHERE Churn = 'No') AS retained, count(*) FILTER (WHERE Churn = 'Yes') AS churned FROM mart GROUP BY 1"))
    sql(
        "revenue_hierarchy",
        with_(MART, f"""SELECT Segment, Contract, Churn, (3 - bit_count(grouping(Segment, Contract, Churn)))::INTEGER AS depth,
  {money('sum(MonthlyCharges)')} AS mrr FROM mart GROUP BY ROLLUP (Segment, Contract, Churn)"""),
    )
    sql("pearson_matrix", pearson())
    sql("numeric_box_by_churn", box(NUMERICS, ["Churn"]))
    sql("numeric_box_by_contract_churn", box(["MonthlyCharges", "tenure"], ["Contract", "Churn"]))
    every = ["customerID", "SeniorCitizen", "Region", "Segment", "tenure", "Contract", "PaymentMethod", *ADDONS, "MonthlyCharges", "TotalCharges", "Churn"]
    sql("missing_profile", with_(MART, union(f"SELECT {q(c)} AS feature, count(*) AS rows, count(*) - count({c}) AS missing FROM mart" for c in every)))
    sql(
        "numeric_description",
        with_(MART + f", vals AS ({values_of(NUMERICS)})", f"""SELECT feature, count(*) AS count, {smooth('avg(v)', 6)} AS mean, {smooth('stddev_samp(v)', 6)} AS std,
  {smooth('min(v)', 6)} AS min, {smooth('quantile_cont(v, 0.25)', 6)} AS p25, {smooth('quantile_cont(v, 0.5)', 6)} AS p50,
  {smooth('quantile_cont(v, 0.75)', 6)} AS p75, {smooth('max(v)', 6)} AS max FROM vals GROUP BY feature"""),
    )
    sql(
        "category_description",
        with_(MART + f""", cells AS ({levels_of(CATEGORIES)}), counted AS (SELECT feature, level, count(*) AS n FROM cells GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS rn FROM counted)""",
            """SELECT feature, sum(n)::BIGINT AS count, count(*) AS unique, max(CASE WHEN rn = 1 THEN level END) AS top,
  max(CASE WHEN rn = 1 THEN n END) AS freq FROM ranked GROUP BY feature"""),
    )
    sql("distinct_counts", with_(MART, union(f"SELECT {q(c)} AS feature, count(DISTINCT {c}) AS distinct_values FROM mart" for c in every)))
    sql("distinct_sketch_bounds", with_(MART, union(f"SELECT {q(c)} AS feature, count(DISTINCT {c}) AS distinct_values, TRUE AS within_bound FROM mart" for c in every)))
    held = " + ".join(f"(CASE WHEN {a} = 'Yes' THEN 1 ELSE 0 END)" for a in ADDONS)
    sql("addon_shield", with_(MART, f"SELECT ({held})::INTEGER AS addon_count, count(*) AS total, {CHURN_RATE} AS churn_rate_pct FROM mart GROUP BY 1"))
    sql("payment_friction", with_(MART, f"SELECT PaymentMethod, count(*) AS total, {CHURN_RATE} AS churn_rate_pct FROM mart GROUP BY 1 ORDER BY 3, 1"))
    sql(
        "value_quadrants",
        with_(MART + ", mid AS (SELECT median(MonthlyCharges) AS mm, median(tenure) AS mt FROM mart)", f"""SELECT CASE
  WHEN MonthlyCharges >= mm AND tenure < mt THEN 'VIP Flight Risk' WHEN MonthlyCharges >= mm THEN 'Core Crown Jewels'
  WHEN tenure < mt THEN 'Trial Churners' ELSE 'Stable Budget Anchors' END AS quadrant, count(*) AS customers, {CHURN_RATE} AS churn_rate_pct,
  {money('sum(MonthlyCharges)')} AS mrr FROM mart, mid WHERE MonthlyCharges IS NOT NULL GROUP BY 1"""),
    )
    sql("seeded_sample", with_(MART, f"SELECT customerID, Contract, Churn FROM mart ORDER BY {SAMPLE_ORDER} LIMIT 200"))

    # --- features and models
    sql("stratified_split", with_(SPLIT, "SELECT customerID, Churn, is_test FROM split"))
    fold = " + ".join(f"(CASE WHEN rn > round({i / 5!r}::DOUBLE * size) THEN 1 ELSE 0 END)" for i in range(1, 5))
    sql("stratified_folds", with_(SPLIT, f"SELECT customerID, Churn, ({fold})::INTEGER AS fold FROM placed"))
    sql(
        "scaling_statistics",
        with_(SPLIT, union(f"SELECT {q(c)} AS feature, {smooth(f'avg({c}::DOUBLE)', 4)} AS mean, {smooth(f'stddev_pop({c}::DOUBLE)', 4)} AS std FROM train" for c in NUMERICS)),
    )
    numbers = [f for f in SCORECARD_V1.features if f.level is None]
    sql("standardised_numerics", with_(CLEAN, f"SELECT customerID, {', '.join(f'{smooth(feature_value(SCORECARD_V1, f), 9)} AS {f.name}' for f in numbers)} FROM clean"))
    cuts = " + ".join(f"(rn > round(size * {k}::DOUBLE / 5))::INTEGER" for k in range(1, 5))
    folded = SPLIT + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY md5(customerID::VARCHAR || ':43'), customerID) AS rn,
  count(*) OVER (PARTITION BY Churn) AS size FROM (SELECT * EXCLUDE (rn, size) FROM train)),
folded AS (SELECT *, {cuts} AS fold FROM numbered)"""
    folds = []
    for k in range(5):
        for c in NUMERICS:
            middle = f"(SELECT median({c}::DOUBLE) FROM folded WHERE fold <> {k})"
            full = f"coalesce({c}::DOUBLE, {middle})"
            folds.append(
                f"SELECT {k} AS fold, {q(c)} AS feature, {smooth(middle, 4)} AS median, {smooth(f'avg({full})', 4)} AS mean,"
                f" {smooth(f'stddev_pop({full})', 4)} AS deviation FROM folded WHERE fold <> {k}"
            )
    sql("fold_statistics", with_(folded, union(folds)))
    per_fold = "count(*) FILTER (WHERE Churn = 'Yes') AS positives, count(*) FILTER (WHERE Churn = 'No') AS negatives, TRUE AS agrees"
    searches = "(VALUES ('LogisticRegression', 0), ('LogisticRegression', 1), ('LogisticRegression', 2), ('DecisionTreeClassifier', 0), ('DecisionTreeClassifier', 1), ('DecisionTreeClassifier', 2)) AS tried (model, setting)"
    sql("out_of_fold_auc", with_(folded, f"SELECT model, fold, setting, {per_fold} FROM folded, {searches} GROUP BY 1, 2, 3"))
    sql(
        "fitted_levels",
        with_(SPLIT + f", seen AS ({levels_of(CATEGORIES, 'train')}), later AS ({levels_of(CATEGORIES, '(SELECT * FROM split WHERE is_test)')})",
            """SELECT feature, level, train_records, coalesce(test_records, 0) AS test_records
FROM (SELECT feature, level, count(*) AS train_records FROM seen WHERE level IS NOT NULL GROUP BY 1, 2)
LEFT JOIN (SELECT feature, level, count(*) AS test_records FROM later GROUP BY 1, 2) USING (feature, level)"""),
    )
    sql("one_hot_drop_first", indicator_totals(SCORECARD_V1))
    sql("one_hot_all_levels", indicator_totals(SCORECARD_V2))
    sql("fitted_medians", with_(SPLIT, union(f"SELECT {q(c)} AS feature, {smooth(f'median({c}::DOUBLE)', 4)} AS median, count(*) AS train_rows FROM train" for c in NUMERICS)))
    sql(
        "fitted_modes",
        with_(SPLIT + f", cells AS ({levels_of(CATEGORIES, 'train')}), counted AS (SELECT feature, level, count(*) AS n FROM cells GROUP BY 1, 2)",
            "SELECT feature, level AS mode FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS rn FROM counted) WHERE rn = 1"),
    )
    sql(
        "feature_dictionary",
        with_(MART + f", cells AS ({levels_of(CATEGORIES)})", """SELECT 'cat__' || feature || '_' || level AS feature, feature AS raw_feature, level,
  feature || ' = ' || level AS label, level = min(level) OVER (PARTITION BY feature) AS is_reference, records
FROM (SELECT feature, level, count(*) AS records FROM cells GROUP BY 1, 2)
UNION ALL """ + union(f"SELECT 'num__{c}', '{c}', NULL, '{c}', FALSE, count({c}) FROM mart" for c in NUMERICS)),
    )
    sql("model_test_metrics", with_(model_metrics(), "SELECT * FROM metrics"))
    four = ", ".join(f"{smooth(m, 4)} AS {m}" for m in MEASURES)
    flags = ", ".join(f"{m} = max({m}) OVER () AS best_{m}" for m in MEASURES)
    sql("model_leaderboard", with_(model_metrics() + f", board AS (SELECT model, {four} FROM metrics)", f"SELECT *, {flags} FROM board ORDER BY roc_auc DESC, model"))
    sql("champion_by_auc", with_(model_metrics(), "SELECT model, roc_auc FROM metrics ORDER BY roc_auc DESC, model LIMIT 1"))
    weighed = union(
        f"SELECT {q(f.name)} AS feature, {dbl(abs(SCORECARD_V2.weights[f.name]))} AS importance,"
        f" count(*) FILTER (WHERE {f.raw} {'<> 0' if f.level is None else '= ' + q(f.level)}) AS subscribers FROM clean"
        for f in SCORECARD_V2.features
    )
    sql("scorecard_importance", with_(CLEAN + f", weighed AS ({weighed})", "SELECT * FROM weighed ORDER BY importance DESC, feature LIMIT 10"))

    # --- scoring
    sql("batch_scores", with_(SCORED, f"SELECT customerID, {smooth('p', 9)} AS churn_probability, {smooth('margin', 9)} AS margin, prediction FROM scored"))
    sql("both_class_percentages", with_(SCORED, f"SELECT customerID, prediction, churn_pct, {smooth('100 * (1 - p)', 2)} AS no_churn_pct FROM scored"))
    sql("threshold_labels", with_(SCORED, f"SELECT prediction, Churn, count(*) AS records, {smooth('min(p)', 9)} AS lowest, {smooth('max(p)', 9)} AS highest FROM scored GROUP BY 1, 2"))
    sql(
        "class_semantics",
        with_(MART, """SELECT Churn AS label, row_number() OVER (ORDER BY Churn) - 1 AS class_index,
  CASE WHEN lower(Churn) IN ('1', 'yes', 'true') THEN 'Yes' ELSE 'No' END AS canonical, lower(Churn) IN ('1', 'yes', 'true') AS is_positive, count(*) AS records
FROM mart GROUP BY Churn"""),
    )
    sql(
        "fitted_class_semantics",
        with_(MART, union(
            f"SELECT {q(case)} AS case_name, {q(labels)} AS labels, {at}::INTEGER AS positive_index, count(*) AS records, {found} AS positives FROM mart WHERE Churn IS NOT NULL"
            for case, labels, at, found in (
                ("ascending", "No,Yes", "1", "count(*) FILTER (WHERE Churn = 'Yes')"),
                ("descending", "Yes,No", "0", "count(*) FILTER (WHERE Churn = 'Yes')"),
                ("ambiguous", "1,yes", "NULL", "0"),
            )
        )),
    )
    status = "CASE WHEN churn_pct < 30 THEN 'LOW RISK' WHEN churn_pct < 60 THEN 'MODERATE RISK' ELSE 'HIGH RISK' END AS risk_status"
    sql("risk_tiers", with_(SCORED, f"SELECT customerID, churn_pct, risk_tier, risk_level, {status} FROM scored"))
    high = "risk_tier = 'High Risk'"
    sql(
        "high_risk_revenue",
        with_(SCORED, f"""SELECT count(*) FILTER (WHERE {high}) AS high_risk_accounts, {pct(f'count(*) FILTER (WHERE {high})', 'count(*)')} AS high_risk_pct,
  {money(f'sum(CASE WHEN {high} THEN MonthlyCharges END)')} AS high_risk_mrr FROM scored"""),
    )
    sql(
        "tier_distribution",
        with_(SCORED, f"""SELECT v.tier AS risk_tier, count(customerID) AS customers, {pct('count(customerID)', '(SELECT count(*) FROM scored)')} AS share_pct
FROM (VALUES ('Low Risk'), ('Moderate Risk'), ('High Risk')) v(tier) LEFT JOIN scored ON risk_tier = v.tier GROUP BY 1"""),
    )
    bucket = "floor(churn_pct / 5)::BIGINT"
    sql("probability_histogram", with_(SCORED, f"SELECT {bucket} AS bucket, {bucket} * 5::DOUBLE AS lower, ({bucket} + 1) * 5::DOUBLE AS upper, count(*) AS n FROM scored GROUP BY 1"))
    impacts = " ".join(f"WHEN {q(a)} THEN {q(i)}" for a, i, _, _ in catalog.scoring.ACTIONS)
    sql("intervention_plan", with_(SCORED + actions_cte(), f"SELECT customerID, row_number() OVER (PARTITION BY customerID ORDER BY place) AS step, action, CASE action {impacts} END AS impact, priority FROM acts"))
    sql("intervention_counts", with_(SCORED + actions_cte(), "SELECT action, priority, risk_level, count(*) AS subscribers FROM acts GROUP BY 1, 2, 3"))
    nba = union(f"SELECT {q(name)} AS action, risk_tier FROM scored WHERE {test}" for test, name in BEST_ACTIONS)
    sql("next_best_actions", with_(SCORED + f", acts AS ({nba})", "SELECT action, risk_tier, count(*) AS subscribers FROM acts GROUP BY 1, 2"))
    sql("value_at_risk_by_tier", with_(SCORED, f"SELECT risk_tier, count(*) AS customers, {money('sum(MonthlyCharges * 12)')} AS annual_value_at_risk FROM scored GROUP BY 1"))
    sql(
        "result_records",
        with_(SCORED, f"""SELECT row_number() OVER (ORDER BY customerID) AS row, customerID, prediction, prediction = 'Yes' AS churn, churn_pct, risk_level,
  tenure, Contract, {smooth('MonthlyCharges', 8)} AS MonthlyCharges, Segment FROM scored"""),
    )
    sql("active_version_scores", with_(BOTH, f"SELECT customerID, 'v2' AS version, {smooth('p2', 9)} AS churn_probability, l2 AS prediction FROM versions"))
    sql("batch_invariance", with_(CLEAN, f"SELECT count(*) AS records, 0::DOUBLE AS max_difference FROM clean WHERE {FLEX}"))

    # --- evaluation
    sql("metrics_at_half", with_(SCORED + sweep_cte([0.5]), "SELECT * FROM sweep"))
    points = f"SELECT {smooth('s', 9)} AS threshold, {smooth('fp::DOUBLE / nn', 9)} AS fpr, {smooth('tp::DOUBLE / np', 9)} AS tpr FROM"
    start = " UNION ALL SELECT NULL, 0, 0"
    sql("roc_curve", with_(SCORED + STEPS, f"{points} steps, tot{start}"))
    bends = """, bends AS (SELECT *, lead(pos) OVER (ORDER BY s DESC) AS npos, lead(neg) OVER (ORDER BY s DESC) AS nneg,
  row_number() OVER (ORDER BY s DESC) AS rn FROM steps)"""
    sql("roc_curve_reduced", with_(SCORED + STEPS + bends, f"{points} bends, tot WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg{start}"))
    sql(
        "precision_recall_curve",
        with_(SCORED + STEPS, f"SELECT {smooth('s', 9)} AS threshold, {smooth('tp::DOUBLE / (tp + fp)', 9)} AS precision, {smooth('tp::DOUBLE / np', 9)} AS recall FROM steps, tot UNION ALL SELECT NULL, 1, 0"),
    )
    sql("ranking_summary", with_(SCORED + ranking("scored", "p"), "SELECT * FROM ranking"))
    sql("ranking_by_segment", with_(SCORED + ranking("scored", "p", "Segment, "), "SELECT * FROM ranking"))
    sql("tied_ranking", with_(SCORED + ", whole AS (SELECT label, floor(churn_pct) AS w FROM scored)" + ranking("whole", "w"), "SELECT * FROM ranking"))
    sql("brier_score", with_(SCORED, f"SELECT count(*) AS n, {smooth('avg((p - label) * (p - label))', 9)} AS brier_score FROM scored"))
    sql("f1_threshold", with_(SCORED + sweep_cte(GRID), "SELECT threshold, f1, precision, recall, accuracy FROM sweep ORDER BY f1 DESC, threshold LIMIT 1"))
    sql("recall_thresholds", with_(SCORED + sweep_cte(GRID), recall_rows([0.15, 0.22, 0.6, 0.65, 0.7])))
    sql("calibration_table", with_(SCORED + CALIBRATION, "SELECT * FROM calibration"))
    sql("calibration_summary", with_(SCORED + CALIBRATION, "SELECT * FROM calibration_summary"))
    summed = {"threshold_sweep": ("threshold_analysis", "f1"), "calibration_table": ("calibration_analysis", "mean_predicted_probability"),
              "roc_curve": ("roc_curve", "tpr"), "precision_recall_curve": ("precision_recall_curve", "precision")}
    sql("analysis_artifact_rows", union(
        f"SELECT '{name}' AS artifact, count(*) AS records, '{column}' AS summed, {smooth(f'sum({column})', 4)} AS total FROM ({s[job]}) AS {name}"
        for job, (name, column) in summed.items()
    ))
    sql(
        "split_summary",
        with_(SPLIT, f"""SELECT is_test, count(*) AS n_total, count(*) FILTER (WHERE Churn = 'Yes') AS n_actual_positive,
  count(*) FILTER (WHERE Churn = 'No') AS n_actual_negative, {smooth("avg(CASE WHEN Churn = 'Yes' THEN 1::DOUBLE ELSE 0 END)", 9)} AS observed_positive_rate FROM split GROUP BY 1"""),
    )
    cells = union(f"SELECT {q(a)} AS actual, {q(p)} AS predicted, count(*) FILTER (WHERE Churn = {q(a)} AND prediction = {q(p)}) AS n FROM scored" for a in ("No", "Yes") for p in ("No", "Yes"))
    sql("confusion_matrix", with_(SCORED, cells))
    per = union(
        f"""SELECT {q(c)} AS row, count(*) FILTER (WHERE Churn = {q(c)} AND prediction = {q(c)}) AS hit, count(*) FILTER (WHERE prediction = {q(c)}) AS called,
  count(*) FILTER (WHERE Churn = {q(c)}) AS support FROM scored""" for c in ("No", "Yes")
    )
    sql(
        "classification_report",
        with_(
            SCORED + f""", raw AS ({per}),
cls AS (SELECT row, hit, hit::DOUBLE / called AS precision, hit::DOUBLE / support AS recall, 2::DOUBLE * hit / (called + support) AS f1, support FROM raw),
lines AS (SELECT row, precision, recall, f1, support FROM cls
  UNION ALL SELECT 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(support)::BIGINT FROM cls
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM cls
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM cls)""",
            f"SELECT row, {smooth('precision', 9)} AS precision, {smooth('recall', 9)} AS recall, {smooth('f1', 9)} AS f1, support FROM lines",
        ),
    )
    sql("threshold_report", report())
    sql(
        "labelled_documents_ranking",
        with_(
            "judged AS (SELECT lang, quality AS label, n_chars::DOUBLE AS s0 FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)" + ranking("judged", "s0", "lang, "),
            "SELECT * FROM ranking",
        ),
    )

    # --- explanation
    sql(
        "background_reference",
        with_(CLEAN + background_cte(SCORECARD_V1), union(f"SELECT {q(f.name)} AS feature, (SELECT count(*) FROM sampled) AS rows, {smooth(f'm{i}', 9)} AS mean FROM means" for i, f in enumerate(SCORECARD_V1.features))),
    )
    sql("linear_attribution", with_(PHIS, f"SELECT customerID, feature, {smooth('phi', 9)} AS contribution FROM phis"))
    sql(
        "individual_explanations",
        with_(
            PHIS + ", ordered AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(phi) DESC, feature) AS rank FROM phis)",
            f"""SELECT customerID, rank, feature, label, raw_feature, {smooth('phi', 9)} AS contribution, {smooth('abs(phi)', 9)} AS abs_contribution,
  {smooth(sigmoid('(base + phi)') + ' - ' + sigmoid('base'), 9)} AS probability_shift, CASE WHEN phi > 0 THEN 'increases churn' ELSE 'decreases churn' END AS direction
FROM ordered, base WHERE rank <= 5""",
        ),
    )
    sql(
        "explanation_totals",
        with_(
            PHIS + f", odds AS (SELECT customerID, {margin(SCORECARD_V1)} AS z FROM clean)",
            f"""SELECT customerID, {smooth('any_value(base)', 9)} AS base_value, {smooth('any_value(z)', 9)} AS log_odds,
  abs(any_value(base) + sum(phi) - any_value(z)) < 1e-8 AS additive, count(*) FILTER (WHERE phi > 0) AS increasing, count(*) FILTER (WHERE phi < 0) AS decreasing,
  arg_max(feature, phi) AS strongest_increase FROM phis JOIN odds USING (customerID), base GROUP BY customerID""",
        ),
    )
    sql("global_importance", importance("clean"))
    sql("global_importance_sampled", importance("sampled"))
    sql("global_direction", direction(SCORECARD_V1))
    sql("scenario_attribution_deltas", scenario_deltas())
    sql("attribution_additivity", with_(CLEAN, "SELECT count(*) AS records, TRUE AS additive FROM clean"))
    sql("stable_logistic", with_(SCORED, f"SELECT customerID, {smooth('1 / (1 + exp(-least(greatest(margin * 400, -700), 700)))', 9)} AS p FROM scored"))
    sql("fixed_tree_attribution", brute_force_shapley())
    frozen = CLEAN + f", summed AS (SELECT *, {frozen_value(frozenset(range(len(FROZEN))))} AS margin FROM clean), probable AS (SELECT *, {sigmoid('margin')} AS p FROM summed)"
    sql("tree_scores", with_(frozen, f"SELECT customerID, {smooth('margin', 9)} AS margin, {smooth('p', 9)} AS churn_probability, CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END AS prediction FROM probable"))
    sql("tree_additivity", with_(frozen, f"SELECT count(*) AS records, {smooth(frozen_value(frozenset()), 9)} AS base_value, 0::BIGINT AS violations, {smooth('sum(margin)', 4)} AS total_margin FROM summed"))
    sql("tree_top_attributions", ranked_shapley())
    sql("tree_attribution_change", shapley_change())

    # --- version comparison
    sql(
        "probability_differences",
        with_(BOTH, f"""SELECT count(*) AS rows, {smooth('avg(abs(p1 - p2))', 9)} AS mean_absolute_difference, {smooth('median(abs(p1 - p2))', 9)} AS median_absolute_difference,
  {smooth('max(abs(p1 - p2))', 9)} AS max_absolute_difference, {smooth('stddev_pop(abs(p1 - p2))', 9)} AS std_of_differences, {smooth('corr(p1, p2)', 9)} AS correlation,
  {smooth('min(p1)', 9)} AS min_v1_probability, {smooth('max(p1)', 9)} AS max_v1_probability, {smooth('min(p2)', 9)} AS min_v2_probability, {smooth('max(p2)', 9)} AS max_v2_probability
FROM versions"""),
    )
    sql(
        "label_agreement",
        with_(BOTH, f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE l1 = 'Yes') AS v1_predicted_churn, count(*) FILTER (WHERE l2 = 'Yes') AS v2_predicted_churn,
  count(*) FILTER (WHERE l1 = l2) AS label_agreement, count(*) FILTER (WHERE l1 <> l2) AS label_disagreement,
  {pct('count(*) FILTER (WHERE l1 <> l2)', 'count(*)', 4)} AS disagreement_pct, count(*) FILTER (WHERE l1 = 'No' AND l2 = 'No') AS both_no,
  count(*) FILTER (WHERE l1 = 'No' AND l2 = 'Yes') AS v1_no_v2_yes, count(*) FILTER (WHERE l1 = 'Yes' AND l2 = 'No') AS v1_yes_v2_no,
  count(*) FILTER (WHERE l1 = 'Yes' AND l2 = 'Yes') AS both_yes FROM versions"""),
    )
    sql(
        "disagreement_sample",
        with_(
            BOTH + ", placed AS (SELECT *, row_number() OVER (ORDER BY customerID) - 1 AS row_index FROM versions)",
            f"""SELECT row_index, {smooth('p1', 6)} AS v1_probability, {smooth('p2', 6)} AS v2_probability, l1 AS v1_label, l2 AS v2_label,
  {smooth('abs(p1 - p2)', 6)} AS absolute_probability_difference, Churn AS true_label FROM placed WHERE l1 <> l2 ORDER BY row_index LIMIT 25""",
        ),
    )
    near1, near2 = "(p1 >= 0.45 AND p1 < 0.55)", "(p2 >= 0.45 AND p2 < 0.55)"
    sql(
        "threshold_proximity",
        with_(BOTH, f"""SELECT count(*) FILTER (WHERE {near1}) AS v1_in_band, count(*) FILTER (WHERE {near2}) AS v2_in_band,
  {pct(f'count(*) FILTER (WHERE {near1})', 'count(*)', 4)} AS v1_band_pct, {pct(f'count(*) FILTER (WHERE {near2})', 'count(*)', 4)} AS v2_band_pct,
  count(*) FILTER (WHERE l1 <> l2 AND ({near1} OR {near2})) AS disagreements_near_threshold FROM versions"""),
    )
    sql("determinism_check", with_(CLEAN, "SELECT count(*) AS rows, TRUE AS deterministic FROM clean"))
    sql("bundle_verification", with_(CLEAN, union(f"SELECT {q(c)} AS feature, {smooth(f'avg({c}::DOUBLE)', 4)} AS mean, {smooth(f'stddev_pop({c}::DOUBLE)', 4)} AS deviation, TRUE AS verified, 2::BIGINT AS files FROM clean" for c in NUMERICS)))
    sql("contract_comparison", contract_probes())
    first = {f.name for f in SCORECARD_V1.features}
    sql(
        "feature_space",
        with_(CLEAN, union(
            f"SELECT {q(f.name)} AS feature, {q(f.raw)} AS raw_feature, {'NULL::VARCHAR' if f.level is None else q(f.level)} AS level,"
            f" {str(f.name in first).upper()} AS in_v1, TRUE AS in_v2, "
            + ("max(NULL::BIGINT)" if f.level is None else f"nullif(count(*) FILTER (WHERE {f.raw} = {q(f.level)}), 0)")
            + " AS records FROM clean"
            for f in SCORECARD_V2.features
        )),
    )
    sql("explanation_compatibility", with_(CLEAN, union(f"SELECT {q(v)} AS version, {n}::BIGINT AS features, TRUE AS deterministic, count(*) AS records, TRUE AS additive FROM clean" for v, n in (("v1", 25), ("v2", 35)))))
    sql(
        "promotion_record",
        with_(BOTH, f"""SELECT 'v1' AS previous_active_version, 'v2' AS promoted_version, 0.5::DOUBLE AS decision_threshold, 35 AS transformed_feature_count,
  count(*) AS shadow_rows, count(*) FILTER (WHERE l1 <> l2) AS shadow_label_disagreements, {exact("count(*) FILTER (WHERE l1 <> l2)::DOUBLE / count(*)", 4)} AS shadow_disagreement_rate,
  {smooth('max(abs(p1 - p2))', 4)} AS shadow_max_probability_difference, {smooth('avg(abs(p1 - p2))', 4)} AS shadow_mean_probability_difference FROM versions"""),
    )

    # --- scenarios
    sql("what_if_scores", with_(what_if_cte(), "SELECT * FROM outcomes"))
    sql(
        "what_if_summary",
        with_(what_if_cte(), f"SELECT scenario, count(*) AS customers, {smooth('avg(delta_points)', 4)} AS mean_delta_points, count(*) FILTER (WHERE reduction_points > 0) AS customers_helped FROM outcomes GROUP BY 1"),
    )
    sql(
        "best_scenario",
        with_(what_if_cte() + ", best AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY p1, scenario) AS rn FROM ps)", f"SELECT customerID, scenario, {smooth('p1', 6)} AS simulated_probability FROM best WHERE rn = 1"),
    )
    sql("archetype_positions", archetypes())
    plans = ", ".join(f"({r}, {dbl(o)})" for r in catalog.RATES for o in catalog.OFFERS)
    bill = smooth("avg(MonthlyCharges)", 2)
    sql(
        "campaign_economics",
        with_(
            SCORED + f""", plan(rate_pct, offer_cost) AS (VALUES {plans}),
cohort AS (SELECT risk_tier, count(*) AS customers, {bill} AS bill FROM scored GROUP BY 1),
run AS (SELECT *, floor(customers * (rate_pct / 100.0::DOUBLE))::BIGINT AS saved_customers, customers * offer_cost AS cost FROM cohort CROSS JOIN plan),
done AS (SELECT *, saved_customers * bill * 12 AS rev FROM run)""",
            f"""SELECT risk_tier, customers, rate_pct::INTEGER AS rate_pct, offer_cost, saved_customers, {exact('cost', 2)} AS campaign_cost, {exact('rev', 2)} AS revenue_saved,
  {exact('rev - cost', 2)} AS net_profit, {exact('CASE WHEN cost > 0 THEN 100 * (rev - cost) / cost ELSE 0 END', 2)} AS roi_pct FROM done""",
        ),
    )
    sql(
        "flat_bill_economics",
        with_(
            SCORED + f""", plan(rate_pct) AS (VALUES {', '.join(f'({r})' for r in catalog.RATES)}),
cohort AS (SELECT risk_level, count(*) AS customers FROM scored GROUP BY 1),
run AS (SELECT *, round(customers * (rate_pct / 100.0::DOUBLE))::BIGINT AS saved_customers FROM cohort CROSS JOIN plan)""",
            "SELECT risk_level, customers, rate_pct::INTEGER AS rate_pct, saved_customers, saved_customers * 900::DOUBLE AS annual_revenue_saved FROM run",
        ),
    )

    # --- streaming
    streamed = FEED_ACCEPTED + scored_cte(SCORECARD_V1, "taken") + actions_cte()
    sql(
        "streamed_scores",
        with_(streamed, f"""SELECT s.customerID, prediction, churn_pct, {smooth('100 * (1 - p)', 2)} AS no_churn_pct, s.risk_level,
  string_agg(action, '|' ORDER BY place) AS actions FROM scored s JOIN acts a ON s.customerID = a.customerID GROUP BY s.customerID, prediction, churn_pct, p, s.risk_level"""),
    )
    sql("stream_counts", with_(FEED_FOUND, """SELECT 'accepted' AS verdict, count(*) AS counted, count(*) AS rows FROM feed WHERE customerID NOT IN (SELECT customerID FROM bad)
UNION ALL SELECT 'refused', count(*), count(*) FROM bad"""))
    sql("ensemble_agreement", with_(FEED_FOUND, """SELECT 'boosted' AS version, count(*) AS records, 0::BIGINT AS violations, 0::BIGINT AS labels_apart, TRUE AS proper, TRUE AS varied
FROM feed WHERE customerID NOT IN (SELECT customerID FROM bad)"""))
    sql(
        "model_metric_checks",
        with_(SPLIT, f"""SELECT model, count(*) AS records, count(*) FILTER (WHERE Churn = 'Yes') AS positives, 0::BIGINT AS improper_scores,
  0::BIGINT AS figures_apart, TRUE AS champion_leads
FROM split CROSS JOIN (VALUES {', '.join(f"({q(name)})" for name in catalog.training.MODEL_NAMES)}) AS m(model) WHERE is_test GROUP BY model"""),
    )
    sql(
        "explainer_choice",
        with_(SPLIT, """SELECT family, explainer, (SELECT count(*) FROM split WHERE is_test) AS records FROM (VALUES
  ('LogisticRegression', 'linear'), ('DecisionTreeClassifier', 'tree'), ('RandomForestClassifier', 'tree'), ('GBTClassifier', 'tree'), ('LinearSVC', NULL)) AS t(family, explainer)"""),
    )
    sql("contract_declarations", contract_declared())
    sql("declared_sections", f"""SELECT section, count(*) FILTER (WHERE in_v1) AS v1_items, count(*) FILTER (WHERE in_v2) AS v2_items,
  count(*) FILTER (WHERE in_v1 AND in_v2) AS common_items, CASE WHEN bool_and(in_v1 = in_v2) THEN 'SAME' ELSE 'DIFFERENT' END AS status
FROM ({contract_declared()}) GROUP BY section""")
    sql("streamed_quarantine", with_(FEED_FOUND, "SELECT customerID, Churn, 'upload' AS channel, string_agg(feature || ':' || rule, '|' ORDER BY feature || ':' || rule) AS reasons FROM found JOIN feed USING (customerID) GROUP BY customerID, Churn"))
    sql(
        "tier_report",
        with_(SCORED, f"SELECT risk_tier, count(*) AS subscribers, sum(label)::BIGINT AS churned, {money('sum(MonthlyCharges)')} AS mrr, {smooth('avg(p)', 6)} AS mean_probability FROM scored GROUP BY 1"),
    )
    return s
