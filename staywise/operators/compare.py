"""Comparison of two model versions on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import percent
from staywise.functions.sql import array, literal, quoted, struct, text
from staywise.operators.contract import ContractViolation, conforms_sql, require_columns
from staywise.operators.ordering import fit_medians
from staywise.operators.scoring import Scorecard, with_score
from staywise.roles import ContractSpec

PRODUCTION_THRESHOLD = 0.5
NEAR_BAND = (0.45, 0.55)
SAMPLE_ROWS = 25
DIGITS = 9

P1, P2 = "v1_churn_probability", "v2_churn_probability"
L1, L2 = "v1_prediction", "v2_prediction"


def score_both(clean: DataFrame, first: Scorecard, second: Scorecard, threshold: float = PRODUCTION_THRESHOLD) -> DataFrame:
    """Both scores as columns of the same row: two projections, no join."""
    if abs(threshold - PRODUCTION_THRESHOLD) > 1e-12:
        raise ValueError(f"versions are compared at {PRODUCTION_THRESHOLD} only")
    return with_score(with_score(clean, first, "v1_"), second, "v2_")


def probability_differences(both: DataFrame) -> DataFrame:
    difference = F.abs(F.col(P1) - F.col(P2))
    middle = fit_medians(both.select(difference.alias("difference")), ["difference"])
    moments = both.agg(
        F.count("*").alias("rows"),
        F.avg(difference).alias("mean"),
        F.max(difference).alias("max"),
        F.stddev_pop(difference).alias("std"),
        F.covar_pop(P1, P2).alias("cov"),
        F.stddev_pop(P1).alias("s1"),
        F.stddev_pop(P2).alias("s2"),
        F.min(P1).alias("min1"),
        F.max(P1).alias("max1"),
        F.min(P2).alias("min2"),
        F.max(P2).alias("max2"),
    )
    correlation = F.when((F.col("s1") > 0) & (F.col("s2") > 0), F.try_divide("cov", F.col("s1") * F.col("s2")))
    rounded = {
        "mean_absolute_difference": F.col("mean"),
        "median_absolute_difference": F.lit(middle.get("difference")).cast("double"),
        "max_absolute_difference": F.col("max"),
        "std_of_differences": F.col("std"),
        "correlation": correlation,
        "min_v1_probability": F.col("min1"),
        "max_v1_probability": F.col("max1"),
        "min_v2_probability": F.col("min2"),
        "max_v2_probability": F.col("max2"),
    }
    return moments.select("rows", *[F.round(c, DIGITS).alias(name) for name, c in rounded.items()])


def label_agreement(both: DataFrame) -> DataFrame:
    agree = F.count_if(F.col(L1) == F.col(L2))
    return both.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(L1) == "Yes").alias("v1_predicted_churn"),
        F.count_if(F.col(L2) == "Yes").alias("v2_predicted_churn"),
        agree.alias("label_agreement"),
        (F.count("*") - agree).alias("label_disagreement"),
        percent(F.count("*") - agree, F.count("*"), 4).alias("disagreement_pct"),
        F.count_if((F.col(L1) == "No") & (F.col(L2) == "No")).alias("both_no"),
        F.count_if((F.col(L1) == "No") & (F.col(L2) == "Yes")).alias("v1_no_v2_yes"),
        F.count_if((F.col(L1) == "Yes") & (F.col(L2) == "No")).alias("v1_yes_v2_no"),
        F.count_if((F.col(L1) == "Yes") & (F.col(L2) == "Yes")).alias("both_yes"),
    )


def comparison_rows(both: DataFrame, key: str, target: str, digits: int = 6) -> DataFrame:
    """Per-row export: probabilities, their difference, both labels and the true one."""
    return both.select(
        key,
        F.round(P1, digits).alias("v1_probability"),
        F.round(P2, digits).alias("v2_probability"),
        F.round(F.abs(F.col(P1) - F.col(P2)), digits).alias("absolute_probability_difference"),
        F.col(L1).alias("v1_label"),
        F.col(L2).alias("v2_label"),
        (F.col(L1) == F.col(L2)).alias("labels_agree"),
        F.col(target).alias("true_label"),
        F.lit(PRODUCTION_THRESHOLD).alias("threshold"),
    )


def disagreement_sample(both: DataFrame, key: str, target: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """First disagreements along the key, carrying their position instead of the identifier.

    The positions of the few sampled rows are counted in one pass, so the full
    table is never numbered.
    """
    exported = comparison_rows(both, key, target).where(~F.col("labels_agree"))
    sample = exported.orderBy(key).limit(rows)
    keys = [row[key] for row in sample.select(key).collect()]
    if not keys:
        return sample.select(F.lit(0).cast("bigint").alias("row_index"), *_sample_columns())
    positions = both.agg(*[F.count_if(F.col(key) < k).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    index = F.lit(None).cast("bigint")
    for i, k in enumerate(keys):
        index = F.when(F.col(key) == k, F.lit(positions[f"k{i}"])).otherwise(index)
    return sample.select(index.cast("bigint").alias("row_index"), *_sample_columns())


def _sample_columns() -> list[str]:
    return [
        "v1_probability",
        "v2_probability",
        "v1_label",
        "v2_label",
        "absolute_probability_difference",
        "true_label",
    ]


def threshold_proximity(both: DataFrame, band: tuple[float, float] = NEAR_BAND) -> DataFrame:
    """How many decisions sit near the threshold; disagreements are counted over the union of both bands."""
    near1 = (F.col(P1) >= band[0]) & (F.col(P1) < band[1])
    near2 = (F.col(P2) >= band[0]) & (F.col(P2) < band[1])
    return both.agg(
        F.count_if(near1).alias("v1_in_band"),
        F.count_if(near2).alias("v2_in_band"),
        percent(F.count_if(near1), F.count("*"), 4).alias("v1_band_pct"),
        percent(F.count_if(near2), F.count("*"), 4).alias("v2_band_pct"),
        F.count_if((F.col(L1) != F.col(L2)) & (near1 | near2)).alias("disagreements_near_threshold"),
    )


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive fingerprint of the named columns."""
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")).alias("fingerprint"),
    )


def determinism_check(run: Callable[[], DataFrame], columns: Sequence[str]) -> DataFrame:
    """Run twice, in two jobs, and compare the one-row fingerprints.

    In a single plan the second run would be answered by reusing the first.
    """
    first, second = (checksum(run(), columns).first() for _ in range(2))
    return run().sparkSession.createDataFrame(
        [(first["rows"], first == second)], "rows bigint, deterministic boolean"
    )


def feature_space(first: Scorecard, second: Scorecard, present: DataFrame) -> DataFrame:
    """Full outer join of both feature dictionaries with how often each level occurs in the data.

    ``present`` is (feature, level, n) as discovered from the data; a number has
    no level and joins on nothing.
    """
    spark = present.sparkSession

    def dictionary(card: Scorecard, side: str) -> DataFrame:
        rows = [(f.name, f.raw, f.level, float(card.weights[f.name])) for f in card.features]
        return spark.createDataFrame(rows, f"feature string, raw_{side} string, level_{side} string, {side}_weight double")

    joined = dictionary(first, "v1").join(dictionary(second, "v2"), "feature", "full")
    merged = joined.select(
        "feature",
        F.coalesce("raw_v1", "raw_v2").alias("raw_feature"),
        F.coalesce("level_v1", "level_v2").alias("level"),
        F.col("v1_weight").isNotNull().alias("in_v1"),
        F.col("v2_weight").isNotNull().alias("in_v2"),
    )
    seen = present.select(F.col("feature").alias("raw_feature"), "level", F.col("n").alias("records"))
    return merged.join(seen, ["raw_feature", "level"], "left").select(
        "feature", "raw_feature", "level", "in_v1", "in_v2", "records"
    )


def contract_probes(flag: str, measured: str, imputed: str, category: str) -> dict[str, tuple[str, object]]:
    """Mutations of one column each that both contracts are probed with; None means missing."""
    return {
        "flag_text_1": (flag, "1"),
        "flag_text_yes": (flag, "Yes"),
        "flag_text_no": (flag, "No"),
        "flag_text_false": (flag, "false"),
        "imputed_missing": (imputed, None),
        "imputed_text": (imputed, "640.25"),
        "imputed_infinite": (imputed, "inf"),
        "measured_missing": (measured, None),
        "category_missing": (category, None),
        "category_unknown": (category, "Five year"),
        "category_case_typo": (category, "TWO YEAR"),
    }


def shape_probes(raw: DataFrame, absent: str) -> dict[str, DataFrame]:
    """The same records in frames of another shape: columns reversed, one more, one less."""
    return {
        "reordered_columns": raw.select(*reversed(raw.columns)),
        "extra_column": raw.withColumn("unexpected_column", F.lit("x")),
        "absent_column": raw.drop(absent),
    }


def contract_comparison(
    raw: DataFrame, first: ContractSpec, second: ContractSpec, probes: dict[str, tuple[str, object]], absent: str
) -> DataFrame:
    """Apply every probe to every record and count what each contract accepts.

    ``raw`` holds the required columns as text.  Mutations are literals
    exploded inside the row, shapes are frames of their own; the result has one
    row per probe.
    """
    columns = list(first.required)

    def mutated(name: str, column: str, value: object) -> str:
        fields = {"probe": text(name)}
        for c in columns:
            fields[c] = f"CAST({literal(value)} AS STRING)" if c == column else quoted(c)
        return struct(fields)

    def decision(frame: DataFrame, spec: ContractSpec) -> Column:
        try:
            require_columns(frame.columns, spec)
        except ContractViolation:
            return F.lit(False)
        return F.expr(conforms_sql(frame.schema, spec))

    def judged(frame: DataFrame, probe: Column) -> DataFrame:
        return frame.select(probe.alias("probe"), decision(frame, first).alias("ok1"), decision(frame, second).alias("ok2"))

    cases = F.expr(array(mutated(name, column, value) for name, (column, value) in probes.items()))
    rows = judged(raw.select(F.explode(cases).alias("case")).select("case.*"), F.col("probe"))
    for name, frame in shape_probes(raw.select(columns), absent).items():
        rows = rows.unionByName(judged(frame, F.lit(name)))
    counted = rows.groupBy("probe").agg(
        F.count("*").alias("records"),
        F.count_if("ok1").alias("v1_accepted"),
        F.count_if("ok2").alias("v2_accepted"),
        F.count_if(F.col("ok1") != F.col("ok2")).alias("decided_differently"),
    )
    return counted.withColumn("status", F.when(F.col("decided_differently") == 0, "SAME").otherwise("DIFFERENT"))


def declared_items(spec: ContractSpec, card: Scorecard) -> set[tuple[str, str | None, str]]:
    """(section, column, item) of all that a contract and a scorecard's encoder declare; a column of its own has the item ``*``."""
    found = {("required", name, "*") for name in spec.required}
    found |= {("flag", name, "*") for name in spec.flags} | {("numeric", name, "*") for name in spec.numerics}
    found |= {("category", name, "*") for name in spec.domains}
    found |= {("imputed", name, f"{float(value)!r}") for name, value in spec.imputed.items()}
    found |= {("alias", name, f"{spelling}={value}") for name in spec.flags for spelling, value in spec.aliases.items()}
    found |= {("level", name, level) for name, levels in spec.domains.items() for level in levels}
    found |= {("encoded level", f.raw, f.level) for f in card.features if f.level is not None}
    found |= {("scaling", n, f"{float(card.means[n])!r}, {float(card.deviations[n])!r}") for n in card.numerics}
    return found | {("setting", None, f"drop_first={card.drop_first}"), ("setting", None, f"threshold={float(card.threshold)!r}")}


def declarations(raw: DataFrame, first: tuple[ContractSpec, Scorecard], second: tuple[ContractSpec, Scorecard]) -> DataFrame:
    """Full outer comparison of what two versions declare: (section, feature, item, in_v1, in_v2, records).

    ``records`` counts the records of ``raw`` that the item concerns: those with
    the level or spelling, or else with a value in the column; all, for a setting.
    """
    one, two = declared_items(*first), declared_items(*second)
    spellings = {name for spec in (first[0], second[0]) for name in spec.flags}
    rows = [(*item, _token(item, spellings), item in one, item in two) for item in sorted(one | two, key=str)]
    items = raw.sparkSession.createDataFrame(rows, "section string, feature string, item string, token string, in_v1 boolean, in_v2 boolean")
    columns = sorted({name for _, name, _ in one | two if name} & set(raw.columns))
    cells = [struct({"feature": "CAST(NULL AS STRING)", "token": text("*")})]
    for name in columns:
        value = f"lower(trim({quoted(name)}))" if name in spellings else quoted(name)
        cells += [struct({"feature": text(name), "token": f"if(coalesce(trim({quoted(name)}), '') <> '', '*', NULL)"})]
        cells += [struct({"feature": text(name), "token": f"concat('=', {value})"})]
    held = raw.select(F.inline(F.expr(array(cells)))).where("token IS NOT NULL").groupBy("feature", "token").agg(F.count("*").alias("records"))
    same = items["feature"].eqNullSafe(held["feature"]) & (items["token"] == held["token"])
    return items.join(held, same, "left").select(
        "section", items["feature"], "item", "in_v1", "in_v2", F.coalesce("records", F.lit(0)).alias("records")
    )


def _token(item: tuple[str, str | None, str], spellings: set[str]) -> str:
    section, name, value = item
    if section == "alias":
        return "=" + value.rsplit("=", 1)[0]
    if section in ("level", "encoded level"):
        return "=" + (value.lower() if name in spellings else value)
    return "*"


def declared_sections(found: DataFrame) -> DataFrame:
    """One row per section of a comparison of declarations."""
    return found.groupBy("section").agg(
        F.count_if("in_v1").alias("v1_items"),
        F.count_if("in_v2").alias("v2_items"),
        F.count_if(F.col("in_v1") & F.col("in_v2")).alias("common_items"),
        F.when(F.count_if(F.col("in_v1") != F.col("in_v2")) == 0, "SAME").otherwise("DIFFERENT").alias("status"),
    )


def promotion_record(both: DataFrame, previous: str, promoted: str, features: int) -> DataFrame:
    """One row: versions, threshold, feature count and the disagreement statistics."""
    difference = F.abs(F.col(P1) - F.col(P2))
    disagree = F.count_if(F.col(L1) != F.col(L2))
    return both.agg(
        F.count("*").alias("shadow_rows"),
        disagree.alias("shadow_label_disagreements"),
        F.round(disagree / F.count("*"), 4).alias("shadow_disagreement_rate"),
        F.round(F.max(difference), 4).alias("shadow_max_probability_difference"),
        F.round(F.avg(difference), 4).alias("shadow_mean_probability_difference"),
    ).select(
        F.lit(previous).alias("previous_active_version"),
        F.lit(promoted).alias("promoted_version"),
        F.lit(PRODUCTION_THRESHOLD).alias("decision_threshold"),
        F.lit(features).alias("transformed_feature_count"),
        "*",
    )
