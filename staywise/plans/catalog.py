"""Named jobs over a folder of tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.functions.expressions import flag_number, is_positive, label_strict, logistic, to_number
from staywise.operators import (
    compare,
    contract,
    evaluation,
    explain,
    features,
    portfolio,
    profile,
    scenarios,
    scoring,
    training,
    trees,
)
from staywise.operators.ordering import fit_medians
from staywise.plans.feed import LIFETIME_FAULTS, raw_feed, text_feed
from staywise.plans.mart import (
    ADDONS,
    MART_CONTRACT,
    MART_DOMAINS,
    MART_ROLES,
    MART_RULES,
    NARROW_CONTRACT,
    load_mart,
    subscriber_mart,
)
from staywise.plans.scorecards import ARCHETYPES, BASELINE, CARDS, SCENARIOS, SCORECARD_V1, SCORECARD_V2
from staywise.session import fresh_path, stage
from staywise.sources import bundle, readers, writers
from staywise.streaming.scoring import ACCEPTED, REFUSED, read_counts, read_quarantine, read_scored, start_scoring

Job = Callable[[SparkSession, str], DataFrame]
ROLES, RULES, SPEC = MART_ROLES, MART_RULES, MART_CONTRACT
SEED = 42
PROBABILITY = scoring.PROBABILITY

jobs: dict[str, Job] = {}


def job(function: Job) -> Job:
    jobs[function.__name__] = function
    return function


# --- shared inputs ---------------------------------------------------------


def clean(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted mart rows with id and target."""
    return contract.accepted(load_mart(spark, folder), SPEC, [ROLES.id, ROLES.target])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.with_tiers(scoring.with_score(clean(spark, folder), SCORECARD_V1))
    return rows.withColumn("label", is_positive(ROLES.target, ROLES.positive))


def scored_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """(model, label, score) of both frozen scorecards over the same rows."""
    both = compare.score_both(clean(spark, folder), SCORECARD_V1, SCORECARD_V2)
    pair = F.array(
        *[
            F.struct(F.lit(f"scorecard_{v}").alias("model"), F.col(f"{v}_{PROBABILITY}").alias("score"))
            for v in ("v1", "v2")
        ]
    )
    return both.select(is_positive(ROLES.target, ROLES.positive).alias("label"), F.explode(pair).alias("s")).select(
        "s.model", "label", "s.score"
    )


def both_versions(spark: SparkSession, folder: str) -> DataFrame:
    return compare.score_both(clean(spark, folder), SCORECARD_V1, SCORECARD_V2)


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return raw_feed(load_mart(spark, folder))


# --- sources and sinks -----------------------------------------------------


@job
def subscriber_table(spark, folder):
    return subscriber_mart(spark, folder).withColumn(ROLES.revenue, F.round(ROLES.revenue, 8))


@job
def csv_scan_imputed(spark, folder):
    path = fresh_path(spark, "subscribers-csv")
    mart = load_mart(spark, folder)
    lifetime = F.col(ROLES.lifetime).cast("decimal(18,2)").cast("string")
    for at in (3, 4):
        lifetime = F.when(F.col(ROLES.id) % 25 == at, LIFETIME_FAULTS[at]).otherwise(lifetime)
    columns = ["customerID", "Contract", "tenure", "TotalCharges", "Churn"]
    writers.write_csv(mart.withColumn(ROLES.lifetime, lifetime).select(columns), path)
    schema = T.StructType(
        [
            T.StructField("customerID", T.LongType()),
            T.StructField("Contract", T.StringType()),
            T.StructField("tenure", T.IntegerType()),
            T.StructField("TotalCharges", T.StringType()),
            T.StructField("Churn", T.StringType()),
        ]
    )
    loaded = readers.load_subscribers(spark, path, schema, ROLES.lifetime)
    return loaded.withColumn(ROLES.lifetime, F.round(ROLES.lifetime, 4))


@job
def csv_upload_checked(spark, folder):
    path = fresh_path(spark, "upload-csv")
    writers.write_csv(feed(spark, folder), path)
    upload = readers.read_csv_text(spark, path)
    return contract.accepted(upload, SPEC, [ROLES.id]).withColumn(ROLES.id, F.col(ROLES.id).cast("bigint"))


@job
def json_lines_scan(spark, folder):
    path = fresh_path(spark, "records-json")
    writers.write_json(text_feed(load_mart(spark, folder)), path)
    records = readers.read_json_records(spark, path, [ROLES.id, *ROLES.features])
    return records.groupBy("Contract", "Segment").agg(
        F.count("*").alias("records"),
        F.round(F.sum(to_number("TotalCharges", T.StringType())), 2).alias("lifetime"),
    )


def request_bodies(spark, folder) -> tuple[DataFrame, str, list[str]]:
    """One request per subscriber, in every form a body may have; every tenth can't be read."""
    columns = [ROLES.id, *ROLES.features]
    texts = text_feed(load_mart(spark, folder)).select([F.col(c).cast("string").alias(c) for c in columns])
    kind = F.col(ROLES.id).cast("bigint") % 5

    def line(names: list[str]) -> Column:
        cells = [F.coalesce(F.col(c), F.lit("")) for c in names]
        return F.concat(F.lit(",".join(names) + "\n"), F.concat_ws(",", *cells), F.lit("\n"))

    # Another order of columns, and a value with a comma, a quote and a line break.
    noted = F.concat(F.lit('"'), F.col("Segment"), F.lit(', ""new""\nunit"'))
    turned = texts.withColumn("Segment", noted).withColumn("body", F.to_json(F.struct(line(columns[::-1]).alias("csv_content"))))
    body = (
        F.when(kind == 1, F.to_json(F.struct(F.array(F.struct(*columns)).alias("records"))))
        .when(kind == 2, F.to_json(F.array(F.struct(*columns))))
        .when(kind == 3, line(columns))
        .when(F.col(ROLES.id).cast("bigint") % 10 == 4, F.concat(F.lit("not json "), F.col(ROLES.id)))
        .otherwise(F.to_json(F.struct(line(columns).alias("csv_content"))))
    )
    bodies = texts.where(kind != 0).select(ROLES.id, body.alias("body"))
    return bodies.unionByName(turned.where(kind == 0).select(ROLES.id, "body")), "body", columns


@job
def json_request_records(spark, folder):
    """Records of every readable request."""
    records = readers.parse_requests(*request_bodies(spark, folder))
    return records.select(F.col(ROLES.id).cast("bigint").alias(ROLES.id), "Contract", "Segment", "tenure", "TotalCharges")


@job
def refused_requests(spark, folder):
    refused = readers.refused_requests(*request_bodies(spark, folder))
    return refused.select(F.col(ROLES.id).cast("bigint").alias(ROLES.id), "body", "reason")


@job
def empty_batch_summary(spark, folder):
    nobody = scored(spark, folder).where(F.col(ROLES.contract) == "Five year")
    return scoring.batch_summary(nobody)


@job
def upload_template(spark, folder):
    return writers.schema_template(load_mart(spark, folder).select(ROLES.id, *ROLES.features, ROLES.target), ROLES.id, ROLES.target)


@job
def filtered_export(spark, folder):
    """Churned subscribers with every column; numbers that may differ in their last digits are rounded."""
    path = fresh_path(spark, "churned-csv")
    churned = load_mart(spark, folder).where(F.col(ROLES.target) == ROLES.positive)
    writers.write_csv(churned, path)
    return readers.read_csv(spark, path, churned.schema).withColumn(ROLES.revenue, F.round(ROLES.revenue, 8))


@job
def scored_export(spark, folder):
    """Every input column behind the scores."""
    path = fresh_path(spark, "scored-csv")
    export = writers.scored_export(scored(spark, folder), [ROLES.id], ROLES.features)
    writers.write_csv(export, path)
    return spark.read.schema(export.schema).option("header", True).csv(path).withColumn(ROLES.revenue, F.round(ROLES.revenue, 8))


def artifacts(spark, folder) -> tuple[str, dict[str, DataFrame]]:
    """The folder of written analysis artifacts, and what was written to each."""
    path = fresh_path(spark, "analysis")
    rows = stage(scored(spark, folder).select(PROBABILITY, "label"), "scored")
    sweep = evaluation.threshold_sweep(rows, PROBABILITY, "label")
    tables = {
        "calibration_analysis": evaluation.calibration_table(rows, PROBABILITY, "label"),
        "roc_curve": evaluation.roc_curve(rows, PROBABILITY, "label"),
        "precision_recall_curve": evaluation.precision_recall_curve(rows, PROBABILITY, "label"),
    }
    writers.write_analysis(path, sweep, tables)
    return path, {"threshold_analysis": sweep} | tables


@job
def analysis_artifacts(spark, folder):
    path, written = artifacts(spark, folder)
    return spark.read.schema(written["threshold_analysis"].schema).option("header", True).csv(f"{path}/threshold_analysis_csv")


@job
def analysis_artifact_rows(spark, folder):
    """Every JSON artifact read back: its rows and the sum of one number column."""
    path, written = artifacts(spark, folder)
    summed = {"threshold_analysis": "f1", "calibration_analysis": "mean_predicted_probability", "roc_curve": "tpr", "precision_recall_curve": "precision"}
    read = [
        spark.read.schema(table.schema).json(f"{path}/{name}").agg(
            F.lit(name).alias("artifact"), F.count("*").alias("records"), F.lit(summed[name]).alias("summed"), F.round(F.sum(summed[name]), 4).alias("total")
        )
        for name, table in written.items()
    ]
    return reduce(DataFrame.unionByName, read)


@job
def shadow_export(spark, folder):
    path = fresh_path(spark, "shadow-csv")
    rows = compare.comparison_rows(both_versions(spark, folder), ROLES.id, ROLES.target)
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@job
def synthesized_ids(spark, folder):
    rows = load_mart(spark, folder).select(ROLES.id, "Segment")
    return scoring.synthesized_ids(rows, ROLES.id).select(ROLES.id, "row", "synthetic_id")


# --- contract --------------------------------------------------------------


@job
def contract_accepted(spark, folder):
    return contract.accepted(feed(spark, folder), SPEC, [ROLES.id])


@job
def contract_rejected(spark, folder):
    refused = contract.rejected(feed(spark, folder), SPEC, [ROLES.id])
    named = F.transform("violations", lambda v: F.concat_ws(":", v["feature"], v["rule"]))
    return refused.select(ROLES.id, F.array_join(F.sort_array(named), "|").alias("reasons"))


@job
def strict_batches(spark, folder):
    """Strict mode over the whole feed and over its conforming part: rows taken, or the refusal."""
    whole = feed(spark, folder)
    conforming = whole.where(contract.conforms_sql(whole.schema, SPEC))
    outcomes = []
    for name, batch in (("feed", whole), ("conforming", conforming)):
        try:
            outcomes.append((name, contract.strict(batch, SPEC, [ROLES.id]).count(), None))
        except contract.ContractViolation as refused:
            outcomes.append((name, 0, str(refused)))
    return spark.createDataFrame(outcomes, "batch string, records bigint, refusal string")


@job
def guarded_batches(spark, folder):
    """A faulty, a conforming and an empty batch, each judged in the pass that writes it: both parts as written, and what strict mode says."""
    whole = feed(spark, folder)
    batches = {"feed": whole, "conforming": whole.where(contract.conforms_sql(whole.schema, SPEC)), "empty": whole.where(F.lit(False))}
    parts = []
    for name, batch in batches.items():
        guarded = contract.guard(batch, SPEC, [ROLES.id])
        for part, rows, found in (
            (contract.ACCEPTED, guarded.accepted, F.lit(0).cast("bigint")),
            (contract.REFUSED, guarded.refused, F.coalesce(F.sum(F.size("violations")), F.lit(0).cast("bigint"))),
        ):
            parts.append(
                rows.agg(
                    F.lit(name).alias("batch"),
                    F.lit(part).alias("part"),
                    F.lit(guarded.records[part]).cast("bigint").alias("counted"),
                    F.count("*").alias("written"),
                    found.alias("findings"),
                    F.lit(guarded.refusal).cast("string").alias("refusal"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


@job
def required_columns(spark, folder):
    """Uploads with all, with fewer and with reordered and further columns: each required column, and whether the upload is taken."""
    whole = feed(spark, folder)
    uploads = {
        "complete": whole,
        "incomplete": whole.drop("tenure", "Contract"),
        "reordered": whole.select(*whole.columns[::-1], F.lit("x").alias("further")),
    }
    parts = []
    for name, upload in uploads.items():
        try:
            contract.require_columns(upload.columns, SPEC)
            refusal = None
        except contract.ContractViolation as refused:
            refusal = str(refused)
        found = contract.required_report(upload, SPEC)
        parts.append(found.select(F.lit(name).alias("upload"), "feature", "present", "missing", F.lit(refusal).cast("string").alias("refusal")))
    return reduce(DataFrame.unionByName, parts)


@job
def flag_normalised(spark, folder):
    rows = feed(spark, folder).select(F.lower(F.trim("SeniorCitizen")).alias("token"), flag_number("SeniorCitizen").alias("flag"))
    return rows.groupBy("token", "flag").agg(F.count("*").alias("records"))


@job
def missing_value_counts(spark, folder):
    return contract.missing_counts(feed(spark, folder), [*ROLES.features, ROLES.target])


@job
def numeric_coercion(spark, folder):
    raw = feed(spark, folder)
    number = to_number("MonthlyCharges", T.StringType())
    kind = F.when(number.isNull(), "missing").when(F.abs(number) == float("inf"), "infinite").otherwise("number")
    return raw.select(ROLES.id, kind.alias("kind"), F.when(kind == "number", number).alias("value"))


@job
def imputed_lifetime(spark, folder):
    raw = feed(spark, folder)
    cleaned = contract.clean_columns(raw.schema, SPEC)["TotalCharges"]
    finite = F.when(F.abs(cleaned) < float("inf"), F.round(cleaned, 4))
    was_missing = to_number("TotalCharges", T.StringType()).isNull()
    return raw.select(ROLES.id, was_missing.alias("imputed"), finite.alias("TotalCharges"))


@job
def missing_measurements(spark, folder):
    found = contract.findings(feed(spark, folder), SPEC, [ROLES.id])
    return found.where((F.col("rule") == contract.MISSING) & F.col("feature").isin("tenure", "MonthlyCharges")).select(
        ROLES.id, "feature", F.coalesce("value", F.lit("")).alias("value")
    )


@job
def infinity_report(spark, folder):
    return contract.infinity_report(feed(spark, folder), SPEC)


@job
def category_bad_values(spark, folder):
    return contract.bad_value_report(feed(spark, folder), SPEC)


@job
def violation_report(spark, folder):
    return contract.violation_report(feed(spark, folder), SPEC)


@job
def label_encoding(spark, folder):
    rows = feed(spark, folder).select(
        F.col(ROLES.target).alias("raw"),
        label_strict(ROLES.target, ROLES.positive, ROLES.negative).alias("strict"),
        is_positive(ROLES.target, ROLES.positive).alias("loose"),
    )
    return rows.groupBy("raw", "strict", "loose").agg(F.count("*").alias("records"))


@job
def lifetime_spend_proxy(spark, folder):
    proxy = contract.lifetime_proxy(ROLES.revenue, ROLES.tenure)
    return load_mart(spark, folder).select(ROLES.id, F.round(proxy, 4).alias("lifetime_proxy"))


COHORT_CONTRACTS = ("Month-to-month", "Two year")
COHORT_SERVICES = ("BUILDING", "MACHINERY")


@job
def cohort_members(spark, folder):
    chosen = portfolio.cohort_slice(load_mart(spark, folder), ROLES, COHORT_CONTRACTS, COHORT_SERVICES)
    return chosen.select(ROLES.id, "Contract", "Segment", "Churn")


@job
def cohort_coverage(spark, folder):
    return portfolio.cohort_coverage(load_mart(spark, folder), ROLES, COHORT_CONTRACTS, COHORT_SERVICES)


SEARCH_PATTERN = "^m.*y$|urgent|^77$"


@job
def keyword_search(spark, folder):
    mart = load_mart(spark, folder)
    found = portfolio.keyword_search(mart, SEARCH_PATTERN, mart.columns)
    return found.select(ROLES.id, "Segment", "PaymentMethod")


@job
def churned_preview(spark, folder):
    rows = portfolio.churned_preview(load_mart(spark, folder), ROLES)
    return rows.select(ROLES.id, "Region", "Segment", "Contract", "tenure", "Churn")


@job
def search_match_count(spark, folder):
    mart = load_mart(spark, folder)
    found = portfolio.keyword_search(mart, SEARCH_PATTERN, mart.columns)
    return found.agg(F.count("*").alias("matches"), F.count_if(F.col(ROLES.target) == ROLES.positive).alias("churned_matches"))


@job
def domain_discovery(spark, folder):
    return profile.domain_discovery(load_mart(spark, folder), ROLES.categoricals)


@job
def contract_description(spark, folder):
    return contract.describe_contract(SPEC, load_mart(spark, folder))


# --- portfolio and profile -------------------------------------------------


@job
def portfolio_kpis(spark, folder):
    return portfolio.portfolio_kpis(load_mart(spark, folder), ROLES)


@job
def revenue_by_contract(spark, folder):
    return portfolio.revenue_by_contract(load_mart(spark, folder), ROLES)


@job
def churn_distribution(spark, folder):
    return portfolio.churn_distribution(load_mart(spark, folder), ROLES)


@job
def tenure_histogram(spark, folder):
    return portfolio.histogram(load_mart(spark, folder), ROLES.tenure, 0.0, 2.0, [ROLES.target])


@job
def strategic_signals(spark, folder):
    return portfolio.strategic_signals(load_mart(spark, folder), ROLES, RULES)


@job
def revenue_at_risk(spark, folder):
    return portfolio.revenue_at_risk(load_mart(spark, folder), ROLES)


@job
def vulnerability_stats(spark, folder):
    return portfolio.vulnerability_stats(load_mart(spark, folder), ROLES, RULES)


@job
def churn_by_category(spark, folder):
    return portfolio.churn_by_category(load_mart(spark, folder), ROLES, ROLES.categoricals)


@job
def contract_contingency(spark, folder):
    return portfolio.contingency(load_mart(spark, folder), ROLES.contract, ROLES)


@job
def revenue_hierarchy(spark, folder):
    return portfolio.revenue_hierarchy(
        load_mart(spark, folder), [ROLES.service, ROLES.contract, ROLES.target], ROLES.revenue
    )


@job
def pearson_matrix(spark, folder):
    return profile.correlation_matrix(load_mart(spark, folder), ROLES.numerics, ROLES)


@job
def bill_histogram(spark, folder):
    return portfolio.histogram(load_mart(spark, folder), ROLES.revenue, 0.0, 6000.0, [ROLES.target])


@job
def numeric_box_by_churn(spark, folder):
    return profile.box_summary(load_mart(spark, folder), ROLES.numerics, [ROLES.target])


@job
def numeric_box_by_contract_churn(spark, folder):
    return profile.box_summary(
        load_mart(spark, folder), [ROLES.revenue, ROLES.tenure], [ROLES.contract, ROLES.target]
    )


@job
def missing_profile(spark, folder):
    return profile.missing_profile(load_mart(spark, folder)).drop("dtype")


@job
def numeric_description(spark, folder):
    return profile.describe_numeric(load_mart(spark, folder), ROLES.numerics)


@job
def category_description(spark, folder):
    return profile.describe_categories(load_mart(spark, folder), ROLES.categoricals)


@job
def distinct_counts(spark, folder):
    return profile.distinct_counts(load_mart(spark, folder), [ROLES.id, *ROLES.features, ROLES.target])


@job
def distinct_sketch_bounds(spark, folder):
    """Exact distinct values of every column, and whether stored sketches, merged with those of later rows, come within their bound."""
    rows = load_mart(spark, folder)
    columns = [ROLES.id, *ROLES.features, ROLES.target]
    path = fresh_path(spark, "sketches")
    early = F.pmod(F.xxhash64(ROLES.id), F.lit(5)) != 0
    for arrivals in (rows.where(early), rows.where(~early)):
        profile.distinct_sketches(arrivals, columns, ["Contract"]).write.mode("append").parquet(path)
    counted = profile.sketched_counts(spark.read.parquet(path))
    exact = profile.distinct_counts(rows, columns)
    near = F.abs(F.col("estimate") - F.col("distinct_values")) <= F.lit(3 * profile.SKETCH_ERROR) * F.col("distinct_values")
    return exact.join(counted, "feature").select("feature", "distinct_values", near.alias("within_bound"))


@job
def addon_shield(spark, folder):
    return portfolio.addon_shield(load_mart(spark, folder), ROLES)


@job
def service_churn_rates(spark, folder):
    return portfolio.churn_by_category(load_mart(spark, folder), ROLES, ADDONS)


@job
def payment_friction(spark, folder):
    return portfolio.payment_friction(load_mart(spark, folder), ROLES)


@job
def value_quadrants(spark, folder):
    return portfolio.value_quadrants(load_mart(spark, folder), ROLES)


@job
def seeded_sample(spark, folder):
    return profile.ordered_sample(load_mart(spark, folder), ROLES.id, 200, SEED).select(ROLES.id, "Contract", "Churn")


# --- features and models ---------------------------------------------------


@job
def stratified_split(spark, folder):
    return features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target).select(
        ROLES.id, ROLES.target, "is_test"
    )


@job
def stratified_folds(spark, folder):
    return features.stratified_folds(load_mart(spark, folder), ROLES.id, ROLES.target).select(
        ROLES.id, ROLES.target, "fold"
    )


@job
def fitted_levels(spark, folder):
    """Levels that the training part shows of every category, with its records and those of the test part."""
    split = features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target)
    categories = [c for c in ROLES.features if c not in ROLES.numerics]
    learned = features.learned_levels(split.where(~F.col("is_test")), categories)
    known = spark.createDataFrame([(c, level) for c, levels in learned.items() for level in levels], "feature string, level string")
    counts = [
        profile.domain_discovery(split.where(part), categories).withColumnRenamed("n", name)
        for name, part in (("train_records", ~F.col("is_test")), ("test_records", F.col("is_test")))
    ]
    joined = known.join(counts[0], ["feature", "level"], "left").join(counts[1], ["feature", "level"], "left")
    return joined.fillna(0, ["train_records", "test_records"])


@job
def scaling_statistics(spark, folder):
    """Learned on the training part only."""
    split = features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target)
    train = split.where(~F.col("is_test"))
    return features.numeric_statistics(train, ROLES.numerics).select(
        "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")
    )


@job
def standardised_numerics(spark, folder):
    card = SCORECARD_V1
    numbers = [f for f in card.features if f.level is None]
    wide = features.encode(clean(spark, folder), numbers, card.means, card.deviations, [ROLES.id])
    return wide.select(ROLES.id, *[F.round(f.name, 9).alias(f.name) for f in numbers])


def _indicator_totals(spark, folder, card):
    levels = [f for f in card.features if f.level is not None]
    wide = features.encode(clean(spark, folder), levels, card.means, card.deviations, [])
    return features.feature_totals(wide, levels).select("feature", "raw_feature", "level", "label", "rows", "total")


@job
def one_hot_drop_first(spark, folder):
    return _indicator_totals(spark, folder, SCORECARD_V1)


@job
def one_hot_all_levels(spark, folder):
    return _indicator_totals(spark, folder, SCORECARD_V2)


@job
def fitted_medians(spark, folder):
    train = features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target).where(~F.col("is_test"))
    found = fit_medians(train, ROLES.numerics)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("median")) for n, v in found.items()])
    return train.agg(F.count("*").alias("train_rows")).select("train_rows", F.inline(cells)).select(
        "feature", F.round("median", 4).alias("median"), "train_rows"
    )


@job
def fitted_modes(spark, folder):
    train = features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target).where(~F.col("is_test"))
    return features.most_frequent(train, ROLES.categoricals)


@job
def feature_dictionary(spark, folder):
    """Dictionary of measured columns and discovered levels: name, source column, level, label, reference flag."""
    mart = load_mart(spark, folder)
    seen = profile.domain_discovery(mart, ROLES.categoricals)
    smallest = seen.groupBy("feature").agg(F.min("level").alias("reference"))
    levels = seen.join(smallest, "feature").select(
        F.concat(F.lit("cat__"), "feature", F.lit("_"), "level").alias("feature"),
        F.col("feature").alias("raw_feature"),
        "level",
        F.concat("feature", F.lit(" = "), "level").alias("label"),
        (F.col("level") == F.col("reference")).alias("is_reference"),
        F.col("n").alias("records"),
    )
    measured = F.array(*[F.struct(F.lit(name).alias("raw_feature"), F.count(name).alias("records")) for name in ROLES.numerics])
    numbers = mart.agg(measured.alias("cells")).select(F.inline("cells")).select(
        F.concat(F.lit("num__"), "raw_feature").alias("feature"),
        "raw_feature",
        F.lit(None).cast("string").alias("level"),
        F.col("raw_feature").alias("label"),
        F.lit(False).alias("is_reference"),
        "records",
    )
    return levels.unionByName(numbers)


@job
def model_test_metrics(spark, folder):
    return evaluation.model_metrics(stage(scored_by_model(spark, folder), "scored"), "score", "label", 0.5, ["model"])


@job
def model_leaderboard(spark, folder):
    return evaluation.leaderboard(model_test_metrics(spark, folder))


@job
def champion_by_auc(spark, folder):
    return evaluation.champion(model_test_metrics(spark, folder), "roc_auc").select("model", "roc_auc")


@job
def scorecard_importance(spark, folder):
    """Ten largest weights by magnitude with the number of subscribers each input is different from zero for."""
    card = SCORECARD_V2
    rows = clean(spark, folder)
    touched = {f.name: F.count_if(F.col(f.raw) != 0 if f.level is None else F.col(f.raw) == f.level) for f in card.features}
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("feature"), F.lit(float(abs(card.weights[f.name]))).alias("importance"), touched[f.name].alias("subscribers"))
        for f in card.features
    ])
    return training.top_features(rows.agg(cells.alias("cells")).select(F.inline("cells")), 10)


_prepared: dict[tuple[str, str, bool], training.PreparedData] = {}
_legacy: dict[tuple[str, str], tuple[DataFrame, DataFrame, dict[str, Model]]] = {}
_searches: dict[tuple[str, str, str], tuple[DataFrame, training.Candidate]] = {}


def prepared(spark, folder, drop_first=False) -> training.PreparedData:
    """Assembled training and test rows, prepared once per application and folder."""
    key = (spark.sparkContext.applicationId, folder, drop_first)
    if key not in _prepared:
        _prepared[key] = training.prepare(load_mart(spark, folder), ROLES, MART_DOMAINS, drop_first)
    return _prepared[key]


def fixed_models(spark, folder) -> tuple[DataFrame, DataFrame, dict[str, Model]]:
    """The four classifiers at fixed settings with their metrics, fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _legacy:
        _legacy[key] = training.train_legacy(prepared(spark, folder, drop_first=True), ROLES.id)
    return _legacy[key]


def searched(spark, folder, *names) -> list[tuple[DataFrame, training.Candidate]]:
    """Grid searches of classifiers, each run once per application and folder, together with the others that are asked for."""
    key = (spark.sparkContext.applicationId, folder)
    missing = {name: fresh_path(spark, "out-of-fold") for name in names if (*key, name) not in _searches}
    if missing:
        for name, found in training.search_all(prepared(spark, folder), missing).items():
            _searches[*key, name] = found
    return [_searches[*key, name] for name in names]


@job
def trained_models(spark, folder):
    """The four classifiers at fixed settings, their test metrics and the F1 champion."""
    metrics, best, _ = fixed_models(spark, folder)
    return metrics.join(best.select("model", F.lit(True).alias("best")), "model", "left").withColumn(
        "best", F.coalesce("best", F.lit(False))
    )


@job
def model_metric_checks(spark, folder):
    """Per fixed-setting model: the test rows, and how many of its figures differ from those of Spark's own evaluators."""
    data = prepared(spark, folder, drop_first=True)
    metrics, best, models = fixed_models(spark, folder)
    own = {row["model"]: row.asDict() for row in metrics.collect()}
    champions = {row["model"] for row in best.collect()}
    rows = training.score_models(models, data.test, ROLES.id).withColumns(
        {"label": F.col("label").cast("double"), "predicted": (F.col("score") >= 0.5).cast("double")}
    )
    by_label = {"labelCol": "label", "predictionCol": "predicted", "metricLabel": 1.0}
    evaluators = {
        "roc_auc": BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", metricName="areaUnderROC", numBins=0),
        "accuracy": MulticlassClassificationEvaluator(metricName="accuracy", **by_label),
        "precision": MulticlassClassificationEvaluator(metricName="precisionByLabel", **by_label),
        "recall": MulticlassClassificationEvaluator(metricName="recallByLabel", **by_label),
        "f1": MulticlassClassificationEvaluator(metricName="fMeasureByLabel", **by_label),
    }

    def checked(name: str) -> DataFrame:
        of_model = rows.where(F.col("model") == name)
        # The library's figures have four digits; Spark has none for a class that is never predicted.
        called = of_model.agg(F.sum("predicted")).first()[0]
        asked = evaluators if called else {m: e for m, e in evaluators.items() if m in ("roc_auc", "accuracy")}
        apart = sum(abs(e.evaluate(of_model) - own[name][metric]) > 0.00005 + 1e-9 for metric, e in asked.items())
        leads = own[name]["f1"] == max(found["f1"] for found in own.values())
        return of_model.agg(
            F.lit(name).alias("model"),
            F.count("*").alias("records"),
            F.sum("label").cast("bigint").alias("positives"),
            F.count_if(~F.col("score").between(0.0, 1.0) | F.isnan("score") | F.col("score").isNull()).alias("improper_scores"),
            F.lit(int(apart)).cast("bigint").alias("figures_apart"),
            F.lit(leads or name not in champions).alias("champion_leads"),
        )

    with ThreadPoolExecutor(len(models)) as pool:
        return reduce(DataFrame.unionByName, pool.map(checked, models))


@job
def fold_statistics(spark, folder):
    """What each fold's preparation has learned from the rows outside it."""
    data = prepared(spark, folder)
    learned = {fold: training.fold_preparation(data, fold) for fold in range(training.FOLDS)}
    rows = [(k, n, float(p.medians[n]), float(p.means[n]), float(p.deviations[n])) for k, p in learned.items() for n in data.numerics]
    found = spark.createDataFrame(rows, "fold int, feature string, median double, mean double, deviation double")
    return found.withColumns({c: F.round(c, 4) for c in ("median", "mean", "deviation")})


@job
def searched_logistic(spark, folder):
    return searched(spark, folder, training.MODEL_NAMES[0])[0][0]


@job
def searched_decision_tree(spark, folder):
    return searched(spark, folder, training.MODEL_NAMES[1])[0][0]


@job
def searched_random_forest(spark, folder):
    return searched(spark, folder, training.MODEL_NAMES[2])[0][0]


@job
def searched_gradient_boosting(spark, folder):
    return searched(spark, folder, training.MODEL_NAMES[3])[0][0]


@job
def out_of_fold_auc(spark, folder):
    """Scores stored by the search for rows their models never saw, ranked anew: rows per fold and setting, and whether the figures agree."""
    parts = [training.out_of_fold(candidate, spark) for _, candidate in searched(spark, folder, *training.MODEL_NAMES[:2])]
    return reduce(DataFrame.unionByName, parts)


@job
def experiment_record(spark, folder):
    """All four searches; scores, test metrics and the winning model are written, the record read back."""
    path = fresh_path(spark, "experiment")
    data = prepared(spark, folder)
    candidates = [candidate for _, candidate in searched(spark, folder, *training.MODEL_NAMES)]
    record, best = training.experiment_record(data, candidates, ROLES.id)
    record.write.json(f"{path}/record")
    bundle.save_trained(spark, best.model, data.fitted, f"{path}/champion")
    return spark.read.schema(record.schema).json(f"{path}/record")


@job
def trained_version_scores(spark, folder):
    """A logistic model fitted on the mart, frozen into a bundle, loaded back and applied to every subscriber."""
    path = fresh_path(spark, "trained")
    data = prepared(spark, folder, drop_first=True)
    model = training.logistic_model(1.0, data.train_rows).fit(data.train)
    bundle.save_bundle(spark, training.frozen_scorecard(model, data, "v3"), path)
    rows = scoring.with_tiers(scoring.with_score(clean(spark, folder), bundle.load_bundle(spark, path)))
    return rows.select(ROLES.id, PROBABILITY, "prediction", "risk_level")


def active_ensemble(spark, folder):
    """Two fitted ensembles saved as bundles, a pointer to the boosted one, and what that pointer loads."""
    path = fresh_path(spark, "trained")
    data = prepared(spark, folder)
    for version, name, settings in (("forest", training.MODEL_NAMES[2], {"numTrees": 10, "maxDepth": 4}), ("boosted", training.MODEL_NAMES[3], {"maxIter": 10})):
        estimator = training.search_space(name, data.train_rows)[0].copy()
        bundle.save_trained(spark, estimator._set(**settings).fit(data.train), data.fitted, f"{path}/{version}")
        bundle.set_active(spark, path, version)
    return bundle.load_active_trained(spark, path)


@job
def trained_ensemble_scores(spark, folder):
    """Every accepted subscriber scored by the boosted ensemble that the active pointer names."""
    version, model, fitted = active_ensemble(spark, folder)
    rows = training.score_with_trained(feed(spark, folder), SPEC, fitted, model, ROLES.id)
    return rows.select(ROLES.id, F.lit(version).alias("version"), PROBABILITY, "churn_pct", "prediction")


@job
def ensemble_agreement(spark, folder):
    """The loaded ensemble's scores against a walk down its own node table, over every accepted subscriber."""
    version, model, fitted = active_ensemble(spark, folder)
    nodes = trees.read_trees(model)
    rows = training.score_with_trained(feed(spark, folder), SPEC, fitted, model, ROLES.id, carry=["features"])
    inputs = rows.select(PROBABILITY, "prediction", vector_to_array("features").alias("x"))
    walked = logistic(trees.ensemble_margin(nodes, lambda i: F.col("x")[i]))
    apart = inputs.select("*", walked.alias("walked"), F.abs(F.col(PROBABILITY) - walked).alias("apart"))
    return apart.agg(
        F.lit(version).alias("version"),
        F.count("*").alias("records"),
        F.count_if(F.col("apart") > 1e-9).alias("violations"),
        F.count_if((F.col("walked") >= 0.5) != (F.col("prediction") == "Yes")).alias("labels_apart"),
        (F.count_if(F.col(PROBABILITY).isNull() | (F.col(PROBABILITY) <= 0) | (F.col(PROBABILITY) >= 1)) == 0).alias("proper"),
        (F.max(PROBABILITY) > F.min(PROBABILITY)).alias("varied"),
    )


@job
def forest_importance(spark, folder):
    data = prepared(spark, folder)
    model = training.search_space(training.MODEL_NAMES[2], data.train_rows)[0].copy().setNumTrees(50).setMaxDepth(5).fit(data.train)
    return training.top_features(training.feature_importance(model, data.features, spark), 10)


# --- scoring ---------------------------------------------------------------


@job
def batch_scores(spark, folder):
    return scored(spark, folder).select(
        ROLES.id, F.round(PROBABILITY, 9).alias(PROBABILITY), F.round("margin", 9).alias("margin"), "prediction"
    )


@job
def both_class_percentages(spark, folder):
    return scoring.both_classes(scored(spark, folder), ROLES.id)


@job
def threshold_labels(spark, folder):
    rows = scored(spark, folder)
    return rows.groupBy("prediction", ROLES.target).agg(
        F.count("*").alias("records"), F.round(F.min(PROBABILITY), 9).alias("lowest"), F.round(F.max(PROBABILITY), 9).alias("highest")
    )


@job
def class_semantics(spark, folder):
    return scoring.class_semantics(load_mart(spark, folder), ROLES.target)


@job
def fitted_class_semantics(spark, folder):
    """Positive class as the metadata of an indexed target names it: in either order, and refused where both classes mean it."""
    churned = F.col(ROLES.target) == ROLES.positive
    rows = load_mart(spark, folder).where(F.col(ROLES.target).isNotNull()).select(
        F.col(ROLES.target).alias("plain"), F.when(churned, "yes").otherwise("1").alias("ambiguous")
    )
    found = None
    for case, column, order in (("ascending", "plain", "alphabetAsc"), ("descending", "plain", "alphabetDesc"), ("ambiguous", "ambiguous", "alphabetAsc")):
        indexed = StringIndexer(inputCol=column, outputCol="index", stringOrderType=order).fit(rows).transform(rows)
        labels = scoring.class_labels(indexed, "index")
        try:
            at = scoring.positive_index(labels)
        except ValueError:
            at = None
        part = indexed.agg(
            F.lit(case).alias("case_name"),
            F.lit(",".join(labels)).alias("labels"),
            F.lit(at).cast("int").alias("positive_index"),
            F.count("*").alias("records"),
            F.count_if(F.col("index") == F.lit(at).cast("double")).alias("positives"),
        )
        found = part if found is None else found.unionByName(part)
    return found


@job
def risk_tiers(spark, folder):
    return scored(spark, folder).select(ROLES.id, "churn_pct", "risk_tier", "risk_level", "risk_status")


@job
def batch_summary(spark, folder):
    return scoring.batch_summary(scored(spark, folder))


@job
def high_risk_revenue(spark, folder):
    return scoring.high_risk_revenue(scored(spark, folder), ROLES)


@job
def tier_distribution(spark, folder):
    return scoring.tier_distribution(scored(spark, folder))


@job
def probability_histogram(spark, folder):
    return scoring.probability_histogram(scored(spark, folder))


@job
def intervention_plan(spark, folder):
    found = scored(spark, folder).select(ROLES.id, F.posexplode(scoring.interventions(ROLES, RULES)).alias("position", "item"))
    return found.select(ROLES.id, (F.col("position") + 1).cast("bigint").alias("step"), "item.action", "item.impact", "item.priority")


@job
def intervention_counts(spark, folder):
    found = scored(spark, folder).select("risk_level", F.inline(scoring.interventions(ROLES, RULES)))
    return found.groupBy("action", "priority", "risk_level").agg(F.count("*").alias("subscribers"))


@job
def next_best_actions(spark, folder):
    rows = scored(spark, folder).select(F.explode(scoring.next_best_actions(ROLES, RULES)).alias("action"), "risk_tier")
    return rows.groupBy("action", "risk_tier").agg(F.count("*").alias("subscribers"))


@job
def value_at_risk_by_tier(spark, folder):
    return scoring.value_at_risk_by_tier(scored(spark, folder), ROLES)


@job
def result_records(spark, folder):
    rows = scoring.result_records(scored(spark, folder), ROLES)
    return rows.withColumn(ROLES.revenue, F.round(ROLES.revenue, 8))


@job
def active_version_scores(spark, folder):
    """Bundles for both versions, a pointer to one of them, and scores from the bundle it names."""
    path = fresh_path(spark, "bundles")
    for version, card in CARDS.items():
        bundle.save_bundle(spark, card, f"{path}/{version}")
    bundle.set_active(spark, path, "v2")
    card = bundle.load_active(spark, path)
    rows = scoring.with_score(clean(spark, folder), card)
    return rows.select(ROLES.id, F.lit(card.version).alias("version"), F.round(PROBABILITY, 9).alias(PROBABILITY), "prediction")


@job
def batch_invariance(spark, folder):
    mart = load_mart(spark, folder)
    part = mart.where(F.col(ROLES.contract) == RULES.flexible_contract)
    return scoring.batch_invariance(
        scoring.score_batch(mart, SPEC, SCORECARD_V1, [ROLES.id]),
        scoring.score_batch(part, SPEC, SCORECARD_V1, [ROLES.id]),
        ROLES.id,
    )


# --- evaluation ------------------------------------------------------------


@job
def metrics_at_half(spark, folder):
    return evaluation.metrics_at(scored(spark, folder), PROBABILITY, "label", 0.5)


@job
def threshold_sweep(spark, folder):
    return evaluation.threshold_sweep(scored(spark, folder), PROBABILITY, "label")


@job
def roc_curve(spark, folder):
    return evaluation.roc_curve(scored(spark, folder), PROBABILITY, "label")


@job
def roc_curve_reduced(spark, folder):
    return evaluation.roc_curve(scored(spark, folder), PROBABILITY, "label", drop_collinear=True)


@job
def precision_recall_curve(spark, folder):
    return evaluation.precision_recall_curve(scored(spark, folder), PROBABILITY, "label")


@job
def ranking_summary(spark, folder):
    return evaluation.ranking_summary(scored(spark, folder), PROBABILITY, "label")


@job
def ranking_by_segment(spark, folder):
    return evaluation.ranking_summary(scored(spark, folder), PROBABILITY, "label", [ROLES.service])


@job
def tied_ranking(spark, folder):
    """Ranking on whole percentages, where many subscribers share a score."""
    rows = scored(spark, folder).withColumn("whole_pct", F.floor("churn_pct").cast("double"))
    return evaluation.ranking_summary(rows, "whole_pct", "label")


@job
def brier_score(spark, folder):
    return evaluation.brier_score(scored(spark, folder), PROBABILITY, "label")


@job
def f1_threshold(spark, folder):
    return evaluation.f1_candidate(threshold_sweep(spark, folder))


@job
def recall_thresholds(spark, folder):
    return evaluation.recall_candidates(threshold_sweep(spark, folder), (0.15, 0.22, *evaluation.PRECISION_FLOORS))


@job
def calibration_table(spark, folder):
    return evaluation.calibration_table(scored(spark, folder), PROBABILITY, "label")


@job
def calibration_summary(spark, folder):
    return evaluation.calibration_summary(scored(spark, folder), PROBABILITY, "label")


@job
def split_summary(spark, folder):
    split = features.stratified_split(load_mart(spark, folder), ROLES.id, ROLES.target)
    labelled = split.withColumn("label", is_positive(ROLES.target, ROLES.positive))
    return evaluation.split_summary(labelled, "label", ["is_test"])


@job
def classification_report(spark, folder):
    return evaluation.classification_report(scored(spark, folder), ROLES.target, "prediction")


@job
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(scored(spark, folder), ROLES.target, "prediction")


@job
def threshold_report(spark, folder):
    """Everything about one scored table as (section, item, metric, value)."""
    rows = stage(scored(spark, folder).select(PROBABILITY, "label"), "scored")
    return evaluation.full_report(rows, PROBABILITY, "label")


@job
def labelled_documents_ranking(spark, folder):
    """The same exact ranking on another 0/1 target: text length against the quality label."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = documents.join(labels, "doc_id").where(F.col("quality").isNotNull())
    return evaluation.ranking_summary(rows.withColumn("length", F.col("n_chars").cast("double")), "length", "quality", ["lang"])


# --- explanation -----------------------------------------------------------


def background(spark, folder, card=SCORECARD_V1):
    return explain.fit_background(clean(spark, folder), card, ROLES.id)


@job
def background_reference(spark, folder):
    rows = profile.ordered_sample(clean(spark, folder), ROLES.id, explain.BACKGROUND_ROWS, explain.BACKGROUND_SEED)
    wide = features.encode(rows, SCORECARD_V1.features, SCORECARD_V1.means, SCORECARD_V1.deviations, [])
    return features.feature_totals(wide, SCORECARD_V1.features).select(
        "feature", "rows", F.round(F.col("total") / F.col("rows"), 9).alias("mean")
    )


@job
def linear_attribution(spark, folder):
    return explain.explain_rows(clean(spark, folder), SCORECARD_V1, background(spark, folder), ROLES.id).select(
        ROLES.id, "feature", "contribution"
    )


@job
def individual_explanations(spark, folder):
    rows = explain.explain_rows(clean(spark, folder), SCORECARD_V1, background(spark, folder), ROLES.id, top=5)
    return rows.drop("value")


@job
def explanation_totals(spark, folder):
    nested = explain.explain_nested(clean(spark, folder), SCORECARD_V1, background(spark, folder), ROLES.id)
    return nested.select(
        ROLES.id,
        F.round("base_value", 9).alias("base_value"),
        F.round("log_odds", 9).alias("log_odds"),
        (F.abs("reconstruction_error") < 1e-8).alias("additive"),
        F.size("top_increasing").cast("bigint").alias("increasing"),
        F.size("top_decreasing").cast("bigint").alias("decreasing"),
        F.col("top_increasing")[0].alias("strongest_increase"),
    )


def _sample(spark, folder):
    return profile.ordered_sample(clean(spark, folder), ROLES.id, explain.BACKGROUND_ROWS, explain.BACKGROUND_SEED)


@job
def global_importance_sampled(spark, folder):
    return explain.global_importance(_sample(spark, folder), SCORECARD_V1, background(spark, folder))


@job
def global_importance(spark, folder):
    return explain.global_importance(clean(spark, folder), SCORECARD_V1, background(spark, folder))


@job
def global_direction(spark, folder):
    return explain.global_direction(clean(spark, folder), SCORECARD_V1, background(spark, folder))


@job
def scenario_attribution_deltas(spark, folder):
    states = scenarios.scenario_states(clean(spark, folder), ROLES, RULES, SCENARIOS[1:], BASELINE)
    return explain.attribution_deltas(states, SCORECARD_V1, background(spark, folder), ROLES.id, ["scenario"])


@job
def attribution_additivity(spark, folder):
    found = explain.additivity(clean(spark, folder), SCORECARD_V1, background(spark, folder), ROLES.id)
    return found.select("records", (F.col("max_error") < 1e-8).alias("additive"))


@job
def stable_logistic(spark, folder):
    """The sigmoid far outside its comfortable range."""
    wide = scored(spark, folder).select(ROLES.id, (F.col("margin") * 400.0).alias("z"))
    return wide.select(ROLES.id, F.round(logistic(F.col("z")), 9).alias("p"))


@job
def explainer_choice(spark, folder):
    """Small models of each family, fitted on the mart: which exact explainer applies, or that none does, and the test rows it would explain."""
    data = prepared(spark, folder, drop_first=True)
    small = {"featuresCol": "features", "labelCol": "label", "seed": SEED}
    families = {
        "LogisticRegression": LogisticRegression(featuresCol="features", labelCol="label", maxIter=2),
        "DecisionTreeClassifier": DecisionTreeClassifier(maxDepth=2, **small),
        "RandomForestClassifier": RandomForestClassifier(maxDepth=2, numTrees=2, **small),
        "GBTClassifier": GBTClassifier(maxDepth=2, maxIter=2, **small),
        "LinearSVC": LinearSVC(featuresCol="features", labelCol="label", maxIter=2),
    }
    parts = []
    for name, family in families.items():
        model = family.fit(data.train)
        try:
            kind = trees.explainer_kind(model)
        except TypeError:
            kind = None
        rows = model.transform(data.test).agg(F.count("prediction").alias("records"))
        parts.append(rows.select(F.lit(name).alias("family"), F.lit(kind).cast("string").alias("explainer"), "records"))
    return reduce(DataFrame.unionByName, parts)


# A fixed two-tree ensemble over raw columns: feature 0 tenure, 1 MonthlyCharges, 2 SeniorCitizen.
FIXED_INPUTS = ("tenure", "MonthlyCharges", "SeniorCitizen")
FIXED_TREES = (
    trees.Tree(
        1.0,
        {
            0: trees.Node(0.0, 1000.0, 0, 60.0, 1, 2),
            1: trees.Node(0.0, 400.0, 1, 30000.0, 3, 4),
            2: trees.Node(0.0, 600.0, 0, 65.0, 5, 6),
            3: trees.Node(0.4, 150.0),
            4: trees.Node(0.9, 250.0),
            5: trees.Node(-0.2, 400.0),
            6: trees.Node(-0.7, 200.0),
        },
    ),
    trees.Tree(
        0.5,
        {
            0: trees.Node(0.0, 1000.0, 1, 40000.0, 1, 2),
            1: trees.Node(-0.3, 650.0),
            2: trees.Node(0.0, 350.0, 2, 0.5, 3, 4),
            3: trees.Node(0.1, 320.0),
            4: trees.Node(1.1, 30.0),
        },
    ),
)


def frozen_inputs(rows: DataFrame) -> DataFrame:
    return rows.select(ROLES.id, F.array(*[F.col(name).cast("double") for name in FIXED_INPUTS]).alias("x"))


def frozen_attributions(rows: DataFrame) -> DataFrame:
    return trees.array_attributions(frozen_inputs(rows), FIXED_TREES, ROLES.id, len(FIXED_INPUTS))


def frozen_margin() -> Column:
    return trees.ensemble_margin(FIXED_TREES, lambda i: F.col("x")[i])


@job
def fixed_tree_attribution(spark, folder):
    return frozen_attributions(clean(spark, folder)).select(
        ROLES.id, *[F.round(F.col("attributions")[i], 9).alias(f"phi_{name}") for i, name in enumerate(FIXED_INPUTS)]
    )


@job
def tree_scores(spark, folder):
    """Margin, probability, label and risk level of the frozen ensemble."""
    margin = frozen_inputs(clean(spark, folder)).select(ROLES.id, frozen_margin().alias("margin"))
    rows = margin.withColumn(PROBABILITY, logistic(F.col("margin")))
    return rows.select(
        ROLES.id,
        F.round("margin", 9).alias("margin"),
        F.round(PROBABILITY, 9).alias(PROBABILITY),
        F.when(F.col(PROBABILITY) >= 0.5, "Yes").otherwise("No").alias("prediction"),
    )


@job
def tree_additivity(spark, folder):
    """Base value, and how many rows' attributions and base value don't add up to their margin."""
    found = frozen_attributions(clean(spark, folder))
    whole = F.aggregate("attributions", F.lit(trees.base_value(FIXED_TREES)), lambda total, share: total + share)
    return found.agg(
        F.count("*").alias("records"),
        F.round(F.lit(trees.base_value(FIXED_TREES)), 9).alias("base_value"),
        F.count_if(F.abs(whole - frozen_margin()) > 1e-9).alias("violations"),
        F.round(F.sum(frozen_margin()), 4).alias("total_margin"),
    )


@job
def tree_top_attributions(spark, folder):
    """The two inputs that move each subscriber's score most."""
    ranked = trees.ranked_attributions(frozen_attributions(clean(spark, folder)), FIXED_INPUTS, ROLES.id, 2)
    return ranked.select(ROLES.id, "rank", "feature", F.round("value", 8).alias("value"), F.round("contribution", 9).alias("contribution"))


@job
def tree_attribution_change(spark, folder):
    """What a year more of tenure does to the attributions of each subscriber."""
    rows = clean(spark, folder)
    later = rows.withColumn("tenure", F.col("tenure") + 12)
    changed = trees.attribution_change(frozen_attributions(rows), frozen_attributions(later), FIXED_INPUTS, ROLES.id, 1)
    return changed.select(ROLES.id, "feature", F.round("delta", 9).alias("delta"))


@job
def boosted_tree_attribution(spark, folder):
    """Importance and direction of every feature of a boosted ensemble fitted on the mart, over all its rows."""
    data = prepared(spark, folder)
    estimator = training.search_space(training.MODEL_NAMES[3], data.train_rows)[0].copy().setMaxIter(50).setStepSize(0.1)
    model = estimator.fit(data.train)
    ensemble = trees.read_trees(model)
    names = [f.name for f in data.features]
    rows = data.train.select(ROLES.id, "features").unionByName(data.test.select(ROLES.id, "features"))
    found = stage(trees.tree_attributions(rows, ensemble, ROLES.id, "features", len(names)), "attributions")
    return trees.importance_from_attributions(found, names).join(trees.direction_from_attributions(found, names), "feature")


# --- version comparison ----------------------------------------------------


@job
def version_scores(spark, folder):
    rows = compare.comparison_rows(both_versions(spark, folder), ROLES.id, ROLES.target)
    return rows.drop("threshold")


@job
def probability_differences(spark, folder):
    return compare.probability_differences(both_versions(spark, folder))


@job
def label_agreement(spark, folder):
    return compare.label_agreement(both_versions(spark, folder))


@job
def disagreement_sample(spark, folder):
    return compare.disagreement_sample(both_versions(spark, folder), ROLES.id, ROLES.target)


@job
def threshold_proximity(spark, folder):
    return compare.threshold_proximity(both_versions(spark, folder))


@job
def determinism_check(spark, folder):
    columns = [ROLES.id, compare.P1, compare.P2, compare.L1, compare.L2]
    return compare.determinism_check(lambda: both_versions(spark, folder), columns)


@job
def contract_comparison(spark, folder):
    probes = compare.contract_probes("SeniorCitizen", "MonthlyCharges", "TotalCharges", "Contract")
    return compare.contract_comparison(text_feed(load_mart(spark, folder)), SPEC, NARROW_CONTRACT, probes, "tenure")


@job
def contract_declarations(spark, folder):
    """What the two versions declare, item by item, and how many records of the feed hold the item."""
    raw = text_feed(load_mart(spark, folder))
    return compare.declarations(raw, (SPEC, SCORECARD_V1), (NARROW_CONTRACT, SCORECARD_V2))


@job
def declared_sections(spark, folder):
    """Per section: items of either side, of both, and whether the versions agree."""
    return compare.declared_sections(contract_declarations(spark, folder))


@job
def feature_space(spark, folder):
    seen = profile.domain_discovery(clean(spark, folder), ROLES.categoricals)
    return compare.feature_space(SCORECARD_V1, SCORECARD_V2, seen)


@job
def explanation_compatibility(spark, folder):
    """Per version: explained features, additivity, finite attributions, repeatable ranking."""
    rows = clean(spark, folder)
    parts = None
    for card in CARDS.values():
        reference = background(spark, folder, card)
        twice = compare.determinism_check(
            lambda: explain.global_importance(rows, card, reference), ["feature", "mean_abs_contribution"]
        )
        sums = explain.additivity(rows, card, reference, ROLES.id)
        row = twice.select(F.lit(card.version).alias("version"), F.col("rows").alias("features"), "deterministic").join(
            sums.select(F.lit(card.version).alias("version"), "records", (F.col("max_error") < 1e-8).alias("additive")),
            "version",
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


@job
def promotion_record(spark, folder):
    return compare.promotion_record(both_versions(spark, folder), "v1", "v2", len(SCORECARD_V2.features))


@job
def bundle_verification(spark, folder):
    """Weights refitted to the mart's scaling are saved as a bundle, checked against its manifest and read back."""
    path = fresh_path(spark, "bundle")
    statistics = {r["feature"]: r for r in features.numeric_statistics(clean(spark, folder), ROLES.numerics).collect()}
    card = scoring.Scorecard(
        **{
            **SCORECARD_V1.__dict__,
            "version": "v1-rescaled",
            "means": {n: statistics[n]["mean"] for n in ROLES.numerics},
            "deviations": {n: statistics[n]["std"] for n in ROLES.numerics},
        }
    )
    bundle.save_bundle(spark, card, path)
    intact = bundle.verify_bundle(spark, path).agg(F.every("matches").alias("verified"), F.count("*").alias("files")).first()
    stored = bundle.load_bundle(spark, path)
    kept = [(n, stored.means[n], stored.deviations[n]) for n in stored.numerics]
    rows = spark.createDataFrame(kept, "feature string, mean double, deviation double")
    return rows.select(
        "feature",
        F.round("mean", 4).alias("mean"),
        F.round("deviation", 4).alias("deviation"),
        F.lit(intact["verified"]).alias("verified"),
        F.lit(intact["files"]).alias("files"),
    )


# --- scenarios -------------------------------------------------------------


def what_if(spark, folder):
    states = scenarios.scenario_states(clean(spark, folder), ROLES, RULES, SCENARIOS, BASELINE)
    return scenarios.rescored(states, SCORECARD_V1, ROLES)


@job
def what_if_scores(spark, folder):
    return what_if(spark, folder)


@job
def what_if_summary(spark, folder):
    return scenarios.scenario_summary(what_if(spark, folder))


@job
def best_scenario(spark, folder):
    return scenarios.best_scenario(clean(spark, folder), ROLES, RULES, SCORECARD_V1, SCENARIOS)


@job
def archetype_positions(spark, folder):
    return scenarios.archetype_positions(scored(spark, folder), SCORECARD_V1, ARCHETYPES, PROBABILITY)


RATES = (10, 25, 40)
OFFERS = (0.0, 25.0, 100.0)


@job
def campaign_economics(spark, folder):
    cohorts = scenarios.cohort_sizes(scored(spark, folder), ROLES, ["risk_tier"])
    return scenarios.campaign_economics(cohorts, ["risk_tier"], RATES, OFFERS)


@job
def flat_bill_economics(spark, folder):
    cohorts = scenarios.cohort_sizes(scored(spark, folder), ROLES, ["risk_level"])
    return scenarios.flat_bill_economics(cohorts, ["risk_level"], RATES)


@job
def playbook_pillars(spark, folder):
    return scenarios.playbook_pillars(load_mart(spark, folder), ROLES, RULES)


# --- streaming -------------------------------------------------------------


def _streamed(spark, folder):
    source, sinks = fresh_path(spark, "arrivals"), fresh_path(spark, "stream")
    arrivals = feed(spark, folder)
    arrivals.write.parquet(source)
    query = start_scoring(spark, source, arrivals.schema, sinks, ROLES, SPEC, RULES, SCORECARD_V1)
    query.awaitTermination()
    return sinks, arrivals


@job
def streamed_scores(spark, folder):
    sinks, arrivals = _streamed(spark, folder)
    rows = read_scored(spark, sinks, arrivals, ROLES, SPEC, RULES, SCORECARD_V1)
    return rows.select(ROLES.id, "prediction", "churn_pct", "no_churn_pct", "risk_level", F.array_join("actions", "|").alias("actions"))


@job
def streamed_quarantine(spark, folder):
    sinks, arrivals = _streamed(spark, folder)
    rows = read_quarantine(spark, sinks, arrivals, ROLES, SPEC, RULES, SCORECARD_V1)
    named = F.transform("violations", lambda v: F.concat_ws(":", v["feature"], v["rule"]))
    return rows.select(ROLES.id, ROLES.target, "channel", F.array_join(F.sort_array(named), "|").alias("reasons"))


@job
def stream_counts(spark, folder):
    """What the micro-batches counted, next to the rows that are there, per verdict."""
    sinks, _ = _streamed(spark, folder)
    there = spark.read.parquet(f"{sinks}/judged").groupBy("verdict").agg(F.count("*").alias("rows"))
    counted = read_counts(spark, sinks).agg(*[F.sum(name).alias(name) for name in (ACCEPTED, REFUSED)])
    per_verdict = counted.unpivot([], [ACCEPTED, REFUSED], "verdict", "counted")
    return per_verdict.join(there, "verdict", "left").select("verdict", "counted", F.coalesce("rows", F.lit(0)).alias("rows"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Mart, contract, scorecard and tiers, summarised per tier."""
    rows = scored(spark, folder)
    return rows.groupBy("risk_tier").agg(
        F.count("*").alias("subscribers"),
        F.sum("label").alias("churned"),
        portfolio.money(F.sum(ROLES.revenue)).alias("mrr"),
        F.round(F.avg(PROBABILITY), 6).alias("mean_probability"),
    )


jobs["tier_report"] = flagship
