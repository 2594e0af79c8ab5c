"""Scenarios, comparison, features, sources and streaming on small inputs."""

import pytest
from pyspark.sql import functions as F

from staywise.operators import compare, features, portfolio, profile, scenarios, scoring
from staywise.plans import catalog
from staywise.plans.mart import MART_CONTRACT, MART_ROLES, MART_RULES, load_mart, order_history
from staywise.plans.scorecards import BASELINE, SCENARIOS, SCORECARD_V1, SCORECARD_V2
from staywise.session import fresh_path
from staywise.sources import bundle, readers, writers
from staywise.streaming.scoring import ACCEPTED, REFUSED, judged, quarantined, read_counts, read_quarantine, read_scored, score_records, start_scoring
from staywise.telco import TELCO_CONTRACT, TELCO_ROLES, TELCO_SCHEMA
from tests.fixtures import ROWS, text_frame


def test_unchanged_scenario_changes_nothing(spark, small):
    rows = catalog.what_if(spark, small).where(F.col("scenario") == BASELINE.name)
    assert rows.where("delta_points <> 0 OR reduction_points <> 0").count() == 0
    best = scenarios.best_scenario(catalog.clean(spark, small), MART_ROLES, MART_RULES, SCORECARD_V1, SCENARIOS)
    lowest = catalog.what_if(spark, small).groupBy("customerID").agg(F.min("simulated_probability").alias("low"))
    assert best.join(lowest, "customerID").where("simulated_probability <> low").count() == 0


def test_campaign_economics(spark):
    cohort = spark.createDataFrame([("a", 1000, 75.0), ("b", 999, 75.0)], "tier string, customers bigint, bill double")
    rows = {r["tier"]: r for r in scenarios.campaign_economics(cohort, ["tier"], [25], [25.0]).collect()}
    assert (rows["a"]["saved_customers"], rows["a"]["campaign_cost"], rows["a"]["revenue_saved"]) == (250, 25000.0, 225000.0)
    assert (rows["a"]["net_profit"], rows["a"]["roi_pct"]) == (200000.0, 800.0)
    assert rows["b"]["saved_customers"] == 249
    assert scenarios.campaign_economics(cohort, ["tier"], [25], [0.0]).first()["roi_pct"] == 0.0
    flat = {r["tier"]: r for r in scenarios.flat_bill_economics(cohort, ["tier"], [25]).collect()}
    assert flat["b"]["saved_customers"] == 250 and flat["b"]["annual_revenue_saved"] == 225000.0


def test_comparison_refuses_other_thresholds(spark, small):
    with pytest.raises(ValueError):
        compare.score_both(catalog.clean(spark, small), SCORECARD_V1, SCORECARD_V2, 0.25)


def test_constant_scores_have_no_correlation(spark):
    both = spark.createDataFrame(
        [(0.5, 0.1, "Yes", "No"), (0.5, 0.9, "Yes", "Yes")], f"{compare.P1} double, {compare.P2} double, {compare.L1} string, {compare.L2} string"
    )
    row = compare.probability_differences(both).first()
    assert row["correlation"] is None and row["median_absolute_difference"] == 0.4


def test_same_versions_never_disagree(spark, small):
    both = compare.score_both(catalog.clean(spark, small), SCORECARD_V1, SCORECARD_V1)
    assert compare.label_agreement(both).first()["label_disagreement"] == 0
    assert compare.disagreement_sample(both, "customerID", "Churn").count() == 0


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, "Yes"), (1.0, 3.0, "No"), (1.0, None, "No")], "a double, b double, Churn string")
    rows = {(r["x"], r["y"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b"], MART_ROLES).collect()}
    assert rows[("a", "b")] is None and rows[("b", "b")] == 1.0 and rows[("b", "churn")] == rows[("churn", "b")] == -1.0


def test_rollup_totals_equal_their_leaves(spark, small):
    rows = portfolio.revenue_hierarchy(load_mart(spark, small), ["Segment", "Contract", "Churn"], "MonthlyCharges")
    sums = {r["depth"]: r["s"] for r in rows.groupBy("depth").agg(F.sum("mrr").alias("s")).collect()}
    assert len(sums) == 4 and max(sums.values()) - min(sums.values()) < 0.5


def test_split_is_exact_repeatable_and_handles_tiny_strata(spark):
    df = spark.range(103).select(
        F.concat(F.lit("id-"), "id").alias("k"), F.when(F.col("id") < 2, "rare").otherwise("common").alias("t")
    )
    split = features.stratified_split(df, "k", "t")
    counts = {(r["t"], r["is_test"]): r["count"] for r in split.groupBy("t", "is_test").count().collect()}
    assert counts == {("common", True): 20, ("common", False): 81, ("rare", False): 2}
    again = features.stratified_split(df.repartition(7), "k", "t")
    assert split.exceptAll(again).count() == 0
    folds = features.stratified_folds(df, "k", "t").where("t = 'common'").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 20, 20, 21]


def test_ties_of_the_most_frequent_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert features.most_frequent(df, ["c"]).first()["mode"] == "a"


def test_reference_level_is_the_first_ascending(spark):
    names = [f.name for f in features.feature_list(("n",), {"c": ("z", "a", "m")}, drop_first=True)]
    assert names == ["num__n", "cat__c_m", "cat__c_z"]
    assert len(features.feature_list(("n",), {"c": ("z", "a", "m")}, drop_first=False)) == 4
    telco = {"numerics": TELCO_ROLES.numerics, "levels": TELCO_CONTRACT.domains}
    assert len(features.feature_list(**telco, drop_first=True)) == 30
    assert len(features.feature_list(**telco, drop_first=False)) == 45


def test_score_does_not_depend_on_the_batch(spark, small):
    mart = load_mart(spark, small)
    whole = scoring.score_batch(mart, MART_CONTRACT, SCORECARD_V1, ["customerID"])
    alone = scoring.score_batch(mart.where("customerID = 7"), MART_CONTRACT, SCORECARD_V1, ["customerID"])
    row = scoring.batch_invariance(whole, alone, "customerID").first()
    assert row["records"] == 1 and row["max_difference"] <= 1e-12


def test_csv_read_fills_with_the_file_median(spark):
    path = fresh_path(spark, "telco-csv")
    rows = [{**r, "Churn": "No"} for r in ROWS]
    rows[0]["TotalCharges"] = " "
    frame = text_frame(spark, rows, [*ROWS[0], "Churn"])
    writers.write_csv(frame, path)
    loaded = readers.load_subscribers(spark, path, TELCO_SCHEMA, "TotalCharges")
    assert dict(loaded.dtypes)["tenure"] == "int"
    # Median of the seven values that are present.
    assert loaded.where("customerID = 'C-0001'").first()["TotalCharges"] == 1417.5


def test_request_bodies(spark):
    bodies = [
        '{"records":[{"a":"1","b":"x"},{"a":2}]}',
        '{"csv_content":"a,b\\r\\n3,y\\r\\n4,\\"z,z\\"\\n\\n"}',
        # Columns in another order, one more and one less; a line break, a quote and an empty value.
        '{"csv_content":"b, a,more\\n\\"p\\nq\\",5,m\\n\\"say \\"\\"so\\"\\"\\",6\\n,7,"}',
        '{"csv_content":"b\\nonly"}',
        ' [{"a":"8","b":"list"}, null]',
        "a,b\n9,raw",
        "not json",
        '{"other":1}',
        '{"records":[]}',
        "[]",
        "",
        None,
    ]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = [(r["a"], r["b"]) for r in readers.parse_requests(frame, "body", ["a", "b"]).collect()]
    assert rows == [
        ("1", "x"), ("2", None), ("3", "y"), ("4", "z,z"), ("5", "p\nq"), ("6", 'say "so"'), ("7", None), (None, "only"), ("8", "list"), ("9", "raw"),
    ]
    refused = {r["body"]: r["reason"] for r in readers.refused_requests(frame, "body", ["a", "b"]).collect()}
    assert refused == {
        "not json": "unreadable", '{"other":1}': "unreadable", '{"records":[]}': "no records", "[]": "no records", "": "unreadable", None: "unreadable",
    }


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError):
        readers.require_rows(spark.range(0))


def test_bundle_round_trip_and_tampering(spark, small):
    folder = fresh_path(spark, "bundles")
    for card in (SCORECARD_V1, SCORECARD_V2):
        bundle.save_bundle(spark, card, f"{folder}/{card.version}")
    bundle.set_active(spark, folder, "v2")
    bundle.set_active(spark, folder, "v1")
    card = bundle.load_active(spark, folder)
    assert card.version == "v1"
    rows = catalog.clean(spark, small)
    original, restored = scoring.with_score(rows, SCORECARD_V1), scoring.with_score(rows, card)
    assert scoring.batch_invariance(original, restored, "customerID").first()["max_difference"] <= 1e-12
    spark.createDataFrame([("x",)], "note string").coalesce(1).write.mode("overwrite").json(f"{folder}/v2/weights")
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, f"{folder}/v2")
    # A file the manifest doesn't know is refused as well.
    spark.createDataFrame([("x",)], "note string").coalesce(1).write.mode("append").json(f"{folder}/v1/weights")
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, f"{folder}/v1")


def test_stream_equals_batch_and_resumes(spark, small):
    arrivals = catalog.feed(spark, small)
    source, sinks = fresh_path(spark, "arrivals"), fresh_path(spark, "sinks")
    first, second = arrivals.where("Region < 'B'"), arrivals.where("Region >= 'B'")
    arguments = (arrivals.schema, sinks, MART_ROLES, MART_CONTRACT, MART_RULES, SCORECARD_V1)
    for part in (first, second):
        part.write.mode("append").parquet(source)
        start_scoring(spark, source, *arguments).awaitTermination()
    batch = score_records(arrivals, MART_ROLES, MART_CONTRACT, MART_RULES, SCORECARD_V1)
    streamed = read_scored(spark, sinks, arrivals, *arguments[2:])
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    refused, expected = read_quarantine(spark, sinks, arrivals, *arguments[2:]), quarantined(arrivals, MART_ROLES, MART_CONTRACT)
    refused = refused.select(*expected.columns)
    assert refused.count() > 0 and refused.exceptAll(expected).count() == 0 and expected.exceptAll(refused).count() == 0
    assert refused.count() + streamed.count() == arrivals.count()
    counts = read_counts(spark, sinks).orderBy("batch").collect()
    rows = {(r["batch"], r["verdict"]): r["count"] for r in spark.read.parquet(f"{sinks}/judged").groupBy("batch", "verdict").count().collect()}
    assert len(counts) == 2 and all(c["records"] == c["accepted"] + c["refused"] for c in counts)
    assert all(rows.get((c["batch"], v), 0) == c[v] for c in counts for v in (ACCEPTED, REFUSED))


def test_a_batch_is_judged_in_one_scan(spark, small, capsys):
    source = fresh_path(spark, "arrivals")
    catalog.feed(spark, small).write.parquet(source)
    batch = spark.read.parquet(source)
    judged(batch, MART_ROLES, MART_CONTRACT, MART_RULES, SCORECARD_V1).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_streams_without_refused_or_any_records(spark, small):
    arrivals = catalog.feed(spark, small)
    arguments = (MART_ROLES, MART_CONTRACT, MART_RULES, SCORECARD_V1)
    good = arrivals.join(quarantined(arrivals, MART_ROLES, MART_CONTRACT).select("customerID"), "customerID", "left_anti").select(*arrivals.columns)
    for part in (good, arrivals.limit(0)):
        source, sinks = fresh_path(spark, "arrivals"), fresh_path(spark, "sinks")
        part.write.parquet(source)
        start_scoring(spark, source, arrivals.schema, sinks, *arguments).awaitTermination()
        assert read_scored(spark, sinks, arrivals, *arguments).count() == part.count()
        assert read_quarantine(spark, sinks, arrivals, *arguments).count() == 0


@pytest.mark.parametrize("key", [-1, 1 << 43])
def test_order_keys_that_do_not_fit_are_refused(spark, small, key):
    orders = spark.read.parquet(f"{small}/orders.parquet").limit(5).withColumn("o_orderkey", F.lit(key).cast("bigint"))
    with pytest.raises(Exception, match="order key"):
        order_history(orders.withColumn("o_orderdate", F.lit("1992-01-01").cast("date"))).collect()


def test_declarations_tell_the_versions_apart(spark, small):
    found = catalog.contract_declarations(spark, small)
    rows = {(r["section"], r["item"]): r for r in found.where("feature = 'SeniorCitizen' AND section = 'alias'").collect()}
    assert rows[("alias", "y=1")]["in_v1"] and not rows[("alias", "y=1")]["in_v2"]
    status = {r["section"]: r["status"] for r in compare.declared_sections(found).collect()}
    assert status["required"] == "SAME" and status["alias"] == "DIFFERENT"
