import math

import pytest
from pyspark.sql import functions as F

from staywise.functions.expressions import logistic, shuffled
from staywise.operators.features import stratified_split
from staywise.operators.profile import ordered_sample
from staywise.operators import contract, scoring
from staywise.telco import TELCO_CONTRACT, TELCO_ROLES, TELCO_RULES
from tests.fixtures import BASE, ROWS, text_frame


def test_tier_policies_differ_on_their_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 29.99, 30.0, 30.01, 60.0, 60.01, 80.0, 100.0)], "churn_pct double")
    rows = {r["churn_pct"]: r for r in scoring.with_tiers(df).collect()}
    assert [rows[v]["risk_tier"] for v in (0.0, 30.0, 30.01, 60.0, 60.01, 100.0)] == [
        "Low Risk", "Low Risk", "Moderate Risk", "Moderate Risk", "High Risk", "High Risk"
    ]
    assert [rows[v]["risk_level"] for v in (29.99, 30.0, 60.0, 80.0)] == ["Low Risk", "Medium Risk", "High Risk", "Critical Risk"]
    assert [rows[v]["risk_status"] for v in (29.99, 30.0, 60.0)] == ["LOW RISK", "MODERATE RISK", "HIGH RISK"]


def test_logistic_is_stable(spark):
    df = spark.createDataFrame([(z,) for z in (-1e6, -800.0, -2.0, 0.0, 2.0, 800.0, 1e6)], "z double")
    rows = [r[0] for r in df.select(logistic(F.col("z"))).collect()]
    assert rows[0] == 0.0 and rows[-1] == 1.0 and rows[3] == 0.5
    assert rows[2] == pytest.approx(1 / (1 + math.exp(2)))


def test_interventions_follow_the_rules(spark):
    clean = contract.accepted(text_frame(spark, ROWS), TELCO_CONTRACT, ["customerID"])
    rows = {
        r["customerID"]: [a["action"] for a in r["i"]]
        for r in clean.select("customerID", scoring.interventions(TELCO_ROLES, TELCO_RULES).alias("i")).collect()
    }
    assert rows["C-0008"] == [scoring.ACTIONS[i][0] for i in range(4)]
    assert rows["C-0002"] == ["Loyalty Appreciation"]
    assert rows["C-0007"] == ["Contract Upgrade Incentive", "Autopay / Credit Card Migration"]
    best = {
        r["customerID"]: r["n"]
        for r in clean.select("customerID", scoring.next_best_actions(TELCO_ROLES, TELCO_RULES).alias("n")).collect()
    }
    assert best["C-0002"] == []
    assert best["C-0001"] == [scoring.LOCK_IN, scoring.CYBER_CARE, scoring.AUTO_PAY, scoring.CONCIERGE]


@pytest.mark.parametrize("labels,index", [(["No", "Yes"], 1), (["Yes", "No"], 0), ([0, 1], 1), (["true", "false"], 0)])
def test_positive_class_index(labels, index):
    assert scoring.positive_index(labels) == index


@pytest.mark.parametrize("labels", [["No"], ["Yes", "yes"], ["a", "b"], ["No", "Yes", "maybe"]])
def test_ambiguous_classes_are_refused(labels):
    with pytest.raises(ValueError):
        scoring.positive_index(labels)


def test_synthesized_ids_keep_order(spark):
    df = spark.range(3).select((F.col("id") * 10).alias("k"))
    assert [r["synthetic_id"] for r in scoring.synthesized_ids(df, "k").orderBy("k").collect()] == ["CUST-0001", "CUST-0002", "CUST-0003"]


def test_shuffled_order_takes_text_and_negative_ids(spark):
    df = spark.createDataFrame([("a", -5), ("b", 7)], "s string, n bigint")
    for name in ("s", "n"):
        assert len({r[0] for r in df.select(shuffled(name, 42)).collect()}) == 2


def test_samples_of_two_seeds_hardly_meet(spark):
    ids = spark.range(15_000)
    one, two = ({r["id"] for r in ordered_sample(ids, "id", 200, seed).collect()} for seed in (42, 43))
    assert len(one) == len(two) == 200 and len(one & two) < 20


def test_a_sample_spans_five_million_ids(spark):
    found = [r["id"] for r in ordered_sample(spark.range(5_000_000), "id", 200, 42).collect()]
    assert len({i * 10 // 5_000_000 for i in found}) == 10 and len({i % 10_007 for i in found}) > 150


def test_sample_is_independent_of_the_split(spark):
    df = spark.range(5_000).withColumn("stratum", F.col("id") % 2)
    held = {r["id"] for r in stratified_split(df, "id", "stratum", 0.2, 42).where("is_test").collect()}
    assert len(held) == 1000
    picked = {r["id"] for r in ordered_sample(df, "id", 200, 42).collect()}
    assert 10 < len(picked & held) < 80


def test_too_many_strata_are_refused(spark):
    with pytest.raises(ValueError, match="needs few"):
        stratified_split(spark.range(2_000).withColumn("stratum", F.col("id")), "id", "stratum")


def test_empty_batch_gives_zeroes(spark):
    clean = contract.accepted(text_frame(spark, [BASE]).where("false"), TELCO_CONTRACT, ["customerID"])
    scored = clean.withColumns({"churn_probability": F.lit(0.5), "churn_pct": F.lit(50.0), "prediction": F.lit("Yes")})
    row = scoring.batch_summary(scoring.with_tiers(scored)).first()
    assert row["total"] == 0 and row["predicted_churn_pct"] == 0.0 and row["mean_churn_pct"] == 0.0
