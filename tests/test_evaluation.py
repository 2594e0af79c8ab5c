import itertools

import pytest
from pyspark.sql import functions as F

from staywise.operators import evaluation

HAND = [(0.9, 1), (0.8, 0), (0.7, 1), (0.4, 1), (0.3, 0), (0.1, 0)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y int")


def noisy(spark, rows=600):
    return spark.range(rows).select(
        (F.pmod(F.col("id") * 37, F.lit(101)) / 101).alias("p"), F.when(F.pmod(F.col("id") * 53, F.lit(7)) < 2, 1).otherwise(0).alias("y")
    )


def test_hand_made_confusion(spark):
    row = evaluation.metrics_at(frame(spark, HAND), "p", "y", 0.5).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 1, 2, 1)
    assert row["accuracy"] == pytest.approx(4 / 6, abs=1e-9)
    assert row["precision"] == row["recall"] == row["f1"] == pytest.approx(2 / 3, abs=1e-9)


def test_threshold_is_inclusive_and_undefined_ratios_are_zero(spark):
    row = evaluation.metrics_at(frame(spark, [(0.5, 1), (0.2, 0)]), "p", "y", 0.5).first()
    assert row["tp"] == 1
    row = evaluation.metrics_at(frame(spark, HAND), "p", "y", 0.95).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_recall_falls_along_the_sweep(spark):
    rows = evaluation.threshold_sweep(noisy(spark), "p", "y").orderBy("threshold").collect()
    assert len(rows) == 17
    assert all(a["recall"] >= b["recall"] for a, b in itertools.pairwise(rows))
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 600 for r in rows)


@pytest.mark.parametrize("slices", [1, 12])
def test_ranking_matches_pair_counting(spark, slices):
    df = noisy(spark)
    local = [(r["p"], r["y"]) for r in df.collect()]
    ones, zeros = [p for p, y in local if y], [p for p, y in local if not y]
    won = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    precision_sum = sum(
        sum(1 for q, y in local if q == p and y) * sum(1 for q, y in local if q >= p and y) / sum(1 for q, _ in local if q >= p)
        for p in {p for p, _ in local}
    )
    row = evaluation.ranking_summary(df, "p", "y", slices=slices).first()
    assert row["roc_auc"] == pytest.approx(won / (len(ones) * len(zeros)), abs=1e-8)
    assert row["pr_auc"] == pytest.approx(precision_sum / len(ones), abs=1e-8)


def test_ranking_of_a_single_class_is_undefined(spark):
    row = evaluation.ranking_summary(frame(spark, [(0.2, 0), (0.4, 0)]), "p", "y").first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0


@pytest.mark.parametrize("slices", [1, 4])
def test_roc_points(spark, slices):
    full = evaluation.roc_curve(frame(spark, HAND), "p", "y", slices=slices).collect()
    points = sorted((r["fpr"], r["tpr"]) for r in full)
    third = pytest.approx(1 / 3, abs=1e-8)
    assert points[0] == (0.0, 0.0) and points[1] == (0.0, third) and points[-1] == (1.0, 1.0)
    assert len(points) == 7
    kept = evaluation.roc_curve(frame(spark, HAND), "p", "y", True, slices).collect()
    # 0.7 continues into 0.4 and 0.3 into 0.1; the points before the turns go.
    assert sorted(r["threshold"] for r in kept if r["threshold"] is not None) == [0.1, 0.4, 0.8, 0.9]


def test_precision_recall_end_point(spark):
    rows = evaluation.precision_recall_curve(frame(spark, HAND), "p", "y").collect()
    assert [(r["precision"], r["recall"]) for r in rows if r["threshold"] is None] == [(1.0, 0.0)]
    assert len(rows) == 7


def test_calibration_edges_and_empty_bins(spark):
    rows = evaluation.calibration_table(frame(spark, [(0.3, 1), (0.30000000000000004, 0), (1.0, 1), (0.0, 0)]), "p", "y").orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1]
    assert rows[1]["mean_predicted_probability"] is None and rows[1]["calibration_gap"] is None
    assert rows[2]["calibration_gap"] == pytest.approx(-0.7)
    total = evaluation.calibration_table(noisy(spark), "p", "y").agg(F.sum("count")).first()[0]
    assert total == 600


def test_candidates_prefer_the_lower_threshold(spark):
    sweep = spark.createDataFrame(
        [(0.2, 0.5, 0.61, 0.8, 0.69), (0.3, 0.5, 0.66, 0.8, 0.69), (0.4, 0.5, 0.60, 0.7, 0.64)],
        "threshold double, accuracy double, precision double, recall double, f1 double",
    )
    assert evaluation.f1_candidate(sweep).first()["threshold"] == 0.2
    rows = {r["min_precision"]: r for r in evaluation.recall_candidates(sweep).collect()}
    assert rows[0.60]["threshold"] == 0.2 and rows[0.65]["threshold"] == 0.3
    assert not rows[0.70]["found"] and rows[0.70]["max_precision"] == 0.66


def test_published_sweep_candidates(spark):
    """Four points of a published sweep: best F1 and the best recall at each precision floor."""
    points = [(0.25, 0.51520, 0.81551, 0.63147), (0.40, 0.6, 0.63369, 0.61639), (0.50, 0.67273, 0.49465, 0.57011), (0.55, 0.7, 0.43048, 0.53311)]
    sweep = spark.createDataFrame(
        [(t, 0.0, p, r, f) for t, p, r, f in points], "threshold double, accuracy double, precision double, recall double, f1 double"
    )
    assert evaluation.f1_candidate(sweep).first()["threshold"] == 0.25
    assert [r["threshold"] for r in evaluation.recall_candidates(sweep).orderBy("min_precision").collect()] == [0.40, 0.50, 0.55]


def test_confusion_grid_is_complete(spark):
    df = spark.createDataFrame([("No", "No")], "a string, b string")
    assert sorted(tuple(r) for r in evaluation.confusion_matrix(df, "a", "b").collect()) == [
        ("No", "No", 1), ("No", "Yes", 0), ("Yes", "No", 0), ("Yes", "Yes", 0)
    ]


def test_champion_ties_go_to_the_name(spark):
    table = spark.createDataFrame([("b", 0.8), ("a", 0.8), ("c", 0.1)], "model string, mean_roc_auc double")
    assert evaluation.champion(table, "mean_roc_auc").first()["model"] == "a"
