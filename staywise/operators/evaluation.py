"""Evaluation of scores against a 0/1 target, exact at any number of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.expressions import ratio
from staywise.functions.sql import array, number, quoted, struct
from staywise.operators.ordering import numbered, running_totals
from staywise.session import stage

# Evaluated thresholds, precision floors, calibration bins.
THRESHOLDS = (
    0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
    0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90,
)
PRECISION_FLOORS = (0.60, 0.65, 0.70)
CALIBRATION_BINS = 10

DIGITS = 9


def _rates(df: DataFrame) -> DataFrame:
    """Confusion counts to rates; undefined ratios are 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    keys = [c for c in df.columns if c not in ("tp", "fp", "tn", "fn")]
    return df.select(
        *keys,
        F.round(ratio(tp + tn, tp + fp + tn + fn), DIGITS).alias("accuracy"),
        F.round(ratio(tp, tp + fp), DIGITS).alias("precision"),
        F.round(ratio(tp, tp + fn), DIGITS).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), DIGITS).alias("f1"),
        "tp",
        "fp",
        "tn",
        "fn",
        (tp + fp).alias("n_predicted_positive"),
        (tn + fn).alias("n_predicted_negative"),
    )


def threshold_sweep(
    scored: DataFrame,
    score: str,
    label: str,
    thresholds: Sequence[float] = THRESHOLDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts at every threshold from one pass: a fixed set of conditional sums."""
    s, positive = quoted(score), f"{quoted(label)} = 1"

    def cell(t: float) -> str:
        called, passed = f"{s} >= {number(t)}", f"{s} < {number(t)}"
        return struct(
            {
                "threshold": number(t),
                "tp": f"count_if({called} AND {positive})",
                "fp": f"count_if({called} AND NOT {positive})",
                "tn": f"count_if({passed} AND NOT {positive})",
                "fn": f"count_if({passed} AND {positive})",
            }
        )

    cells = F.expr(array(cell(t) for t in thresholds))
    grouped = scored.groupBy(*by).agg(cells.alias("cells"))
    return _rates(grouped.select(*by, F.inline("cells")))


def metrics_at(scored: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return threshold_sweep(scored, score, label, [threshold], by)


def score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Staged (by…, score, pos, neg): one row per distinct score, all that ranking needs."""
    counted = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )
    return stage(counted, "scores")


def score_steps(counted: DataFrame, by: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """Staged counts with the running tp / fp from the highest score down."""
    steps = running_totals(
        counted, "score", ["pos", "neg"], by, descending=True, slices=slices, staged=True
    )
    return steps.withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})


def class_totals(counted: DataFrame) -> tuple[int, int]:
    row = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return row["p"] or 0, row["n"] or 0


def roc_curve(
    scored: DataFrame,
    score: str,
    label: str,
    drop_collinear: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr) with the (0, 0) start point, whose threshold is NULL.

    ``drop_collinear`` removes inner points that continue a straight line: a step
    equal to the following step; the first and last score always stay.  Neighbours
    meet through a join on the rank, so the curve is never sorted in one task.
    """
    counted = score_counts(scored, score, label)
    positives, negatives = class_totals(counted)
    steps = score_steps(counted, slices=slices)
    if drop_collinear:
        ranked = stage(
            numbered(steps.withColumn("_k", -F.col("score")), "_k", "rank", slices).drop("_k"), "ranked"
        )
        following = ranked.select(
            (F.col("rank") - 1).alias("rank"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
        )
        bends = (
            (F.col("rank") == 1)
            | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos"))
            | (F.col("next_neg") != F.col("neg"))
        )
        steps = ranked.join(following, "rank", "left").where(bends)
    points = steps.select(
        F.round("score", DIGITS).alias("threshold"),
        F.round(ratio(F.col("fp"), F.lit(negatives)), DIGITS).alias("fpr"),
        F.round(ratio(F.col("tp"), F.lit(positives)), DIGITS).alias("tpr"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def precision_recall_curve(
    scored: DataFrame, score: str, label: str, slices: int | None = None
) -> DataFrame:
    """(threshold, precision, recall) with the (recall 0, precision 1) end point."""
    counted = score_counts(scored, score, label)
    positives, _ = class_totals(counted)
    points = score_steps(counted, slices=slices).select(
        F.round("score", DIGITS).alias("threshold"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), DIGITS).alias("precision"),
        F.round(ratio(F.col("tp"), F.lit(positives)), DIGITS).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def ranking_summary(
    scored: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Tie-aware ROC-AUC and average precision (step-wise, not trapezoidal) per group.

    Every distinct score contributes on its own: its negatives beat no positive
    ranked above them, tie with half of their own positives, and its positives
    add precision weighted by their share.
    """
    steps = score_steps(score_counts(scored, score, label, by), by, slices)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(neg * (tp - pos / 2)).alias("_won"),
        F.sum(pos * F.try_divide(tp, tp + fp)).alias("_gain"),
    )
    return sums.select(
        *by,
        "positives",
        "negatives",
        F.round(
            F.try_divide(F.col("_won"), F.col("positives").cast("double") * F.col("negatives").cast("double")), DIGITS
        ).alias("roc_auc"),
        F.round(ratio(F.col("_gain"), F.col("positives")), DIGITS).alias("pr_auc"),
    )


def brier_score(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    miss = F.col(score) - F.col(label)
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(miss * miss), DIGITS).alias("brier_score"))


def f1_candidate(sweep: DataFrame) -> DataFrame:
    """Threshold of the highest F1; the lower threshold wins a tie."""
    best = F.max_by(
        F.struct("threshold", "f1", "precision", "recall", "accuracy"), F.struct(F.col("f1"), -F.col("threshold"))
    )
    return sweep.agg(best.alias("best")).select("best.*")


def recall_candidates(sweep: DataFrame, floors: Sequence[float] = PRECISION_FLOORS) -> DataFrame:
    """Best recall at each precision floor, or the highest precision seen when none reaches it.

    Ties on recall go to the higher F1, then to the lower threshold.  One pass
    over the sweep with a fixed number of aggregates.
    """
    point = F.struct("threshold", "precision", "recall", "f1")
    cells = []
    for floor in floors:
        feasible = F.col("precision") >= float(floor)
        rank = F.struct(F.col("recall"), F.col("f1"), -F.col("threshold"))
        cells.append(
            F.struct(
                F.lit(float(floor)).alias("min_precision"),
                F.max_by(F.when(feasible, point), F.when(feasible, rank)).alias("best"),
                F.max_by(point, F.struct(F.col("precision"), -F.col("threshold"))).alias("nearest"),
            )
        )
    rows = sweep.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    found = F.col("best").isNotNull()
    return rows.select(
        "min_precision",
        found.alias("found"),
        "best.threshold",
        "best.precision",
        "best.recall",
        "best.f1",
        F.when(~found, F.col("nearest.precision")).alias("max_precision"),
        F.when(~found, F.col("nearest.threshold")).alias("max_precision_threshold"),
    )


def bin_edges(bins: int = CALIBRATION_BINS) -> list[float]:
    """Evenly spaced edges with the floating-point steps of the usual linspace."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def calibration_table(scored: DataFrame, score: str, label: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Reliability per equal-width bin; empty bins are kept with NULL rates.

    The bin is found by comparing with the edge literals; the gap is mean
    prediction minus observed rate, so a positive gap over-states risk.
    """
    edges = bin_edges(bins)
    s, y = quoted(score), quoted(label)
    cells = []
    for i in range(bins):
        sides = [f"{s} >= {number(edges[i])}"] if i > 0 else []
        sides += [f"{s} < {number(edges[i + 1])}"] if i < bins - 1 else []
        inside = " AND ".join(sides) or "true"
        cells.append(
            struct(
                {
                    "bin": str(i),
                    "lower": number(round(edges[i], 12)),
                    "upper": number(round(edges[i + 1], 12)),
                    "count": f"count_if({inside})",
                    "_mean": f"avg(CASE WHEN {inside} THEN {s} END)",
                    "_rate": f"avg(CASE WHEN {inside} THEN {y} END)",
                }
            )
        )
    return (
        scored.agg(F.expr(array(cells)).alias("cells"))
        .select(F.inline("cells"))
        .select(
            "bin",
            "lower",
            "upper",
            "count",
            F.round("_mean", DIGITS).alias("mean_predicted_probability"),
            F.round("_rate", DIGITS).alias("observed_churn_rate"),
            F.round(F.col("_mean") - F.col("_rate"), DIGITS).alias("calibration_gap"),
        )
    )


def calibration_summary(scored: DataFrame, score: str, label: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Overall means, Brier score and the unweighted mean |gap| over populated bins."""
    edges = bin_edges(bins)
    where = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    miss = F.col(score) - F.col(label)
    per_bin = scored.groupBy(where.alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(score).alias("s"),
        F.sum(F.col(label).cast("double")).alias("y"),
        F.sum(miss * miss).alias("m"),
    )
    return per_bin.agg(
        F.sum("n").alias("n"),
        F.round(F.sum("m") / F.sum("n"), DIGITS).alias("brier_score"),
        F.round(F.sum("s") / F.sum("n"), DIGITS).alias("overall_mean_predicted_probability"),
        F.round(F.sum("y") / F.sum("n"), DIGITS).alias("overall_observed_churn_rate"),
        F.round(F.avg(F.abs((F.col("s") - F.col("y")) / F.col("n"))), DIGITS).alias("mean_absolute_calibration_gap"),
    )


def split_summary(labelled: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return labelled.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(label) == 1).alias("n_actual_positive"),
        F.count_if(F.col(label) == 0).alias("n_actual_negative"),
        F.round(F.avg(F.col(label).cast("double")), DIGITS).alias("observed_positive_rate"),
    )


def confusion_matrix(labelled: DataFrame, actual: str, predicted: str, labels: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Complete actual × predicted grid, empty cells included."""
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("predicted"),
                F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias("n"),
            )
            for a in labels
            for p in labels
        ]
    )
    return labelled.agg(cells.alias("cells")).select(F.inline("cells"))


def classification_report(labelled: DataFrame, actual: str, predicted: str, labels: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro and weighted averages."""
    classes = F.array(
        *[
            F.struct(
                F.lit(c).alias("row"),
                F.count_if((F.col(actual) == c) & (F.col(predicted) == c)).alias("hit"),
                F.count_if(F.col(predicted) == c).alias("called"),
                F.count_if(F.col(actual) == c).alias("support"),
            )
            for c in labels
        ]
    )
    hit, called, support = F.col("hit"), F.col("called"), F.col("support")
    per_class = (
        labelled.agg(classes.alias("classes"))
        .select(F.inline("classes"))
        .select(
            "row",
            "hit",
            ratio(hit, called).alias("precision"),
            ratio(hit, support).alias("recall"),
            ratio(2 * hit, called + support).alias("f1"),
            "support",
        )
    )
    measures = ("precision", "recall", "f1")
    share = F.sum("support")
    overall = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("row"),
                *[ratio(F.sum("hit"), share).alias(m) for m in measures],
                share.alias("support"),
            ),
            F.struct(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in measures], share.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("row"),
                *[ratio(F.sum(F.col(m) * F.col("support")), share).alias(m) for m in measures],
                share.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("hit").unionByName(overall).select(
        "row", *[F.round(m, DIGITS).alias(m) for m in measures], "support"
    )


def model_metrics(scored: DataFrame, score: str, label: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """ROC-AUC, average precision, accuracy, precision, recall and F1 per model."""
    ranking = ranking_summary(scored, score, label, by)
    at = metrics_at(scored, score, label, threshold, by)
    return ranking.join(at, list(by)).select(
        *by, "roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1"
    )


def leaderboard(metrics: DataFrame, name: str = "model", digits: int = 4) -> DataFrame:
    """Metrics to four digits, best ROC-AUC first, with a flag on each metric's best model."""
    measures = ["roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1"]
    rounded = stage(metrics.select(name, *[F.round(m, digits).alias(m) for m in measures]), "metrics")
    best = rounded.agg(*[F.max(m).alias(m) for m in measures]).first()
    flags = {f"best_{m}": F.col(m) == F.lit(best[m]) for m in measures}
    return rounded.withColumns(flags).orderBy(F.col("roc_auc").desc(), name)


def champion(table: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """The model with the highest metric; the name decides a tie."""
    return table.orderBy(F.col(metric).desc(), name).limit(1)


def full_report(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Split, sweep, ranking, candidate and calibration results as (section, item, metric, value)."""

    def long(table: DataFrame, section: str, item: str | None) -> DataFrame:
        metrics = [c for c in table.columns if c != item]
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        place = F.lit(None).cast("double") if item is None else F.col(item).cast("double")
        return table.select(F.lit(section).alias("section"), place.alias("item"), F.inline(cells))

    sweep = stage(threshold_sweep(scored, score, label), "sweep")
    parts = [
        long(split_summary(scored, label), "split", None),
        long(sweep, "sweep", "threshold"),
        long(ranking_summary(scored, score, label), "ranking", None),
        long(f1_candidate(sweep), "f1_maximizing", None),
        long(recall_candidates(sweep), "recall_at_precision", "min_precision"),
        long(calibration_table(scored, score, label), "calibration", "bin"),
        long(calibration_summary(scored, score, label), "calibration_summary", None),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
