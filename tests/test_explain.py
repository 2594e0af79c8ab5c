import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staywise.operators import explain, trees
from staywise.plans import catalog
from staywise.plans.scorecards import SCORECARD_V1, SCORECARD_V2


def subset_value(tree, node, known, x):
    n = tree.nodes[node]
    if n.is_leaf:
        return n.value
    if n.feature in known:
        return subset_value(tree, n.left if x[n.feature] <= n.threshold else n.right, known, x)
    left, right = tree.nodes[n.left], tree.nodes[n.right]
    return (
        left.cover * subset_value(tree, n.left, known, x) + right.cover * subset_value(tree, n.right, known, x)
    ) / n.cover


def brute_force(ensemble, x, width):
    phi = np.zeros(width)
    for j in range(width):
        others = [k for k in range(width) if k != j]
        for size in range(width):
            for subset in itertools.combinations(others, size):
                weight = factorial(size) * factorial(width - size - 1) / factorial(width)
                for tree in ensemble:
                    gain = subset_value(tree, 0, {*subset, j}, x) - subset_value(tree, 0, set(subset), x)
                    phi[j] += weight * tree.weight * gain
    return phi


@pytest.fixture(scope="module")
def numbers(spark):
    hashed = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"x{i}") for i in range(4)]
    raw = spark.range(400).select("id", *hashed)
    label = F.when(F.col("x0") + 0.5 * F.col("x1") * (F.col("x2") > 500).cast("int") > 700, 1.0).otherwise(0.0)
    labelled = raw.withColumn("label", label)
    return VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(labelled)


@pytest.mark.parametrize(
    "estimator",
    [
        lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=1),
        lambda: DecisionTreeClassifier(maxDepth=4, seed=1),
        lambda: RandomForestClassifier(numTrees=3, maxDepth=5, seed=1),
    ],
    ids=["boosted", "tree", "forest"],
)
def test_tree_attributions_match_brute_force(spark, numbers, estimator):
    model = estimator().fit(numbers)
    assert trees.explainer_kind(model) == "tree"
    ensemble = trees.read_trees(model)
    base = trees.base_value(ensemble)
    found = trees.tree_attributions(numbers, ensemble, "id", "features", 4).join(
        model.transform(numbers).select("id", "features", vector_to_array("probability")[1].alias("p")), "id"
    )
    for row in found.orderBy("id").limit(12).collect():
        expected = brute_force(ensemble, row["features"].toArray(), 4)
        assert np.allclose(row["attributions"], expected, atol=1e-9)
        total = base + sum(row["attributions"])
        reached = 1 / (1 + np.exp(-total)) if isinstance(model, GBTClassificationModel) else total
        assert reached == pytest.approx(row["p"], abs=1e-9)


def test_ranks_and_directions_of_tree_attributions(spark, numbers):
    ensemble = trees.read_trees(GBTClassifier(maxIter=4, maxDepth=3, seed=2).fit(numbers))
    lookup = trees.tree_attributions(numbers, ensemble, "id", "features", 4)
    names = ["a", "b", "c", "d"]
    ranked = trees.ranked_attributions(lookup, names, "id").toPandas()
    assert len(ranked) == 1600 and set(ranked["rank"]) == {1, 2, 3, 4}
    first = ranked[ranked["id"] == 3].sort_values("rank")["contribution"].abs()
    assert first.is_monotonic_decreasing
    local = lookup.toPandas()
    x, phi = np.stack(local["x"]), np.stack(local["attributions"])
    for row in trees.direction_from_attributions(lookup, names).collect():
        i = names.index(row["feature"])
        active = x[:, i] > np.median(x[:, i])
        assert row["active_effect"] == pytest.approx(phi[active, i].mean(), abs=1e-9)


def test_margin_of_a_small_ensemble_and_its_limit(spark, numbers, monkeypatch):
    ensemble = trees.read_trees(GBTClassifier(maxIter=3, maxDepth=2, seed=2).fit(numbers))
    rows = trees.tree_attributions(numbers, ensemble, "id", "features", 4)
    margin = trees.ensemble_margin(ensemble, lambda i: F.col("x")[i])
    total = F.aggregate("attributions", F.lit(trees.base_value(ensemble)), lambda a, b: a + b)
    assert rows.select(F.max(F.abs(margin - total))).first()[0] < 1e-9
    monkeypatch.setattr(trees, "MOST_SHARES", 0)
    monkeypatch.setattr(trees, "MOST_LEAVES", 5)
    with pytest.raises(ValueError, match="leaves"):
        trees.tree_attributions(numbers, ensemble, "id", "features", 4)


@pytest.mark.parametrize("most_splits", [0, 3, 8])
def test_share_table_and_batches_agree(spark, numbers, monkeypatch, most_splits):
    """Whole trees and single leaves as pieces; rows that share a key stay apart."""
    monkeypatch.setattr(trees, "PIECE_SPLITS", most_splits)
    model = RandomForestClassifier(numTrees=4, maxDepth=5, seed=4).fit(numbers)
    ensemble = trees.read_trees(model)
    rows = numbers.select((F.col("id") % 7).alias("id"), vector_to_array("features").alias("x"))
    table = trees.pieces(ensemble, 4)
    assert trees.share_table(spark, table).count() == sum(len(p.shares) for p in table)

    def shares(df):
        local = df.toPandas()
        return sorted([(k, *x, *np.round(a, 9) + 0.0) for k, x, a in zip(local["id"], local["x"], local["attributions"])])

    joined, batches = shares(trees.joined_attributions(rows, table, "id", 4)), shares(trees.batch_attributions(rows, ensemble, "id", 4))
    assert len(joined) == 400 and np.allclose(joined, batches, atol=1e-8)


def test_size_of_the_share_table_is_bounded(spark, numbers, monkeypatch, capsys):
    ensemble = trees.read_trees(GBTClassifier(maxIter=4, maxDepth=3, seed=2).fit(numbers))
    size = sum(p.shares.size for p in trees.pieces(ensemble, 4))
    trees.tree_attributions(numbers, ensemble, "id", "features", 4).explain()
    plan = capsys.readouterr().out
    assert "InPandas" not in plan and "InArrow" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(trees, "MOST_SHARES", size - 1)
    assert trees.pieces(ensemble, 4) is None


def test_trees_without_splits(spark):
    rows = spark.createDataFrame([("a", [1.0])], "k string, x array<double>")
    stump = trees.Tree(1.0, {0: trees.Node(0.3, 10.0)})
    assert trees.array_attributions(rows, [stump], "k", 1).first()["attributions"] == [0.0]


def test_other_models_are_refused(numbers):
    assert trees.explainer_kind(LogisticRegression().fit(numbers)) == "linear"
    with pytest.raises(TypeError):
        trees.explainer_kind(object())


@pytest.mark.parametrize("card", [SCORECARD_V1, SCORECARD_V2], ids=["v1", "v2"])
def test_linear_attributions_add_up(spark, small, card):
    rows = catalog.clean(spark, small)
    reference = catalog.background(spark, small, card)
    found = explain.additivity(rows, card, reference, "customerID").first()
    assert found["records"] == rows.count() and found["max_error"] <= 1e-8


def test_signs_and_order(spark, small):
    rows = catalog.clean(spark, small)
    reference = catalog.background(spark, small)
    long = explain.explain_rows(rows, SCORECARD_V1, reference, "customerID").toPandas()
    for _, one in long.sort_values("rank").groupby("customerID"):
        assert one["abs_contribution"].is_monotonic_decreasing and len(one) == 25
    assert ((long["contribution"] > 0) == (long["direction"] == explain.INCREASES)).all()
    # Averaged over the background itself, every attribution vanishes.
    sample = catalog._sample(spark, small)
    mean = explain.explain_rows(sample, SCORECARD_V1, reference, "customerID").groupBy("feature").agg(F.avg("contribution").alias("m"))
    assert mean.agg(F.max(F.abs("m"))).first()[0] < 1e-8


def test_tree_attribution_change_accounts_for_the_score(spark, numbers):
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=3).fit(numbers)
    ensemble = trees.read_trees(model)
    moved = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(
        numbers.drop("features").withColumn("x0", F.lit(0.0))
    )
    before = trees.tree_attributions(numbers, ensemble, "id", "features", 4)
    after = trees.tree_attributions(moved, ensemble, "id", "features", 4)
    changes = trees.attribution_change(before, after, ["a", "b", "c", "d"], "id", 4)
    total = changes.groupBy("id").agg(F.sum("delta").alias("delta"))
    margin = lambda rows, name: model.transform(rows).select("id", vector_to_array("rawPrediction")[1].alias(name))
    joined = total.join(margin(numbers, "m0"), "id").join(margin(moved, "m1"), "id")
    # The raw prediction is the margin F; attributions live in log-odds, 2F.
    assert joined.count() == 400
    assert joined.agg(F.max(F.abs(F.col("delta") - 2 * (F.col("m1") - F.col("m0"))))).first()[0] < 1e-9
