from dataclasses import replace

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer

from staywise.operators import features, profile, scoring, training
from staywise.plans.mart import MART_CONTRACT, MART_DOMAINS, MART_ROLES, load_mart
from staywise.session import fresh_path
from staywise.sources import bundle


@pytest.fixture(scope="module")
def data(spark, small):
    return training.prepare(load_mart(spark, small), MART_ROLES, MART_DOMAINS)


def test_preparation_uses_training_rows_only(data):
    assert data.train.join(data.test, "customerID").count() == 0
    assert data.train.count() + data.test.count() == 150
    assert {r["fold"] for r in data.train.select("fold").distinct().collect()} == set(range(5))
    assert len(data.features) == 35


def test_scaled_training_columns_have_unit_population_variance(spark, data):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    x = data.train.select(vector_to_array("features").alias("x"))
    row = x.agg(F.avg(F.col("x")[1]).alias("m"), F.stddev_pop(F.col("x")[1]).alias("s")).first()
    assert row["m"] == pytest.approx(0.0, abs=1e-9) and row["s"] == pytest.approx(1.0, abs=1e-9)


def test_search_scores_every_setting_and_keeps_the_best(data):
    table, best = training.search(data, "DecisionTreeClassifier")
    rows = table.collect()
    assert len(rows) == 3 and all(0 <= r["mean_roc_auc"] <= 1 for r in rows)
    assert best.mean_auc == max(r["mean_roc_auc"] for r in rows)


def test_each_fold_learns_its_own_statistics(data):
    learned = [training.fold_preparation(data, fold) for fold in range(training.FOLDS)]
    assert len({p.means["MonthlyCharges"] for p in learned}) == training.FOLDS
    train, held = training.fold_rows(data, 2)
    assert {r["fold"] for r in held.select("fold").distinct().collect()} == {2}
    assert train.where("fold = 2").count() == 0 and train.count() + held.count() == data.train_rows


def test_penalty_is_the_inverse_strength_per_row():
    assert training.penalty(10.0, 50) == pytest.approx(1 / 500)


def test_legacy_space_has_four_models():
    assert tuple(training.legacy_estimators(100)) == training.MODEL_NAMES
    with pytest.raises(ValueError):
        training.search_space("AdaBoost", 10)


def test_importance_needs_matching_names(spark, data):
    model = LogisticRegression(maxIter=5).fit(data.train)
    importance = training.feature_importance(model, data.features, spark)
    top = training.top_features(importance, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[2]["importance"] >= 0
    with pytest.raises(ValueError):
        training.feature_importance(model, data.features[:-1], spark)


def test_frozen_and_reloaded_models_score_alike(spark, small, data):
    mart = load_mart(spark, small)
    model = training.logistic_model(1.0, data.train_rows, 50).fit(data.train)
    fitted = training.score_with_model(mart, MART_CONTRACT, data, model, "customerID")
    frozen = scoring.score_batch(mart, MART_CONTRACT, training.frozen_scorecard(model, data, "v3"), ["customerID"])
    assert scoring.batch_invariance(fitted, frozen, "customerID").first()["max_difference"] < 1e-9
    tree = training.search_space("DecisionTreeClassifier", 10)[0].fit(data.train)
    path = fresh_path(spark, "trained")
    bundle.save_trained(spark, tree, data.fitted, path)
    loaded, preparation = bundle.load_trained(spark, path)
    assert preparation == data.fitted
    again = training.score_with_model(mart, MART_CONTRACT, replace(data, fitted=preparation), loaded, "customerID")
    first = training.score_with_model(mart, MART_CONTRACT, data, tree, "customerID")
    row = scoring.batch_invariance(first, again, "customerID").first()
    assert row["records"] == first.count() and row["max_difference"] == 0.0


def test_active_pointer_loads_a_fitted_ensemble(spark, small, data):
    path = fresh_path(spark, "versions")
    first = training.search_space("DecisionTreeClassifier", 10)[0].fit(data.train)
    second = training.search_space("GradientBoostingClassifier", 10)[0].copy().setMaxIter(3).fit(data.train)
    for version, model in (("tree", first), ("boosted", second)):
        bundle.save_trained(spark, model, data.fitted, f"{path}/{version}")
    with pytest.raises(Exception):
        bundle.load_active_trained(spark, path)
    bundle.set_active(spark, path, "tree")
    bundle.set_active(spark, path, "boosted")
    version, model, fitted = bundle.load_active_trained(spark, path)
    assert version == "boosted" and fitted == data.fitted and model.getNumTrees == 3
    mart = load_mart(spark, small)
    found = training.score_with_trained(mart, MART_CONTRACT, fitted, model, "customerID")
    expected = training.score_with_model(mart, MART_CONTRACT, data, second, "customerID")
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count() > 0


def test_training_is_repeatable(spark, small, data):
    mart = load_mart(spark, small)
    again = training.prepare(mart.repartition(5, "Segment"), MART_ROLES, MART_DOMAINS)
    forest = training.search_space("RandomForestClassifier", 10)[0].copy().setNumTrees(5)
    first, second = forest.fit(data.train), forest.fit(again.train)
    left = training.scored_with(first, data.test, "a", "customerID").select("customerID", "score")
    right = training.scored_with(second, again.test, "b", "customerID").select("customerID", "score")
    assert left.exceptAll(right).count() == 0


def test_kept_scores_give_the_search_its_figures(spark, data):
    """Every training row is scored once per setting; pairs counted one by one give each fold's area under the curve."""
    _, best = training.search(data, "DecisionTreeClassifier", keep=fresh_path(spark, "kept"))
    rows = spark.read.parquet(best.kept).collect()
    for setting in range(3):
        assert len({r["customerID"] for r in rows if r["setting"] == setting}) == data.train_rows
    assert len(rows) == 3 * data.train_rows
    for fold, figures in enumerate(best.fold_auc):
        for setting, told in enumerate(figures):
            of = [r for r in rows if (r["fold"], r["setting"]) == (fold, setting)]
            up, down = ([r["score"] for r in of if r["label"] == k] for k in (1, 0))
            won = sum((p > n) + (p == n) / 2 for p in up for n in down)
            assert told == pytest.approx(won / (len(up) * len(down)), abs=1e-9)
    assert all(r["agrees"] for r in training.out_of_fold(best, spark).collect())


def test_levels_are_learned_from_the_training_part(spark, small):
    rows = load_mart(spark, small)
    learned = training.prepare(rows, MART_ROLES, None)
    kept = {f.raw: set() for f in learned.features if f.level is not None}
    for f in learned.features:
        if f.level is not None:
            kept[f.raw].add(f.level)
    for name, levels in kept.items():
        assert levels == {r[0] for r in learned.raw.where(f"{name} IS NOT NULL").select(name).distinct().collect()}


def test_learned_levels_of_odd_columns(spark):
    rows = spark.createDataFrame([("b", None), ("a", None), ("b", None), (None, None)], "x string, y string")
    assert features.learned_levels(rows, ["x", "y"]) == {"x": ("a", "b"), "y": ()}
    assert features.learned_levels(rows.limit(0), ["x"]) == {"x": ()}
    with pytest.raises(ValueError):
        features.learned_levels(rows, ["x"], most=1)


def test_class_labels_come_from_metadata(spark):
    rows = spark.createDataFrame([("Yes",), ("No",), ("Yes",)], "label string")
    indexed = StringIndexer(inputCol="label", outputCol="index").fit(rows).transform(rows)
    assert scoring.class_labels(indexed, "index") == ["Yes", "No"]
    assert scoring.positive_index(scoring.class_labels(indexed, "index")) == 0
    with pytest.raises(ValueError):
        scoring.class_labels(rows, "label")


def test_stored_sketches_merge(spark):
    rows = spark.range(6000).selectExpr("id % 3 AS part", "id % 2000 AS same", "CAST(NULL AS string) AS none", "CAST(id AS string) AS own")
    stored = profile.distinct_sketches(rows, ["same", "none", "own"], ["part"])
    found = {r["feature"]: r["estimate"] for r in profile.sketched_counts(stored).collect()}
    assert found["none"] == 0
    assert found["same"] == pytest.approx(2000, rel=3 * profile.SKETCH_ERROR) and found["own"] == pytest.approx(6000, rel=3 * profile.SKETCH_ERROR)
    per_part = {(r["part"], r["feature"]): r["estimate"] for r in profile.sketched_counts(stored, ["part"]).collect()}
    assert per_part[0, "own"] == pytest.approx(2000, rel=3 * profile.SKETCH_ERROR) and len(per_part) == 9
    assert profile.sketched_counts(profile.distinct_sketches(rows.limit(0), ["own"])).first()["estimate"] == 0


def test_deep_forest_keeps_the_rows_nodes_and_its_trees(data):
    """Without kept nodes every level of the fixed forest sends all its trees to the tasks; the trees are the same."""
    forest = training.legacy_estimators(data.train_rows)["RandomForestClassifier"]
    assert forest.getCacheNodeIds() and forest.getMaxDepth() == training.FOREST_DEPTH
    few, plain = (forest.copy()._set(numTrees=10, cacheNodeIds=kept) for kept in (True, False))
    without_uid = lambda model: model.toDebugString.split("\n", 1)[1]
    assert without_uid(few.fit(data.train)) == without_uid(plain.fit(data.train))


def test_fixed_models_are_fitted_once(spark, small, monkeypatch):
    from staywise.plans import catalog

    calls = []
    monkeypatch.setattr(catalog, "_legacy", {})
    monkeypatch.setattr(training, "train_legacy", lambda *a: calls.append(a) or ("metrics", "best", {}))
    assert catalog.fixed_models(spark, small) == catalog.fixed_models(spark, small) == ("metrics", "best", {})
    assert len(calls) == 1


def test_first_rounds_of_a_boosted_model_are_the_shorter_model(data):
    from pyspark.ml.functions import vector_to_array

    estimator = training.search_space("GradientBoostingClassifier", 10)[0]
    long, short = (estimator.copy()._set(maxIter=rounds, stepSize=0.1).fit(data.train) for rounds in (6, 3))
    cut = training.first_rounds(long, 3)
    assert cut.getNumTrees == 3 and long.getNumTrees == 6
    assert cut.toDebugString.split("\n", 1)[1] == short.toDebugString.split("\n", 1)[1] and cut.treeWeights == short.treeWeights
    scores = [sorted((r[0], r[1]) for r in m.transform(data.test).select("customerID", vector_to_array("probability")[1]).collect()) for m in (cut, short)]
    assert scores[0] == scores[1]


def test_boosted_search_fits_each_rate_once_per_fold(spark, data, monkeypatch):
    """Two rounds for the short and four for the long settings: ten fits of folds and one of the winner, figures as of single fits."""
    from pyspark.ml.classification import GBTClassifier

    fitted = []
    plain = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: fitted.append(self.getMaxIter()) or plain(self, rows))
    monkeypatch.setattr(training, "BOOST_GRID", ((2, 0.1), (2, 0.01), (4, 0.1), (4, 0.01)))
    _, best = training.search(data, "GradientBoostingClassifier")
    assert sorted(fitted[:10]) == [4] * 10 and len(fitted) == 11
    train, held = training.staged_fold(data, 3)
    for at, (rounds, rate) in enumerate(training.BOOST_GRID):
        model = training.search_space("GradientBoostingClassifier", 10)[0].copy()._set(maxIter=rounds, stepSize=rate).fit(train)
        assert best.fold_auc[3][at] == pytest.approx(training.exact_auc().evaluate(model.transform(held)), abs=1e-12)


def test_searched_forests_keep_the_rows_nodes_and_their_trees(data):
    estimator, grid = training.search_space("RandomForestClassifier", data.train_rows)
    assert estimator.getCacheNodeIds()
    kept, plain = (estimator.copy()._set(numTrees=5, maxDepth=10, cacheNodeIds=way).fit(data.train) for way in (True, False))
    assert kept.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
