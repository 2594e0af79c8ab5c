"""Exact path-dependent attributions of tree ensembles.

For a leaf, only the features on its path matter, and for each of them only
whether the row meets all of the path's conditions on it.  A feature's share
is the Shapley value of the game in which a present feature keeps or rules out
the leaf and an absent one passes it on with its share of training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.sql import array, number, struct, text
from staywise.operators.explain import DECREASES, INCREASES
from staywise.operators.ordering import fit_medians
from staywise.operators.training import MARGIN_SCALE
from staywise.session import fresh_path


@dataclass(frozen=True)
class Node:
    """A split (rows with x[feature] <= threshold go left) or, without children, a leaf."""

    value: float
    cover: float
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass(frozen=True)
class Tree:
    weight: float
    nodes: dict[int, Node]

    @property
    def splits(self) -> list[int]:
        return sorted(i for i, node in self.nodes.items() if not node.is_leaf)


@dataclass(frozen=True)
class Leaf:
    """Value of a leaf and, per path feature, its cover ratio and its conditions (split, goes left)."""

    value: float
    ratios: dict[int, float]
    conditions: dict[int, tuple[tuple[int, bool], ...]]


def explainer_kind(model: Model) -> str:
    if isinstance(model, LogisticRegressionModel):
        return "linear"
    if isinstance(model, (GBTClassificationModel, RandomForestClassificationModel, DecisionTreeClassificationModel)):
        return "tree"
    raise TypeError(f"no exact explainer for {type(model).__name__}")


def leaves(tree: Tree) -> list[Leaf]:
    found: list[Leaf] = []
    open_paths = [(0, {}, {})]
    while open_paths:
        index, ratios, conditions = open_paths.pop()
        node = tree.nodes[index]
        if node.is_leaf:
            found.append(Leaf(tree.weight * node.value, ratios, conditions))
            continue
        for child, goes_left in ((node.left, True), (node.right, False)):
            share = tree.nodes[child].cover / node.cover
            open_paths.append(
                (
                    child,
                    {**ratios, node.feature: ratios.get(node.feature, 1.0) * share},
                    {**conditions, node.feature: (*conditions.get(node.feature, ()), (index, goes_left))},
                )
            )
    return found


def base_value(trees: Sequence[Tree]) -> float:
    return sum(leaf.value * float(np.prod(list(leaf.ratios.values()) or [1.0])) for t in trees for leaf in leaves(t))


def leaf_shares(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Shapley shares of one leaf; ``met`` is rows × path features of 0/1, in the leaf's feature order.

    Subsets of equal size carry the same weight, so the product over the other
    features is expanded by subset size instead of subset by subset.
    """
    ratios = np.array(list(leaf.ratios.values()))
    m = len(ratios)
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    shares = np.empty(met.shape)
    for j in range(m):
        by_size = np.zeros((len(met), m))
        by_size[:, 0] = 1.0
        for k in range(m):
            if k != j:
                kept = np.zeros_like(by_size)
                kept[:, 1:] = by_size[:, :-1] * met[:, [k]]
                by_size = by_size * ratios[k] + kept
        shares[:, j] = leaf.value * (by_size @ weights) * (met[:, j] - ratios[j])
    return shares


def read_trees(model: Model) -> list[Tree]:
    """Node tables of a fitted model, read from its saved form; as large as the model, not the data."""
    spark = SparkSession.active()
    path = fresh_path(spark, "model")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in saved.columns
    if single:
        nodes = saved.select(F.lit(0).alias("tree"), F.struct("*").alias("n"))
    else:
        nodes = saved.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
    rows = nodes.collect()
    boosted = isinstance(model, GBTClassificationModel)
    if boosted:
        weights = [MARGIN_SCALE * w for w in model.treeWeights]
    else:
        count = 1 if single else model.getNumTrees
        weights = [1.0 / count] * count
    tables: dict[int, dict[int, Node]] = {}
    for row in rows:
        n = row["n"]
        stats = list(n["impurityStats"])
        # Boosting trees are regression trees (count, sum, …); classifiers keep counts per class.
        cover = float(stats[0]) if boosted else float(sum(stats))
        value = float(n["prediction"]) if boosted else float(stats[1] / sum(stats))
        node = Node(value, cover)
        if n["leftChild"] >= 0:
            split = n["split"]
            limit = float(split["leftCategoriesOrThreshold"][0])
            node = Node(value, cover, split["featureIndex"], limit, n["leftChild"], n["rightChild"])
        tables.setdefault(row["tree"], {})[n["id"]] = node
    return [Tree(weights[i], tables[i]) for i in sorted(tables)]


def _met(leaf: Leaf, goes_left: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
    """rows × path features: does the row meet every condition the path puts on the feature?"""
    met = np.ones((rows, len(leaf.ratios)))
    for position, feature in enumerate(leaf.ratios):
        for split, left in leaf.conditions[feature]:
            met[:, position] *= goes_left(split) == left
    return met


#: Leaves of all trees together that a task may hold; a model beyond that is refused, not cut.
MOST_LEAVES = 1_000_000


#: Numbers of the share table; an ensemble beyond that is explained batch by batch.
MOST_SHARES = 4_000_000
#: Splits up to which a tree is one piece of the table, with a bit for each split.
PIECE_SPLITS = 8


@dataclass(frozen=True)
class Piece:
    """Part of an ensemble that a few yes/no answers decide: their conditions, and the features' shares for every answer.

    A small tree is one piece, its splits are the answers.  Of a larger tree
    every leaf is one; the answers are, for each path feature, whether the row
    meets all conditions on it.
    """

    conditions: tuple[str, ...]
    shares: np.ndarray


def _split_sql(node: Node, left: bool = True) -> str:
    return f"x[{node.feature}] {'<=' if left else '>'} {number(node.threshold)}"


def _answers(bits: int) -> np.ndarray:
    """All combinations of ``bits`` answers, row k holding those of the mask k."""
    return (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1


def pieces(trees: Sequence[Tree], width: int) -> list[Piece] | None:
    """The share table of an ensemble, or none where it would have more than ``MOST_SHARES`` numbers."""
    found: list[Piece] = []
    room = MOST_SHARES
    for tree in trees:
        splits = tree.splits
        if not splits:
            continue
        if len(splits) <= PIECE_SPLITS:
            parts = [(tuple(_split_sql(tree.nodes[s]) for s in splits), leaves(tree))]
        else:
            parts = [
                (tuple(" AND ".join(_split_sql(tree.nodes[s], left) for s, left in conditions) for conditions in leaf.conditions.values()), [leaf])
                for leaf in leaves(tree)
            ]
        for conditions, of_piece in parts:
            room -= width << len(conditions)
            if room < 0:
                return None
            answers = _answers(len(conditions))
            shares = np.zeros((len(answers), width))
            for leaf in of_piece:
                whole = len(splits) <= PIECE_SPLITS
                met = _met(leaf, lambda s: answers[:, splits.index(s)] == 1, len(answers)) if whole else answers.astype(float)
                shares[:, list(leaf.ratios)] += leaf_shares(leaf, met)
            found.append(Piece(conditions, shares))
    return found


def share_table(spark: SparkSession, table: Sequence[Piece]) -> DataFrame:
    """(piece, mask, s0, s1, …): one row for every answer of every piece, of known size."""
    counts = [len(piece.shares) for piece in table]
    shares = np.concatenate([piece.shares for piece in table])
    columns = {
        "piece": pa.array(np.repeat(np.arange(len(table), dtype=np.int32), counts)),
        "mask": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
    }
    return spark.createDataFrame(pa.table(columns | {f"s{i}": shares[:, i] for i in range(shares.shape[1])}))


def joined_attributions(rows: DataFrame, table: Sequence[Piece], key: str, width: int) -> DataFrame:
    """(key, x, attributions) by one join and one sum: a row meets each piece once, in the answer it gives.

    Sums form where the row lies, before anything is shuffled.
    """
    masks = array(
        " + ".join(f"if({condition}, {1 << bit}, 0)" for bit, condition in enumerate(piece.conditions)) for piece in table
    )
    met = rows.select(key, "x", F.monotonically_increasing_id().alias("_row")).select("*", F.posexplode(F.expr(masks)).alias("piece", "mask"))
    sums = met.join(share_table(rows.sparkSession, table), ["piece", "mask"]).groupBy(key, "_row").agg(
        F.any_value("x").alias("x"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    )
    return sums.select(key, "x", F.array(*[f"s{i}" for i in range(width)]).alias("attributions"))


def array_attributions(rows: DataFrame, trees: Sequence[Tree], key: str, width: int) -> DataFrame:
    """(key, x, attributions) of rows whose features are an array ``x``, one for each row, whatever its key.

    By the share table if it has at most ``MOST_SHARES`` numbers, else batch by
    batch; both give the same shares.
    """
    table = pieces(trees, width)
    if table is None:
        return batch_attributions(rows, trees, key, width)
    if not table:
        return rows.select(key, "x", F.array_repeat(F.lit(0.0), width).alias("attributions"))
    return joined_attributions(rows, table, key, width)


def batch_attributions(rows: DataFrame, trees: Sequence[Tree], key: str, width: int) -> DataFrame:
    """(key, x, attributions) of ensembles with deep trees.

    Each batch evaluates a leaf only for the distinct condition patterns that
    occur in it.  Rows are independent, so nothing is shuffled; every task
    holds the leaves, whose number is checked.
    """
    forest = [(tree, leaves(tree)) for tree in trees if tree.splits]
    if sum(len(found) for _, found in forest) > MOST_LEAVES:
        raise ValueError(f"the ensemble has more than {MOST_LEAVES} leaves")
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, width))
            total = np.zeros((len(batch), width))
            for tree, found in shared.value:
                outcome = {s: matrix[:, tree.nodes[s].feature] <= tree.nodes[s].threshold for s in tree.splits}
                for leaf in found:
                    met = _met(leaf, outcome.__getitem__, len(batch))
                    patterns, which = np.unique(met, axis=0, return_inverse=True)
                    total[:, list(leaf.ratios)] += leaf_shares(leaf, patterns)[which.reshape(-1)]
            yield pd.DataFrame({key: batch[key], "x": batch["x"], "attributions": list(total)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInPandas(explain, f"`{key}` {kind}, x array<double>, attributions array<double>")


def tree_attributions(rows: DataFrame, trees: Sequence[Tree], key: str, vector: str, width: int) -> DataFrame:
    """(key, x, attributions) of assembled rows."""
    return array_attributions(rows.select(key, vector_to_array(vector).alias("x")), trees, key, width)


def ensemble_margin(trees: Sequence[Tree], x: Callable[[int], Column]) -> Column:
    """Weighted sum of the leaves a row falls into, for a small frozen ensemble."""

    def value(tree: Tree, index: int) -> Column:
        node = tree.nodes[index]
        if node.is_leaf:
            return F.lit(float(tree.weight * node.value))
        return F.when(x(node.feature) <= node.threshold, value(tree, node.left)).otherwise(value(tree, node.right))

    return sum((value(tree, 0) for tree in trees), F.lit(0.0))


def importance_from_attributions(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean magnitude per feature in one pass."""
    cells = array(
        struct({"feature": text(name), "mean_abs_contribution": f"avg(abs(attributions[{i}]))"})
        for i, name in enumerate(names)
    )
    return explained.agg(F.expr(cells).alias("cells")).select(F.inline("cells"))


def direction_from_attributions(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean attribution while a feature is active: indicator at 1, or number above its median; else 0."""
    columns = explained.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(names))])
    ranges = columns.select(
        *[F.expr(f"min(x{i}) = 0 AND max(x{i}) = 1 AND count_if(x{i} NOT IN (0D, 1D)) = 0").alias(f"b{i}") for i in range(len(names))]
    ).first()
    numbers = [i for i in range(len(names)) if not ranges[f"b{i}"]]
    medians = fit_medians(columns, [f"x{i}" for i in numbers]) if numbers else {}
    cells = []
    for i, name in enumerate(names):
        active = f"x[{i}] = 1" if ranges[f"b{i}"] else f"x[{i}] > {number(medians.get(f'x{i}', 0.0))}"
        effect = f"coalesce(avg(CASE WHEN {active} THEN attributions[{i}] END), 0D)"
        cells.append(struct({"feature": text(name), "active_effect": effect}))
    effects = explained.agg(F.expr(array(cells)).alias("cells")).select(F.inline("cells"))
    return effects.withColumn("direction", F.when(F.col("active_effect") > 0, INCREASES).otherwise(DECREASES))


def ranked_attributions(explained: DataFrame, names: Sequence[str], key: str, top: int | None = None) -> DataFrame:
    """Long form, largest magnitude first within each row, the name deciding a tie."""
    items = array(
        struct(
            {"order": f"-round(abs(attributions[{i}]), 9)", "feature": text(name), "contribution": f"attributions[{i}]", "value": f"x[{i}]"}
        )
        for i, name in enumerate(names)
    )
    ordered = f"sort_array({items})" if top is None else f"slice(sort_array({items}), 1, {int(top)})"
    return explained.select(key, F.posexplode(F.expr(ordered)).alias("position", "item")).select(
        key, (F.col("position") + 1).cast("bigint").alias("rank"), "item.feature", "item.value", "item.contribution"
    )


def attribution_change(before: DataFrame, after: DataFrame, names: Sequence[str], key: str, top: int = 5) -> DataFrame:
    """Features whose attribution moves most between two states of the same rows, matched on the unique key."""
    old = before.select(key, F.col("attributions").alias("old"))
    new = after.select(key, F.col("attributions").alias("new"))
    items = array(
        struct(
            {
                "order": f"-round(abs(new[{i}] - old[{i}]), 9)",
                "feature": text(name),
                "baseline_contribution": f"old[{i}]",
                "simulated_contribution": f"new[{i}]",
                "delta": f"new[{i}] - old[{i}]",
            }
        )
        for i, name in enumerate(names)
    )
    ordered = F.expr(f"slice(sort_array({items}), 1, {int(top)})")
    return old.join(new, key).select(key, F.posexplode(ordered).alias("position", "item")).select(
        key,
        (F.col("position") + 1).cast("bigint").alias("rank"),
        "item.feature",
        "item.baseline_contribution",
        "item.simulated_contribution",
        "item.delta",
    )
