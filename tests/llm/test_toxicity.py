import zlib

import numpy as np
import pytest

from staywise.llm import toxicity
from staywise.llm.common import load
from staywise.llm.queries import op2_toxicity
from tests.llm.conftest import frame, sentences


def test_slots_are_those_of_word_grams():
    def plain(text):
        found = set()
        padded = " " + " ".join(text.lower().split()) + " "
        for n in toxicity.SIZES:
            for at in range(len(padded) - n + 1):
                gram = padded[at : at + n]
                if " " not in gram[1:-1]:
                    found.add(gram)
        return found

    texts = ["An idiot, É b", "", "x", "two words here", "  many   blanks "]
    slots = {}
    for text in texts:
        have = toxicity.slots_of(text).tolist()
        grams = plain(text)
        assert len(have) <= len(grams) and bool(have) == bool(grams)
        for gram in grams:
            alone = toxicity.slots_of(text)
            slots.setdefault(gram, set(alone.tolist())).intersection_update(alone.tolist())
    assert all(slots.values())


def test_long_texts_are_read_in_segments(monkeypatch):
    texts = sentences(3, 4, 400) + ["x" * 500, "é " * 300]
    whole = [toxicity.slots_of(text).tolist() for text in texts]
    monkeypatch.setattr(toxicity, "SEGMENT", 17)
    assert [toxicity.slots_of(text).tolist() for text in texts] == whole


def test_scores_against_a_plain_sum(spark):
    """Log-count ratios, picked slots and scores worked out anew from the definition."""
    texts = sentences(4, 120, 8)
    rows = [(k, t + (" foul" if k % 3 == 0 else ""), "s") for k, t in enumerate(texts)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(100)], "doc_id long, label int")
    model = toxicity.fit(docs, labels, features=300)
    counts = {0: {}, 1: {}}
    for k, text, _ in rows[:100]:
        for slot in toxicity.slots_of(text).tolist():
            of = counts[int(k % 3 == 0)]
            of[slot] = of.get(slot, 0) + 1
    toxic = sum(k % 3 == 0 for k in range(100))
    ratio, pull = {}, {}
    for slot in {*counts[0], *counts[1]}:
        p, q = counts[1].get(slot, 0) + 1, counts[0].get(slot, 0) + 1
        if p + q - 2 >= toxicity.LEAST_TEXTS:
            ratio[slot] = np.log(p / (toxic + 2)) - np.log(q / (102 - toxic))
            pull[slot] = abs(ratio[slot]) / np.sqrt(1 / p + 1 / q)
    best = sorted(pull, key=lambda slot: (-round(pull[slot], 12), slot))[:300]
    assert set(np.flatnonzero(model.weights).tolist()) <= {slot for slot in ratio if pull[slot] >= pull[best[-1]] - 1e-9}
    x = np.array([[ratio[s] if s in set(toxicity.slots_of(t).tolist()) else 0.0 for s in best] for _, t, _ in rows])
    y = np.array([float(k % 3 == 0) for k in range(100)])
    w, b = model.weights[best] / np.array([ratio[s] for s in best]), model.intercept
    # The fit stands at the least penalised loss: its gradient vanishes.
    residual = 1 / (1 + np.exp(-(x[:100] @ w + b))) - y
    assert np.abs(x[:100].T @ residual / 100 + toxicity.PENALTY * w).max() < 1e-3 and abs(residual.mean()) < 1e-3
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k in range(120):
        assert found[k] == pytest.approx(1 / (1 + np.exp(-(x[k] @ w + b))), abs=1e-9)


def test_penalty_losses_use_the_given_labels_only(spark):
    texts = sentences(6, 80, 8)
    docs = frame(spark, [(k, t + (" foul" if k % 2 else ""), "s") for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, label int")
    losses = toxicity.penalty_losses(docs, labels, [0.001, 100.0], folds=2)
    assert losses[0.001] < losses[100.0] and losses[100.0] == pytest.approx(np.log(2), abs=0.15)


def test_learns_a_word(spark):
    texts = sentences(1, 200)
    rows = [(k, t + (" vile" if k % 4 == 0 else ""), "s") for k, t in enumerate(texts)]
    docs = frame(spark, rows + [(500, None, "s"), (501, "", "s"), (None, "vile", "s")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 160)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.labelled_rows(labels))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    # Rows 160 to 199 are unseen; few rows and many random words leave some doubt.
    assert np.mean([(scores[k] >= 0.5) == (k % 4 == 0) for k in range(200)]) > 0.9
    toxic, clean = ([scores[k] for k in range(200) if (k % 4 == 0) == kind] for kind in (True, False))
    assert np.mean([np.mean([t > c for c in clean]) for t in toxic]) > 0.95
    assert scores[500] == scores[501] < scores[None]
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {k for k, score in scores.items() if score < 0.5} and {500, 501} <= kept
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_one_class_and_empty(spark, none):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    docs = frame(spark, [(1, "a b", "s")])
    model = toxicity.fit(docs, toxicity.labelled_rows(labels))
    assert not model.weights.any() and 0 < toxicity.score(docs, model).first()["score"] < 0.5
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, toxicity.labelled_rows(labels)).intercept == 0.0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, folder).collect()
    assert len(rows) == load(spark, folder).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in load(spark, folder, "labels").collect()}
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y, _ in held]) > 0.95
    # Clean documents are left alone.
    assert np.mean([p for p, y, _ in held if not y]) < 0.01
    toxic, clean = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([np.mean([t > c for c in clean]) for t in toxic]) > 0.97


@pytest.mark.parametrize("missing", ["doc_id", "text"])
def test_all_null_column(spark, missing):
    docs = frame(spark, [(None if missing == "doc_id" else 1, None if missing == "text" else "a", "s")] * 2)
    assert toxicity.score(docs, toxicity.Model(np.zeros(1 << toxicity.SLOT_BITS), -1.0)).count() == 2


def test_keeps_clean_rows_of_shared_ids_only(spark):
    bad = "vile"
    weights = np.zeros(1 << toxicity.SLOT_BITS)
    weights[toxicity.slots_of(bad)] = 1.0
    rows = [(None, "fine words", "s"), (None, bad, "s"), (7, bad, "s"), (7, "other words", "s"), (8, None, "s")]
    kept = toxicity.keep_clean(frame(spark, rows), toxicity.Model(weights, -1.0)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, "fine words"), (7, "other words"), (8, None)], key=str)
