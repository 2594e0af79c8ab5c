import hashlib
import math

import pytest
from pyspark.sql import functions as F

from staywise.llm import mixing
from tests.llm.conftest import frame, sentences


def drawn(rate, doc, text, seed=42):
    u = int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:13], 16) / 16**13
    k, upto = 0, math.exp(-rate)
    while upto <= u:
        k += 1
        upto += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


WEIGHTS = {"src0": 0.5, "src1": 0.3, None: 0.2, "absent": 9.0, "src2": 0.0}


def test_against_brute_force(odd, odd_rows):
    size = {}
    for _, t, s in odd_rows:
        size[s] = size.get(s, 0) + len(t or "")
    total, whole = sum(size.values()), sum(w for s, w in WEIGHTS.items() if size.get(s))
    rate = {s: 2 * total * w / whole / size[s] for s, w in WEIGHTS.items() if size.get(s)}
    want = sorted(((i, t, s, k) for i, t, s in odd_rows if rate.get(s) for k in range(1, drawn(rate[s], i, t) + 1)), key=str)
    mixed = mixing.mix(odd, WEIGHTS, epochs=2.0)
    # ``copy`` is taken, so the copy number is called copy_.
    assert mixed.columns == [*odd.columns, "copy_"]
    assert sorted(((r["doc_id"], r["text"], r["source"], r["copy_"]) for r in mixed.collect()), key=str) == want
    assert mixing.rates(odd, WEIGHTS, 2.0) == pytest.approx({s: r for s, r in rate.items() if r})


def test_shares_come_near_the_targets(spark):
    rows = [(k, text, "hot" if k % 10 else "rare") for k, text in enumerate(sentences(8, 3000, 5))]
    mixed = mixing.mix(frame(spark, rows), {"hot": 0.5, "rare": 0.5}).groupBy("source").sum("n_chars").collect()
    sizes = dict(tuple(r) for r in mixed)
    assert sizes["hot"] / sum(sizes.values()) == pytest.approx(0.5, abs=0.05)


def test_shuffle_spreads_copies_and_sources(spark):
    rows = [(k, "word " * 5, "a" if k < 500 else "b") for k in range(1000)]
    order = [r["doc_id"] for r in mixing.mix(frame(spark, rows), {"a": 1.0, "b": 1.0}).collect()]
    assert order != sorted(order) and 100 < sum(x < 500 for x in order[:400]) < 300


@pytest.mark.parametrize("rate", [0.01, 1.0, 30.0, 2000.0, 1e6])
def test_distribution(rate):
    first, sums = mixing.distribution(rate)
    assert sums == sorted(sums) and sums[-1] == pytest.approx(1, abs=1e-9)
    assert first + sum(1 - x for x in sums) == pytest.approx(rate, rel=1e-6)
    assert len(sums) < 130 + 29 * math.sqrt(rate)


@pytest.mark.parametrize("seed", range(5))
def test_null_and_shared_ids_draw_row_by_row(spark, seed):
    rows = [(None, text, "a") for text in sentences(11, 1000, 6)] + [(7, text, "a") for text in sentences(12, 1000, 6)]
    rows += [(None, "same text", "a")] * 500
    mixed = mixing.mix(frame(spark, rows), {"a": 1.0}, 2.0, seed)
    by_id = dict(mixed.where("text <> 'same text'").groupBy("doc_id").count().collect())
    assert by_id[None] == pytest.approx(2000, abs=250) and by_id[7] == pytest.approx(2000, abs=250)
    sizes = [r[0] for r in mixed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def test_sources_without_a_weight(spark):
    rows = [(k, text, ("a", "b", None, "new")[k % 4]) for k, text in enumerate(sentences(13, 2000, 6))]
    docs = frame(spark, rows)
    weights = {"a": 0.8, "b": 0.2, "zero": 0.0}
    size = {s: sum(len(t) for _, t, x in rows if x == s) for s in ("a", "b")}
    rate = {s: sum(size.values()) * weights[s] / size[s] for s in size}
    want = {s: sum(drawn(rate.get(s, 1.0), i, t) for i, t, x in rows if x == s) for s in ("a", "b", None, "new")}
    found = dict(mixing.mix(docs, weights, others=1.0).groupBy("source").count().collect())
    assert found == want and found["new"] > 400
    assert set(dict(mixing.mix(docs, weights).groupBy("source").count().collect())) == {"a", "b"}


def test_no_weights_and_empty(odd, none):
    assert mixing.mix(odd, {}).count() == 0 and mixing.mix(none, WEIGHTS).count() == 0
    assert mixing.mix(odd, {"src0": 0.0}).count() == 0
