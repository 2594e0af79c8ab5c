import numpy as np
import pytest
import xxhash

from staywise.llm import simhash_dedup
from staywise.llm.components import components
from tests.llm.conftest import frame, sentences


def slow_print(text, words=4):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def closed(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_is_by_definition():
    for text in [*sentences(3, 20), "", " \n", "One", "ÄÖ two  THREE", "a b c d"]:
        assert simhash_dedup.fingerprint(text) == slow_print(text)


def brute(rows, radius=4):
    prints = [(i, slow_print(t or "")) for i, t, _ in rows]
    distinct = sorted({fp for _, fp in prints})
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= radius]
    roots = closed(links, distinct)
    least = {}
    for i, fp in prints:
        ids = [x for x in (least.get(roots[fp]), i) if x is not None]
        least[roots[fp]] = min(ids) if ids else None
    return sorted(((i, f"{fp:016x}", least[roots[fp]]) for i, fp in prints), key=str)


@pytest.mark.parametrize("tile", [4, 32_768])
def test_against_brute_force(odd, odd_rows, tile):
    assert sorted((tuple(r) for r in simhash_dedup.groups(odd, tile=tile).collect()), key=str) == brute(odd_rows)


def test_spark_hashes_alike(spark):
    text = "some words é"
    assert spark.range(1).selectExpr(f"xxhash64('{text}') AS h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(text, 42)


def test_links_of_random_prints(spark):
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 20, dtype=np.int64)
    values = {0, -1} | {int(c) ^ sum(1 << int(b) for b in r.integers(0, 63, r.integers(0, 5))) for c in centres for _ in range(15)}
    classes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash_dedup.links(classes, tile=16).collect()
    want = [(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert closed([tuple(x) for x in found], values) == closed(want, values)
    assert all(((a ^ b) % (1 << 64)).bit_count() for a, b in found)


def test_forest_of_a_dense_group_is_small():
    group = np.array([1 << k for k in range(40)], dtype=np.uint64)
    child, root = simhash_dedup.forest(group, group, 4, same=True)
    assert len(child) == 39 and set(root) == {0}


def test_components(spark):
    r = np.random.default_rng(7)
    pairs = [tuple(map(int, p)) for p in r.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 2000 + k) for k in range(300)]
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    found = dict(tuple(x) for x in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = closed(pairs, {n for p in pairs for n in p})
    assert {n: found.get(n, n) for n in nodes} == {n: want[n] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate(odd, odd_rows):
    kept = simhash_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -99 for r in kept.collect()) == sorted({c or -99 for _, _, c in brute(odd_rows)})


def test_empty(spark, none):
    assert simhash_dedup.groups(none).count() == 0 and simhash_dedup.deduplicate(none).count() == 0
    blank = frame(spark, [(1, None, "s"), (2, " ", "s")])
    assert {r["component_id"] for r in simhash_dedup.groups(blank).collect()} == {1}


def test_deduplicate_keeps_every_component_of_shared_ids(spark):
    a, b, c, d = sentences(21, 4, 60)
    rows = [(None, a, "s"), (None, b, "s"), (None, b + " ", "s"), (7, c, "s"), (7, d, "s"), (None, c, "s"), (9, d, "s"), (9, " " + d, "s")]
    kept = simhash_dedup.deduplicate(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"].strip()) for r in kept), key=str) == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)
