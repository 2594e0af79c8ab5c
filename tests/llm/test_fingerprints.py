import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from staywise.llm import fingerprints
from staywise.llm.common import texts_of
from staywise.llm.queries import op9_fingerprints
from tests.llm.conftest import frame


def simhash(text):
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    hashed = [(i, t or "", xxhash.xxh64_intdigest(t or "", 42) >> 33) for i, t, _ in rows]
    rows = sorted(hashed, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    found = []
    for k, (i, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        prints = [simhash(x) for x in (text, edited, following)]
        found.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints))
    return sorted(found, key=str)


def signed(x):
    return x % (1 << 64)


def test_against_brute_force(odd, odd_rows):
    found = [(i, n, d, signed(a), signed(b), signed(c)) for i, n, d, a, b, c in map(tuple, fingerprints.compare_edits(odd).collect())]
    assert sorted(found, key=str) == brute(odd_rows)


def test_ids_far_apart(spark):
    rows = [(i, f"text of {i} with words", "s") for i in (-(1 << 40), -5, 0, 1023, 1024, 1 << 21, (1 << 21) + 1, 1 << 50)]
    found = [(i, n, d, signed(a), signed(b), signed(c)) for i, n, d, a, b, c in map(tuple, fingerprints.compare_edits(frame(spark, rows)).collect())]
    assert sorted(found, key=str) == brute(rows)


def test_shared_and_missing_ids_are_spread(spark):
    rows = [(None, f"no id, text {k} of many", "s") for k in range(300)] + [(7, f"shared id, text {k}", "s") for k in range(300)] + [(k, f"own {k}", "s") for k in range(300)]
    rows += [(None, "no id, text 1 of many", "s"), (10**15, "far", "s"), (-(1 << 62), "lowest", "s")]
    docs = frame(spark, rows)
    found = [(i, n, d, signed(a), signed(b), signed(c)) for i, n, d, a, b, c in map(tuple, fingerprints.compare_edits(docs).collect())]
    assert sorted(found, key=str) == brute(rows)
    sizes = fingerprints.with_next(docs).where("NOT guest").groupBy("slice").count()
    assert sizes.agg({"count": "max"}).first()[0] < 120, "no slice holds a hot id whole"


@pytest.mark.parametrize("bounds", [[], [5], [5, 5, 5], [-3, 0, 0, 0, 2, 9, 9, 40], list(range(0, 300, 3))])
def test_count_up_to(spark, bounds):
    values = spark.createDataFrame([(v,) for v in (-10, -3, 0, 1, 2, 5, 9, 40, 41, 150, 299)], "v long")
    for equal in (False, True):
        got = values.select("v", fingerprints.count_up_to(bounds, F.col("v"), equal)).collect()
        assert all(n == sum(b <= v if equal else b < v for b in bounds) for v, n in got)


def test_one_row_and_none(spark, none):
    assert fingerprints.compare_edits(none).count() == 0
    one = fingerprints.compare_edits(frame(spark, [(5, "just this text here", "s")])).first()
    assert one["fp"] == one["next_fp"]


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 6), (2, 5), (0, 1)])
def test_within_radius(spark, odd, radius, blocks):
    prints = fingerprints.fingerprints(texts_of(odd), ["doc_id", "text"]).select("fp")
    extra = [(r["fp"] ^ mask,) for r in prints.limit(6).collect() for mask in (1, 3, 1 << 62, 7, 15, (1 << 40) | 1)]
    prints = prints.union(spark.createDataFrame([*extra, (None,)], "fp long"))
    values = {r["fp"] for r in prints.collect()} - {None}
    pairs = [tuple(r) for r in fingerprints.within_radius(prints, prints, radius, blocks).collect()]
    found = set(pairs)
    assert len(found) == len(pairs), "a pair that meets in several tables is returned once"
    near = {(a, b, signed(a ^ b).bit_count()) for a in values for b in values if a != b}
    assert found == {x for x in near if x[2] <= radius}


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = {x[0]: x[1:] for x in brute(rows)}
    for r in op9_fingerprints(spark, small).collect():
        n, digest, fp, edited, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, digest, f"{fp:016x}", f"{edited:016x}")
        assert r["near_edited"] == 1 - (fp ^ edited).bit_count() / 64 and r["near_next"] == 1 - (fp ^ following).bit_count() / 64
        others = {print_ for _, _, print_, _, _ in want.values()} - {fp}
        near = sum((fp ^ other).bit_count() <= 3 for other in others)
        assert r["n_near"] == (near if r["doc_id"] % 20 == 0 else None)
