import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from staywise.llm import exact_dedup
from tests.llm.conftest import frame, sentences


def brute(rows):
    forms = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    members = defaultdict(list)
    for i, form in forms:
        members[form].append(i)
    least = {form: min((i for i in ids if i is not None), default=None) for form, ids in members.items()}
    return sorted(((i, least[f], len(members[f]), i == least[f], hashlib.sha256(f.encode()).hexdigest()) for i, f in forms), key=str)


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(odd, odd_rows):
    assert made(exact_dedup.groups(odd)) == brute(odd_rows)


def test_directory_doubles_and_keeps_results(spark, odd, odd_rows):
    index = exact_dedup.build(odd, capacity=2)
    buckets = index.read(spark, "directory").collect()
    assert index.depth > 3 and len({b["depth"] for b in buckets}) > 1
    assert all(b["n_keys"] <= 2 for b in buckets)
    # The buckets cover the key space once.
    assert sum(2.0 ** -b["depth"] for b in buckets) <= 1
    assert made(exact_dedup.resolve(spark, index)) == brute(odd_rows)


def test_equal_keys_are_chained_by_bytes(spark, odd, odd_rows):
    index = exact_dedup.build(odd, capacity=2, key_of=lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    entries = index.read(spark, "entries")
    assert entries.where("chain > 0").count() > 0
    assert made(exact_dedup.resolve(spark, index)) == brute(odd_rows)


def test_flushes_are_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH_BYTES", 100)
    rows = [(k, text, "s") for k, text in enumerate(sentences(2, 8) * 40)]
    assert made(exact_dedup.groups(frame(spark, rows))) == brute(rows)


def test_short_and_wide_texts_are_flushed_by_the_memory_they_take(monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH_BYTES", 1 << 20)
    # A million bytes are held by some 2,700 texts of a few characters, or by 4 of 65,536 characters of four bytes each.
    for texts in [str(k) for k in range(20_000)], ["\U0001F600" * 65_536 + str(k) for k in range(8)]:
        batch = pa.record_batch({"doc_id": range(len(texts)), "key": range(len(texts)), "text": texts})
        sent = [row["text"] for part in exact_dedup._combine([0])([batch, batch]) for row in part.to_pylist()]
        # A flush forgets its texts, so those that come again are sent again.
        assert set(sent) == set(texts) and len(sent) > 1.5 * len(texts)


def test_deduplicate_keeps_columns(odd, odd_rows):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in odd_rows})


def test_empty(none):
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_deduplicate_keeps_every_text_of_shared_ids(spark):
    rows = [(None, "a", "s"), (None, "b", "s"), (None, "b", "s"), (1, "x", "s"), (7, "x", "s"), (7, "y", "s"), (None, "x", "s"), (8, None, "s")]
    kept = exact_dedup.deduplicate(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, "a"), (None, "b"), (1, "x"), (7, "y"), (8, None)], key=str)
