import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staywise.llm import suffix_dedup
from staywise.llm.queries import op1_suffix_dedup
from staywise.llm.suffix_array import suffix_array
from tests.llm.conftest import frame


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60) | st.lists(st.integers(0, 300), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, dtype=np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(rows, length):
    """(id, bytes, removed runs, rest) per row; ids decide, strings are judged on the input."""
    last = 1 << 62
    first = {}
    for i, text in rows:
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            first[window] = min(first.get(window, last), last if i is None else i)
    found = []
    for i, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < (last if i is None else i):
                gone[at : at + length] = b"\1" * length
        turns = [k for k in range(len(text) + 1) if (k > 0 and gone[k - 1]) != (k < len(text) and gone[k])]
        found.append((i, len(text), turns[::2], turns[1::2], bytes(c for c, g in zip(text, gone) if not g)))
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def found_in(docs, length, **more):
    rows = suffix_dedup.remove_repeats(docs, length, **more).collect()
    made = [(r["doc_id"], r["n_bytes"], r["starts"], r["stops"], bytes(r["kept"])) for r in rows]
    return sorted(made, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


@pytest.mark.parametrize("length", [5, 20, 50])
def test_against_brute_force(spark, odd, odd_rows, length):
    rows = [(i, (t or "").encode()) for i, t, _ in odd_rows]
    if length < 20:
        rows = [(i, t) for i, t in rows if len(t) < 1000]
        odd = frame(spark, [(i, t, s) for i, t, s in odd_rows if len(t or "") < 1000])
    assert found_in(odd, length) == brute(rows, length)


def test_random_small_alphabet(spark):
    r = random.Random(9)
    rows = [(r.randint(0, 5000), "".join(r.choice("ab") for _ in range(r.randint(0, 60))), "s") for _ in range(80)]
    assert found_in(frame(spark, rows), 12) == brute([(i, t.encode()) for i, t, _ in rows], 12)


def test_segments_do_not_matter(monkeypatch):
    import pyarrow as pa

    texts = ["abcdefgh" * 40, "xyz" + "abcdefgh" * 20, "q" * 200]
    table = pa.table({"grp": [0] * 3, "doc_id": [1, 2, 3], "text": [t.encode() for t in texts]})
    whole = suffix_dedup.Texts.of(table).windows(50, 24)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    cut = suffix_dedup.Texts.of(table).windows(50, 24)
    spread = lambda w: {(int(s) + k, int(h)) for s, n, h in zip(*w) for k in range(int(n))}
    assert spread(whole) == spread(cut)


def test_empty(none):
    assert found_in(none, 50) == []


def test_query(spark, small):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, encode(coalesce(text, '')) FROM '{small}/documents.parquet'").fetchall()
    want = {i: (n, sum(b - a for a, b in zip(x, y)), len(x), hashlib.sha256(kept).hexdigest()) for i, n, x, y, kept in brute(rows, 50)}
    assert {r[0]: tuple(r)[1:] for r in op1_suffix_dedup(spark, small).collect()} == want


def test_shards_are_even():
    """Anchors are least hashes, which lie near zero; dealt as they are, one shard of 64 would get a third of the blocks."""
    import pyarrow as pa

    data = np.random.default_rng(4).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    hashes = suffix_dedup.Texts.of(pa.table({"grp": [0], "doc_id": [1], "text": [data]})).windows(50, 24)[2]
    counts = np.bincount(suffix_dedup._parts_of(np.unique(hashes), 64), minlength=64)
    assert counts.max() < 1.5 * counts.mean() and counts.min() > 0.5 * counts.mean()


def test_layout_follows_the_input():
    """A shard holds as many bytes whatever the session's partitions, and messages don't grow with the square of the input."""
    assert suffix_dedup.layout(0, 0, 48) == (48, suffix_dedup.GROUP_BITS)
    assert suffix_dedup.layout(250_000, 500 << 20, 200) == (200, suffix_dedup.GROUP_BITS)
    shards, bits = suffix_dedup.layout(3_000_000, 6 << 30, 48)
    assert shards == (6 << 30) // suffix_dedup.SHARD_BYTES and bits > suffix_dedup.GROUP_BITS
    assert suffix_dedup.layout(3_000, 6 << 30, 48)[1] == suffix_dedup.GROUP_BITS  # long texts don't get larger groups


def test_larger_groups_and_more_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "MESSAGES", 100)
    r = random.Random(3)
    rows = [(r.choice([None, *range(0, 20_000, 50)]), "".join(r.choice("ab") for _ in range(r.randint(0, 60))), "s") for _ in range(90)]
    size = sum(len(t) for _, t, _ in rows)
    assert suffix_dedup.layout(len(rows), size, 1)[0] > 20
    assert found_in(frame(spark, rows), 12) == brute([(i, t.encode()) for i, t, _ in rows], 12)
    monkeypatch.setattr(suffix_dedup, "MESSAGES", -1)
    assert suffix_dedup.layout(len(rows), size, 1)[1] == suffix_dedup.MOST_BITS
    assert found_in(frame(spark, rows), 12) == brute([(i, t.encode()) for i, t, _ in rows], 12)
