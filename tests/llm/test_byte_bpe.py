import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from staywise.llm import byte_bpe
from staywise.llm.queries import op5_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(alphabet="ab cdé  \n's1漢.,!\t", max_size=40) | st.text(max_size=20).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t))


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.tokenizer(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_encoding_and_round_trip(tokens, theirs, text):
    packed = tokens.encode(text)
    assert ids_of(packed) == theirs.encode_ordinary(text)
    assert tokens.decode(packed) == text.encode()


@settings(max_examples=150, deadline=None)
@given(text=TEXT, edits=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), TEXT), max_size=5), more=TEXT)
def test_edits_and_appends(tokens, theirs, text, edits, more):
    held = byte_bpe.EditableText(tokens, text)
    for start, size, new in edits:
        start = min(start, len(held.text))
        held.replace(start, min(len(held.text), start + size), new)
        assert held.ids() == theirs.encode_ordinary(held.text)
    held.append(more)
    assert held.ids() == theirs.encode_ordinary(held.text)


def test_an_edit_works_near_its_place_only(tokens):
    held = byte_bpe.EditableText(tokens, "some words stand here and " * 2000)
    before = held.filled
    held.replace(20_000, 20_003, "xyz")
    assert held.filled - before < 100
    before = held.filled
    held.append("more")
    assert held.filled - before < 20


def test_pairs_fit_as_plain_merging_says(tokens):
    r = np.random.default_rng(4)
    encoder = tokens.encoder
    ranks = list(encoder.parts)
    for left, right in zip(r.choice(ranks, 3000).tolist(), r.choice(ranks, 3000).tolist()):
        a, b = encoder.token[left], encoder.token[right]
        assert encoder.fits(left, right) == (encoder.merged(a + b) == [a, b])


def test_tokens_that_merging_cannot_reach():
    # "abc" has a rank but neither "ab" nor "bc" has one: only a whole piece can be it.
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"de": 257}
    encoder = byte_bpe.PrefixEncoder(ranks)
    assert encoder.encode(b"abc") == [256] and encoder.encode(b"abcde") == [97, 98, 99, 257]


def test_documents(odd, odd_rows, theirs):
    coded = byte_bpe.encode_documents(odd, PATH, P.PATTERN, decoded=True)
    assert sorted((r["doc_id"] is None, r["doc_id"], ids_of(r["ids"]), bytes(r["decoded"])) for r in coded.collect()) == sorted(
        (i is None, i, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in odd_rows
    )
    back = byte_bpe.decode_documents(coded, PATH, P.PATTERN)
    assert {(r["doc_id"], bytes(r["decoded"])) for r in back.collect()} == {(i, (t or "").encode()) for i, t, _ in odd_rows}


def test_empty(none):
    assert byte_bpe.encode_documents(none, PATH, P.PATTERN).count() == 0


def test_query(spark, small, theirs):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op5_byte_bpe(spark, small).collect():
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        packed = np.array(ids, dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
