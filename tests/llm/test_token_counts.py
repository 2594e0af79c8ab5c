import public_tokenizers as P
import pytest
import tiktoken

from staywise.llm import token_counts
from staywise.llm.byte_bpe import read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lengths(odd_rows):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    return [len(encoding.encode_ordinary(t or "")) for _, t, _ in odd_rows]


@pytest.fixture(scope="module")
def counts(odd):
    return token_counts.histogram(token_counts.lengths(odd, PATH, P.PATTERN))


def test_table(counts, lengths):
    rows = token_counts.limits_table(counts).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        at = r["n_tokens"]
        assert r["n_docs"] == lengths.count(at)
        assert r["docs_longer"] == sum(n > at for n in lengths) and r["docs_upto"] == sum(n <= at for n in lengths)
        assert r["total_tokens"] == sum(lengths) and r["tokens_upto"] == sum(n for n in lengths if n <= at)
        assert r["truncated_total"] == sum(min(n, at) for n in lengths)
        assert r["share_upto"] == pytest.approx(r["docs_upto"] / len(lengths))


def test_any_limit_and_quantile(counts, lengths):
    for r in token_counts.truncated_totals(counts, [0, 1, 17, 1000, 10**6]).collect():
        assert r["truncated_total"] == sum(min(n, r["limit"]) for n in lengths)
        assert r["docs_longer"] == sum(n > r["limit"] for n in lengths)
    ordered = sorted(lengths)
    for r in token_counts.quantile_lengths(token_counts.limits_table(counts), [0.1, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == next(n for n in ordered if sum(m <= n for m in lengths) >= r["share"] * len(lengths))


def test_empty(none):
    counted = token_counts.histogram(token_counts.lengths(none, PATH, P.PATTERN))
    assert token_counts.limits_table(counted).count() == 0
