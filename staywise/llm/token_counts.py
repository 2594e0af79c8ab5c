"""Token counts from an exact histogram of encoded lengths.

Documents are reduced to (length, number of documents).  Sums from the top of
that histogram answer, for any context limit, how many documents are longer,
how many tokens there are in all and how many remain when each document is cut
at the limit; sums from the bottom give exact quantiles.  Lengths are ordered
with range slices, so the histogram need not fit one task.

Defined cases: a null text is empty and has length 0; rows repeating an id
count each; an empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.byte_bpe import read_ranks
from staywise.llm.common import in_batches, texts_of
from staywise.operators.ordering import running_totals
from staywise.session import stage

_LENGTHS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    yield doc, len(encode(text.as_py()))

        return in_batches(_LENGTHS, rows())

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def histogram(counted: DataFrame, name: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length."""
    return counted.groupBy(F.col(name).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits_table(counts: DataFrame) -> DataFrame:
    """Answers at every length that occurs; between two of them ``truncated_total`` is linear.

    (n_tokens, n_docs, docs_longer, docs_upto, total_tokens, tokens_upto,
    truncated_total, share_upto)
    """
    weighed = stage(counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    suffix = running_totals(weighed, "n_tokens", ["n_docs", "tokens"], descending=True, staged=True)
    whole = weighed.agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("total")).first()
    docs, total = whole["docs"] or 0, whole["total"] or 0
    longer = F.col("upto_n_docs") - F.col("n_docs")
    upto = F.lit(total) - F.col("upto_tokens") + F.col("tokens")
    return suffix.select(
        "n_tokens",
        "n_docs",
        longer.alias("docs_longer"),
        (F.lit(docs) - longer).alias("docs_upto"),
        F.lit(total).cast("bigint").alias("total_tokens"),
        upto.alias("tokens_upto"),
        (upto + F.col("n_tokens") * longer).alias("truncated_total"),
        ((F.lit(docs) - longer) / F.lit(max(docs, 1))).alias("share_upto"),
    )


def truncated_totals(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_longer, truncated_total) for stated context limits, in one pass over the histogram."""
    probes = F.array(*[F.lit(int(limit)).cast("bigint") for limit in limits])
    return (
        counts.select(F.explode(probes).alias("limit"), "n_tokens", "n_docs")
        .groupBy("limit")
        .agg(
            F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
            F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"),
        )
    )


def quantile_lengths(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents doesn't exceed."""
    probes = F.array(*[F.lit(float(share)) for share in shares])
    return (
        table.select(F.explode(probes).alias("share"), "n_tokens", "share_upto")
        .where("share_upto >= share")
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
