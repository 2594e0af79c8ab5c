"""The corpus queries, one per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm import byte_bpe, exact_dedup, fingerprints, licences, line_dedup, mixing, ranked_search, secrets, simhash_dedup, suffix_dedup, token_counts, toxicity, whitening
from staywise.llm.common import load
from staywise.session import stage

#: Tokenizer files are parameters; these are the ones the queries use.
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
COUNT_FILE = "byte_bpe_50k.tiktoken"

#: Target weights: the hot source is held at a tenth, five curated ones get double weight.
WEIGHTS = {f"src{k}": 0.1 if k == 0 else 0.08 if k <= 5 else 0.04 for k in range(20)}
EPOCHS = 1.0

#: Searches ask for every row whose id is divisible by this, against all rows.
QUERY_EVERY = 20


def mixed(docs: DataFrame) -> DataFrame:
    """Sources without a weight, and rows without a source, keep their share of the characters."""
    return mixing.mix(docs, WEIGHTS, EPOCHS, others=EPOCHS)


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    """Fitted on the labelled rows outside the held-out fifth."""
    labels = toxicity.labelled_rows(load(spark, folder, "labels")).where(~toxicity.held_out())
    return toxicity.fit(load(spark, folder), labels)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(load(spark, folder))
    removed = F.aggregate(F.arrays_zip("starts", "stops"), F.lit(0).cast("bigint"), lambda n, run: n + run["stops"] - run["starts"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(load(spark, folder), toxicity_model(spark, folder))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(load(spark, folder))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(COUNT_FILE)
    counted = token_counts.lengths(load(spark, folder), path, public_tokenizers.PATTERN)
    return token_counts.limits_table(token_counts.histogram(counted))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(load(spark, folder))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encoded and decoded again; the ids and bytes as digests."""
    path = public_tokenizers.path(BPE_FILE)
    coded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.groups(load(spark, folder))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.groups(load(spark, folder), wide=True)


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(load(spark, folder))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Beside the columns of the contract, ``n_near``: for every id divisible by 20, how many other fingerprints are within 3 bits."""
    found = stage(fingerprints.compare_edits(load(spark, folder)), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    counts = fingerprints.near_counts(found.where(asked), found)
    counted = found.where(asked).join(counts, "fp", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))
    both = counted.unionByName(found.where(~asked).withColumn("n_near", F.lit(None).cast("bigint")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.hex_digits(F.col("fp")).alias("fingerprint"),
        fingerprints.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(load(spark, folder))


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(load(spark, folder))
    base = [rule.kind for rule in secrets.BASE_RULES]
    return found.select(
        "doc_id",
        *[secrets.count_of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed().alias("spans"),
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(load(spark, folder, "embeddings"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(load(spark, folder), load(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}
