"""Exact deduplication with an extendible-hash index kept in shared files.

Every text has a 64-bit key.  A directory maps key prefixes to buckets: it
starts at a depth at which an average bucket fits and doubles as long as some
bucket holds more distinct keys than ``capacity``; only overfull buckets are
split.  Equal keys can never be split and form a chain.  Contiguous buckets of
about equal weight make one owner task; it receives its key range in key
order, compares the bytes of texts whose keys collide and writes one entry per
distinct text.  Copies are combined before they are sent, so a group of any
size reaches its owner as one entry per sending task and flush.

The driver holds only depths and the first key of every owner's range.

Defined cases: a null text counts as empty; runs of blank, tab, line feed,
vertical tab, form feed and carriage return count as one blank; a null id
sorts after all others; rows repeating an id and text count towards
``group_size`` and are answered alike; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.common import SMALL_BATCH_BYTES, in_batches, keep_rows, partitions, row_key, rows_of, texts_of
from staywise.operators.ordering import running_totals
from staywise.session import fresh_path, stage

CAPACITY = 4096
#: Memory after which a task sends the distinct texts it holds, and what one takes beside its characters.
FLUSH_BYTES = 4 << 20
HELD_BYTES = 300
KEY_BITS = 64

_SENT = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("text", pa.string()), ("first_id", pa.int64()), ("n", pa.int64())])
_ENTRY = pa.schema([("key", pa.int64()), ("chain", pa.int32()), ("first_id", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Index:
    """Shared files of an index: rows seen, buckets of the directory, chain entries."""

    rows: str
    directory: str
    entries: str
    depth: int

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(getattr(self, part))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def hashed(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key taken as unsigned."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("bigint")


def directory_of(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets (depth, prefix, n_keys, n_rows) and the directory's depth.

    ``keys`` holds one row per distinct key with its number of rows ``n``.
    """
    total = keys.count()
    depth = max(0, (max(total, 1) - 1).bit_length() - (capacity.bit_length() - 1))
    open_keys, closed = keys, None
    while True:
        counted = (
            open_keys.groupBy(_prefix(F.col("key"), depth).alias("prefix"))
            .agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))
            .select(F.lit(depth).alias("depth"), "prefix", "n_keys", "n_rows")
        )
        counted = stage(counted, "buckets")
        fits = counted.where((F.col("n_keys") <= capacity) | (F.lit(depth) >= KEY_BITS))
        closed = fits if closed is None else closed.unionByName(fits)
        overfull = counted.where((F.col("n_keys") > capacity) & (F.lit(depth) < KEY_BITS)).select(F.col("prefix").alias("_full"))
        if overfull.isEmpty():
            return closed, depth
        open_keys = stage(open_keys.join(overfull, _prefix(F.col("key"), depth) == F.col("_full"), "left_semi"), "overfull")
        depth += 1


def owner_starts(directory: DataFrame, owners: int) -> list[int]:
    """First unsigned key of each owner's run of buckets; at most ``owners`` numbers."""
    # Shifting by 64 would shift by nothing, so a bucket of depth 0 starts at 0 explicitly.
    first = F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftleft(prefix, 64 - depth)"))
    ordered = directory.select(F.expr("n_rows + n_keys").alias("load"), F.xxhash64(first).alias("_tie"), first.alias("first_key"))
    # Signed order with the sign bit flipped is the unsigned order of the keys.
    ordered = ordered.withColumn("at", F.col("first_key").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))).drop("_tie")
    totals = running_totals(ordered, "at", ["load"])
    whole = directory.agg(F.sum(F.expr("n_rows + n_keys"))).first()[0] or 1
    owner = F.floor((F.col("upto_load") - F.col("load")) * F.lit(owners) / F.lit(whole))
    return sorted(row[0] + (1 << 63) for row in totals.groupBy(owner.alias("owner")).agg(F.min("at")).select("min(at)").collect())


def _combine(starts: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per distinct text seen since the last flush, dealt to the owner of its key."""
    bounds = np.array(starts, dtype=np.uint64)

    def flushed(held: dict[tuple[int, str], list[int]]) -> Iterator[tuple]:
        if held:
            keys = np.fromiter((k for k, _ in held), np.int64, len(held)).view(np.uint64)
            owners = np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0)
            for owner, ((key, text), (first, n)) in zip(owners.tolist(), held.items()):
                yield owner, key, text, first, n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[tuple[int, str], list[int]] = {}
        size = 0
        for doc, key, text in rows_of(batches, "doc_id", "key", "text"):
            doc = _LAST if doc is None else doc
            seen = held.get((key, text))
            if seen is None:
                held[key, text] = [doc, 1]
                size += sys.getsizeof(text) + HELD_BYTES
                if size > FLUSH_BYTES:
                    yield from flushed(held)
                    held, size = {}, 0
            else:
                seen[0] = min(seen[0], doc)
                seen[1] += 1
        yield from flushed(held)

    return lambda batches: in_batches(_SENT, rows(batches), lambda row: sys.getsizeof(row[2]), SMALL_BATCH_BYTES)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one key range: rows come in key order, so only one chain is held at a time."""

    def rows() -> Iterator[tuple]:
        at: int | None = None
        chain: dict[str, list[int]] = {}
        for key, text, first, n in rows_of(batches, "key", "text", "first_id", "n"):
            if key != at:
                yield from ((at, i, *found, kept) for i, (kept, found) in enumerate(chain.items()))
                at, chain = key, {}
            found = chain.get(text)  # compares the whole text, not its hash
            if found is None:
                chain[text] = [first, n]
            else:
                found[0] = min(found[0], first)
                found[1] += n
        yield from ((at, i, *found, kept) for i, (kept, found) in enumerate(chain.items()))

    return in_batches(_ENTRY, rows(), lambda row: sys.getsizeof(row[4]), SMALL_BATCH_BYTES)


def build(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    key_of: Callable[[Column], Column] = hashed,
) -> Index:
    """Write the index of ``docs`` to the shared folder."""
    spark = docs.sparkSession
    keyed = (
        texts_of(docs, id_column, text_column)
        .select("doc_id", normalised(F.col("text")).alias("text"))
        .withColumn("key", key_of(F.col("text")).cast("bigint"))
    )
    index = {part: fresh_path(spark, f"index-{part}") for part in ("rows", "directory", "entries")}
    keyed.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")).write.parquet(index["rows"])
    keys = stage(spark.read.parquet(index["rows"]).groupBy("key").agg(F.count("*").alias("n")), "keys")
    directory, depth = directory_of(keys, capacity)
    directory.write.parquet(index["directory"])
    owners = partitions(spark)
    starts = owner_starts(spark.read.parquet(index["directory"]), owners) or [0]
    (
        keyed.mapInArrow(_combine(starts), "owner int, key bigint, text string, first_id bigint, n bigint")
        .repartition(owners, "owner")
        .sortWithinPartitions("key")
        .mapInArrow(_own, "key bigint, chain int, first_id bigint, n bigint, text string")
        .write.parquet(index["entries"])
    )
    return Index(depth=depth, **index)


def resolve(spark: SparkSession, index: Index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every indexed row.

    Owners have compared bytes, so an entry stands for one text; rows find
    theirs by key and digest, which the check below has shown to be one to one.
    """
    rows = index.read(spark, "rows")
    entries = index.read(spark, "entries").select("key", "first_id", "n", F.sha2("text", 256).alias("text_sha256"))
    chained = entries.groupBy("key", "text_sha256").agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")
    )
    one = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts share key and digest"))).otherwise(F.col("first_id"))
    keep = F.when(one == F.lit(_LAST), None).otherwise(one)
    return rows.join(chained, ["key", "text_sha256"]).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Group, size and decision of every row of ``docs``."""
    return resolve(docs.sparkSession, build(docs, id_column, text_column, capacity))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, one per text, with all their columns.

    A row is known by its id and text, so rows that share an id, null among
    them, stay or go each by its own text.
    """
    kept = groups(docs, id_column, text_column).where("kept").select(row_key(F.col("text_sha256"), F.col("doc_id"))).distinct()
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return keep_rows(docs, row_key(F.sha2(normalised(text), 256), F.col(f"`{id_column}`")), kept)
