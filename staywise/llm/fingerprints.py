"""Document fingerprints: SimHash by weighted votes, and search within a Hamming radius.

Every word of a text is hashed to 64 bits; each occurrence votes for the bits
that are set and against those that aren't, so a term weighs as often as it
occurs.  A fingerprint bit is 1 where the votes for it win.  Votes are added
up two to a long, 32 bits each, in whole-stage generated code.

Search puts each fingerprint into tables keyed by all but r of its r + 1 ... b
blocks: with b blocks and radius r any two fingerprints within the radius
agree in at least b - r whole blocks, so one of the C(b, b - r) permuted keys
joins them.  Joined candidates are checked by their exact distance.

Defined cases: a null text is empty; a text without words has fingerprint
zero; words are runs between white space in lower case; a word count over
4 billion in one text would overflow its votes; a null id comes last, and rows
repeating an id follow each other by the hash of their texts, then the texts;
the next of an only row is the row itself; an empty table gives no rows.  Any
number of rows may lack an id or share one; rows equal in id and text lie in
one slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.llm.common import partitions, texts_of

BITS = 64
#: Slices of consecutive ids per shuffle partition.
SLICES_PER_PARTITION = 4
#: A text's hash is cut to 31 bits where it orders rows of one id.
HASH_SHIFT = 33


def words_of(text: Column) -> Column:
    """Words in lower case; a text without words has none."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda word: word != "")


def vote_sums(term_hash: Column, weight: Column | None = None) -> list[Column]:
    """32 sums; the k-th holds the votes for bit k and, 32 bits higher, for bit k + 32."""
    mask = F.lit(0x0000000100000001).cast("bigint")
    shifted = [F.shiftrightunsigned(term_hash, k).bitwiseAND(mask) for k in range(32)]
    return [F.sum(s if weight is None else s * weight).alias(f"votes_{k}") for k, s in enumerate(shifted)]


def majority(count: Column) -> Column:
    """The fingerprint: bits with more than half of ``count`` votes."""
    found = F.lit(0).cast("bigint")
    for k in range(32):
        votes = F.coalesce(F.col(f"votes_{k}"), F.lit(0))
        low = votes.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        high = F.shiftrightunsigned(votes, 32)
        found = found.bitwiseOR(F.when(2 * low > count, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
        bit = (1 << (k + 32)) if k < 31 else -(1 << 63)
        found = found.bitwiseOR(F.when(2 * high > count, F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
    return found


def fingerprints(texts: DataFrame, keys: Sequence[str], text_column: str = "text") -> DataFrame:
    """(keys…, fp): one fingerprint per row of ``texts``; ``keys`` must tell the rows apart."""
    terms = texts.select(*keys, F.explode_outer(words_of(F.col(text_column))).alias("word"))
    # A text without words keeps its row: the null word has no hash bits to vote with.
    hashed = terms.select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("h"))
    voted = hashed.groupBy(*keys).agg(F.count("h").alias("n"), *vote_sums(F.col("h")))
    return voted.select(*keys, majority(F.col("n")).alias("fp"))


def likeness(left: Column, right: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(left.bitwiseXOR(right)) / F.lit(float(BITS))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` blocks, as signed longs."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def block_keys(fp: Column, masks: Sequence[int]) -> Column:
    """Array of (table, key): the fingerprint with all but the chosen blocks blanked out."""
    return F.array(*[
        F.struct(F.lit(table).alias("table"), fp.bitwiseAND(F.lit(mask).cast("bigint")).alias("key")) for table, mask in enumerate(masks)
    ])


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query_fp, fp, distance) for all pairs of different fingerprints within ``radius``.

    Both sides have a column ``fp``; each is reduced to distinct fingerprints,
    so copies of a text cost nothing and are found by joining back on ``fp``.
    A pair that meets in several tables is taken from the first, so pairs need
    no shuffle of their own.
    """
    if not radius < blocks <= BITS:
        raise ValueError("needs more blocks than the radius")
    masks = block_masks(radius, blocks)
    left = queries.select(F.col("fp").alias("query_fp")).where("fp IS NOT NULL").distinct()
    right = prints.select("fp").where("fp IS NOT NULL").distinct()
    left = left.select("query_fp", F.inline(block_keys(F.col("query_fp"), masks)))
    right = right.select("fp", F.inline(block_keys(F.col("fp"), masks)))
    differing = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(mask).cast("bigint")) == 0, F.lit(table)) for table, mask in enumerate(masks)])
    distance = F.bit_count(differing)
    near = left.join(right, ["table", "key"]).where((F.col("query_fp") != F.col("fp")) & (distance <= radius) & (first == F.col("table")))
    return near.select("query_fp", "fp", distance.alias("distance"))


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_near): per distinct fingerprint of ``queries``, how many other fingerprints of ``prints`` lie within ``radius``."""
    found = within_radius(queries, prints, radius, blocks)
    return found.groupBy(F.col("query_fp").alias("fp")).agg(F.count("*").alias("n_near"))


def count_up_to(bounds: Sequence[int], value: Column, equal: bool) -> Column:
    """How many of the ascending ``bounds`` are below ``value`` (or equal to it); looks at two pieces of about their square root."""
    width = max(1, isqrt(len(bounds)))

    def listed(numbers: Sequence[int]) -> Column:
        # One literal, whatever its length.
        return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")

    def passed(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda bound: (bound <= value) if equal else (bound < value)))

    if not bounds:
        return F.lit(0)
    before = F.greatest(passed(listed(bounds[::width])) - 1, F.lit(0)) * width
    return before + passed(F.slice(listed(bounds), before + 1, width))


def slice_bounds(rows: DataFrame, slices: int) -> list[int]:
    """Ids that part the rows into about ``slices`` equal slices, by one mergeable sketch; at most ``slices`` numbers."""
    steps = [k / slices for k in range(1, slices)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", steps, max(10_000, 4 * slices)).alias("bounds")).first()
    return list(found["bounds"] or [])


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(slice, row, guest, doc_id, text, next_text): every text with the text of the next id, the first's after the last.

    Rows are dealt to slices that follow the order of (id, hash of the text,
    text): bounds from a sketch of the ids give slices of about equal size
    however the ids lie, and rows of one id, or of none, are spread over slices
    by their hash once they fill more than one.  A slice also gets, as its
    guest, the first row of the next slice that has rows.  So each text is
    shuffled once and one slice is the most a task looks back over.  Guests
    come last in their slice and have no next text.
    """
    rows = texts_of(docs, id_column, text_column).withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), HASH_SHIFT))
    slices = SLICES_PER_PARTITION * partitions(docs.sparkSession)
    bounds = slice_bounds(rows, slices)
    low = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(count_up_to(bounds, F.col("doc_id"), equal=False))
    high = F.when(F.col("doc_id").isNull(), len(bounds) + slices).otherwise(count_up_to(bounds, F.col("doc_id"), equal=True))
    # In the order of the hashes, so that slices keep the order of rows.
    within = F.shiftright(F.col("hash") * (high - low + 1), BITS - HASH_SHIFT)
    rows = rows.withColumn("slice", (low + within).cast("int"))
    heads = rows.groupBy("slice").agg(F.min(F.struct("doc_id", "hash")).alias("head"))
    # These two windows see one row per slice, and the number of slices is set, not grown with the rows.
    following, whole = Window.orderBy("slice"), Window.partitionBy(F.lit(0))
    first = F.min(F.struct("slice", "head")).over(whole)["head"]
    guests = heads.select("slice", F.coalesce(F.lead("head").over(following), first).alias("head"))
    guests = guests.select(F.col("slice").alias("host"), F.col("head.doc_id").alias("head_id"), F.col("head.hash").alias("head_hash"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    guest_rows = (
        rows.join(guests, is_head)
        .groupBy("host")
        .agg(F.min("text").alias("text"))
        .select(F.col("host").alias("slice"), F.lit(True).alias("guest"), F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("bigint").alias("hash"))
    )
    both = rows.select("slice", F.lit(False).alias("guest"), "doc_id", "text", "hash").unionByName(guest_rows)
    along = Window.partitionBy("slice").orderBy("guest", F.col("doc_id").asc_nulls_last(), "hash", "text")
    made = both.withColumn("next_text", F.lead("text").over(along)).withColumn("row", F.row_number().over(along))
    return made.select("slice", "row", "guest", "doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), one row per row of ``docs``.

    The vote sums, the pairing of a text with its edited form and the look at
    the next row all keep the slices' partitioning: no further shuffle.
    """
    changed = F.when(~F.col("guest"), edited(F.col("text"), F.col("next_text")))
    made = with_next(docs, id_column, text_column).withColumn("edited", changed)
    attributes = ["slice", "row", "guest", "doc_id", "n_chars", "digest"]
    made = made.select(
        "slice",
        "row",
        "guest",
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("digest"),
        "text",
        "edited",
    )
    version = F.array(
        F.struct(F.lit(False).alias("changed"), F.col("text").alias("version")),
        F.struct(F.lit(True).alias("changed"), F.col("edited").alias("version")),
    )
    prints = fingerprints(made.select(*attributes, F.inline(version)), [*attributes, "changed"], "version")
    # The unchanged row of a text comes right before its changed one.
    along = Window.partitionBy("slice").orderBy("row", "changed")
    return (
        prints.withColumn("edited_fp", F.lead("fp", 1).over(along))
        .withColumn("next_fp", F.lead("fp", 2).over(along))
        .where("NOT changed AND NOT guest")
        .select("doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")
    )
