"""Near-duplicates by exact comparison of SimHash fingerprints in tiles.

A fingerprint bit is 1 if it is set in over half the 64-bit hashes of a text's
word shingles, repeats included.  Distinct fingerprints are put into tiles of
one population count each; two fingerprints that differ in at most r bits
differ by at most r in their population counts, so only such tile pairs are
made.  A pair of tiles is compared with exclusive-or and bit counts block by
block, and reports a spanning forest of its links rather than the links, so a
large group of close copies costs one row per member and tile pair.

A tile has at most ``TILE`` fingerprints; how many tiles a population count
has follows from its number of fingerprints (65 numbers held by the driver).

Defined cases: a null text is empty; a text without words has fingerprint zero
and is linked like any other; rows repeating an id are the same document and
get one component; a null id never names a component unless all its members
are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import in_batches, keep_rows, row_key, texts_of
from staywise.llm.components import components
from staywise.session import stage

WORDS = 4
SEED = 42
RADIUS = 4
TILE = 32_768
#: Rows and columns of the blocks in which two tiles are compared.
BLOCK_ROWS, BLOCK_COLUMNS = 32, 4096

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYED = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("fp", pa.int64())])


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    reach = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[reach - 1 :])]
    packed = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(packed), 1 << 16):
        votes += np.unpackbits(packed[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(packed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every whole text; ``fp`` is the fingerprint as a signed bigint.

    ``keyed`` adds the key of the row's id and text, ``row_key``.
    """
    schema = _KEYED if keyed else _PRINTS
    named = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *row, text in zip(*(batch.column(c).to_pylist() for c in named), batch.column("text")):
                    found = fingerprint(text.as_py(), words)
                    yield *row, found - (1 << 64) if found >> 63 else found

        return in_batches(schema, rows())

    texts = texts_of(docs, id_column, text_column)
    if keyed:
        texts = texts.withColumn("row_key", row_key(F.sha2("text", 256), F.col("doc_id")))
        return texts.mapInArrow(run, "doc_id bigint, row_key string, fp bigint")
    return texts.mapInArrow(run, "doc_id bigint, fp bigint")


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (two index arrays into left ++ right) that join what lies within ``radius``.

    With ``same`` both tiles are one and only its own fingerprints are compared.
    """
    values = left if same else np.concatenate([left, right])
    base = 0 if same else len(left)
    root = np.arange(len(values))
    for i in range(0, len(left), BLOCK_ROWS):
        rows = left[i : i + BLOCK_ROWS, None]
        for j in range(i if same else 0, len(right), BLOCK_COLUMNS):
            near = np.bitwise_count(rows ^ right[None, j : j + BLOCK_COLUMNS]) <= radius
            if not near.any():
                continue
            x, y = np.nonzero(near)
            x, y = x + i, y + j + base
            while True:
                open_ = root[x] != root[y]
                if not open_.any():
                    break
                x, y = x[open_], y[open_]
                low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                np.minimum.at(root, high, low)
                while True:
                    above = root[root]
                    if np.array_equal(above, root):
                        break
                    root = above
    child = np.flatnonzero(root != np.arange(len(values)))
    return child, root[child]


def _forest_rows(pairs: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of tile pairs; each row holds the packed fingerprints of two tiles."""
    for frame in pairs:
        for a, b, left, right in zip(frame["a"], frame["b"], frame["left"], frame["right"]):
            x, y = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
            child, root = forest(x, y, radius, a == b)
            values = x if a == b else np.concatenate([x, y])
            yield pd.DataFrame({"a": values[child].view(np.int64), "b": values[root].view(np.int64)})


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``radius``.

    ``classes`` has distinct fingerprints in column ``fp``.
    """
    ones = F.bit_count("fp")
    counts = {row["ones"]: row["n"] for row in classes.groupBy(ones.alias("ones")).agg(F.count("*").alias("n")).collect()}
    tiles = {p: -(-n // tile) for p, n in sorted(counts.items())}
    first, total = {}, 0
    for p, k in tiles.items():
        first[p], total = total, total + k
    if not total:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    place = F.element_at(F.create_map(*[F.lit(x) for p in tiles for x in (p, first[p])]), ones)
    width = F.element_at(F.create_map(*[F.lit(x) for p in tiles for x in (p, tiles[p])]), ones)
    dealt = classes.select("fp", (place + F.pmod(F.xxhash64("fp"), width).cast("int")).alias("tile"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": [key[0]], "ones": [(int(frame["fp"].iloc[0]) & (2**64 - 1)).bit_count()], "fps": [frame["fp"].to_numpy().astype("<i8").tobytes()]})

    packed = stage(dealt.groupBy("tile").applyInPandas(pack, "tile int, ones int, fps binary"), "tiles")
    # Tiles are numbered by population count, so the partners of a tile are a run of numbers.
    reach = {p: max(first[q] + tiles[q] - 1 for q in tiles if p <= q <= p + radius) for p in tiles}
    until = F.element_at(F.create_map(*[F.lit(x) for p in tiles for x in (p, reach[p])]), F.col("ones"))
    left = packed.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", until)).alias("b"), F.col("fps").alias("left"))
    right = packed.select(F.col("tile").alias("b"), F.col("fps").alias("right"))
    # One row per tile pair, dealt evenly: a pair is the unit of work and of repetition.
    pairs = left.join(right, "b").repartition(max(1, min(total * total, 8 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return pairs.mapInPandas(lambda frames: _forest_rows(frames, radius), "a bigint, b bigint")


def rooted(printed: DataFrame, least: Column, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, least, root): every distinct fingerprint, the aggregate ``least`` of its rows and the fingerprint that stands for its component."""
    classes = stage(printed.groupBy("fp").agg(least.alias("least")), "classes")
    roots = components(links(classes, radius, tile)).toDF("fp", "root")
    return classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    printed = stage(fingerprints(docs, id_column, text_column, words), "fingerprints")
    found = rooted(printed, F.min("doc_id"), radius, tile)
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(found.join(named, "root").select("fp", "component_id"), "components")
    return printed.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    A null id comes after all others; of texts that share the smallest id, the
    one with the smallest digest stays.
    """
    printed = stage(fingerprints(docs, id_column, text_column, words, keyed=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key"))
    kept = rooted(printed, first, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.row_key")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return keep_rows(docs, row_key(F.sha2(text, 256), F.col(f"`{id_column}`")), stage(kept, "kept"))
