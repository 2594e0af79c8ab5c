"""What the corpus operators share: reading two columns, Arrow batches, keeping rows by id and text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes after which a task hands a batch of results back to Spark.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20
#: Bytes a batch of operators that hold much else beside it.
SMALL_BATCH_BYTES = 1 << 20
#: Rows of a batch that are made Python objects at a time.
ROWS_AT_ONCE = 512


def load(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) only, so that no other column can clash; a null text is empty."""
    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(digest: Column, doc_id: Column) -> Column:
    """Name of the rows of one id and one text; a null id adds nothing to the digest, so it differs from any other."""
    return F.concat_ws(":", digest, doc_id.cast("bigint").cast("string"))


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each key in ``kept`` (one column, unique), all columns unchanged.

    Rows of one key are combined before they are sent, so that a common one
    reaches its task as one row per sending task; the join needs no shuffle of
    its own, as the rows lie by key.
    """
    name = free_name(docs, "row_key")
    single = docs.withColumn(name, key).dropDuplicates([name])
    return single.join(kept.toDF(name), name, "left_semi").select(*[F.col(f"`{column}`") for column in docs.columns])


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of ``batches``, of which only a few at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield from zip(*(part.column(name).to_pylist() for name in columns))


def in_batches(
    schema: pa.Schema, rows: Iterable[tuple], weight: Callable[[tuple], int] = lambda row: 0, most: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Gather result rows into record batches of bounded rows and bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= most:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
