import pyarrow as pa
from pyspark.sql import functions as F

from staywise.llm import exact_dedup, simhash_dedup
from staywise.llm.common import ROWS_AT_ONCE, in_batches, keep_rows, rows_of
from tests.llm.conftest import sentences


def test_keep_rows_leaves_clashing_columns(spark):
    rows = [(1, "a", "mine", "x"), (1, "a", "mine", "x"), (2, "b", "yours", "y"), (None, "c", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string, _row_key string")
    kept = keep_rows(docs, F.col("text"), docs.where("text <> 'b'").select("text").distinct())
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_dedup_stages_leave_clashing_columns(spark):
    texts = sentences(1, 6)
    rows = [(k, t, f"mine {k}", f"own {k}") for k, t in enumerate(texts + texts[:2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string, _row_key string")
    for module in (exact_dedup, simhash_dedup):
        assert sorted(map(tuple, module.deduplicate(docs).collect())) == rows[:6]


def test_batches_are_read_in_parts_and_written_by_bytes():
    schema = pa.schema([("n", pa.int64()), ("text", pa.string())])
    batches = [pa.record_batch({"n": range(k), "text": ["x" * 100] * k}, schema=schema) for k in (0, 1, 2 * ROWS_AT_ONCE + 3)]
    rows = list(rows_of(batches, "text", "n"))
    assert rows == [("x" * 100, n) for k in (1, 2 * ROWS_AT_ONCE + 3) for n in range(k)]
    parts = list(in_batches(schema, ((n, text) for text, n in rows), lambda row: len(row[1]), 1000))
    assert {len(part) for part in parts[:-1]} == {10} and sum(map(len, parts)) == len(rows)
