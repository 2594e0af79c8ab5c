"""Readers of subscriber files: CSV, JSON records, embedded CSV text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.functions.expressions import to_number
from staywise.operators.ordering import fit_medians


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, matched by name to a declared schema: no inference pass."""
    found = spark.read.options(header=True, escape='"').csv(path).columns
    typed = {field.name: field for field in schema.fields}
    ordered = T.StructType([typed.get(name, T.StructField(name, T.StringType())) for name in found])
    return spark.read.schema(ordered).options(header=True, escape='"').csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text, so that the contract does the typing; quoted values may hold line breaks."""
    return spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"').csv(path)


def with_number(df: DataFrame, name: str) -> DataFrame:
    """Replace a text column by its number; unreadable text becomes missing."""
    return df.withColumn(name, to_number(name, df.schema[name].dataType))


def fill_with_file_median(df: DataFrame, name: str) -> DataFrame:
    """Legacy training read: missing values take the median of the whole file."""
    middle = fit_medians(df, [name]).get(name)
    if middle is None:
        return df
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(float(middle))))


def load_subscribers(spark: SparkSession, path: str, schema: T.StructType, lifetime: str) -> DataFrame:
    return fill_with_file_median(with_number(read_csv(spark, path, schema), lifetime), lifetime)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def read_json_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One record per line, every declared column as text."""
    return spark.read.schema(text_schema(columns)).json(path)


# Line breaks inside quotes belong to a value; a quote without its partner stands for itself.
CSV_LINE = r'(?:[^"\n]++|"(?:[^"]++|"")*+"|")++'
CSV_CELL = r'((?:[^",]++|"(?:[^"]++|"")*+"|")*+),'


def csv_lines(content: Column) -> Column:
    """Lines of CSV text that hold anything, line breaks within quotes kept."""
    found = F.regexp_extract_all(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit(CSV_LINE), F.lit(0))
    return F.filter(found, lambda line: F.trim(line) != "")


def csv_cells(line: Column) -> Column:
    """Values of one line; an empty one is missing."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CSV_CELL), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(cell.rlike(r'(?s)^".*"$') & (F.length(cell) > 1), inner).otherwise(cell)

    return F.transform(cells, lambda cell: F.nullif(plain(cell), F.lit("")))


def csv_records(content: Column, columns: Sequence[str]) -> Column:
    """Array of records out of CSV text, columns matched by the names in its header."""
    lines = csv_lines(content)
    header = F.transform(csv_cells(F.get(lines, F.lit(0))), lambda name: F.trim(name))

    def record(line: Column) -> Column:
        cells = csv_cells(line)
        # A column the header doesn't name has position 0, before the first value.
        return F.struct(*[F.get(cells, F.array_position(header, name).cast("int") - 1).alias(name) for name in columns])

    known = F.exists(header, lambda name: name.isin(list(columns)))
    return F.when(known, F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), record))


def request_records(body: Column, columns: Sequence[str]) -> Column:
    """Array of records of one request body, null when it can't be read.

    A body is ``{"csv_content": "…"}``, ``{"records": […]}``, a bare list of
    records, or CSV text with a header.
    """
    record = text_schema(columns)
    envelope = T.StructType(
        [T.StructField("records", T.ArrayType(record)), T.StructField("csv_content", T.StringType())]
    )
    request = F.from_json(body, envelope)
    kind = F.substring(F.ltrim(body), 1, 1)
    listed = F.when(kind == "[", F.from_json(body, T.ArrayType(record))).otherwise(request["records"])
    text = F.when(kind == "{", request["csv_content"]).when(kind != "[", body)
    return F.coalesce(csv_records(text, columns), F.filter(listed, lambda found: found.isNotNull()))


def parse_requests(requests: DataFrame, body: str, columns: Sequence[str]) -> DataFrame:
    """Records out of request bodies, every column as text; each body is parsed once."""
    return requests.select(F.explode(request_records(F.col(body), columns)).alias("record")).select("record.*")


def refused_requests(requests: DataFrame, body: str, columns: Sequence[str]) -> DataFrame:
    """Requests that can't be read or hold no record, with the ``reason``."""
    found = requests.withColumn("_records", request_records(F.col(body), columns))
    reason = F.when(F.col("_records").isNull(), "unreadable").when(F.size("_records") == 0, "no records")
    return found.withColumn("reason", reason).where("reason IS NOT NULL").drop("_records")


def require_rows(df: DataFrame) -> DataFrame:
    """Refuse an empty batch, as the batch endpoint does."""
    if df.isEmpty():
        raise ValueError("no records provided")
    return df
