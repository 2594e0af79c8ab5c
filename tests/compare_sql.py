"""Run jobs and their SQL side by side: python tests/compare_sql.py FOLDER [job …]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from oracles import statements
from staywise.plans.catalog import jobs
from staywise.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
LONG_RUNNING = ("searched_", "trained_", "experiment_record", "forest_importance", "boosted_tree_attribution")


def source(folder: str, table: str) -> str:
    path = Path(f"{folder}/{table}.parquet")
    return f"{path}/*.parquet" if path.is_dir() else str(path)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if not Path(f"{folder}/{table}.parquet").exists():
            continue
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{source(folder, table)}')")
    return connection


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value) if value is not None else None


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda r: tuple((v is None, v or "") for v in r))


FAMILY = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
    "string": "text", "boolean": "bool", "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "float",
    "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool",
}


def difference(spark, connection, folder: str, name: str, sql: str) -> str | None:
    """None when both results agree in names, types, row count and every value."""
    found = jobs[name](spark, folder)
    rows = [tuple(row) for row in found.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    wanted_types = {d[0]: str(d[1]) for d in result.description}
    wanted = result.fetchall()
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} != {sorted(names)}"
    for column, kind in found.dtypes:
        if FAMILY.get(kind, kind) != FAMILY.get(wanted_types[column], wanted_types[column]):
            return f"type of {column}: {kind} != {wanted_types[column]}"
    left, right = table(found.columns, rows), table(names, wanted)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first {sorted(found.columns)}: {different[0]}"
    return None


def main() -> None:
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    failed = 0
    for name, sql in statements().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(spark, connection, folder, name, sql)
        except Exception as error:  # report every job, not just the first that fails
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += problem is not None
        print(f"{'DIFF' if problem else 'same'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} different")


if __name__ == "__main__":
    main()
