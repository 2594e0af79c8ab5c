"""Literals and identifiers for SQL expression text.

Expressions with hundreds of terms (a scorecard, a contract) are written as one
SQL text: Catalyst parses it in one call, where the same tree built operator by
operator costs a round trip to the JVM per node.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        return f"double('{value}')"
    return f"({value!r}D)" if value < 0 else f"{value!r}D"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number(value)
    return text(str(value))


def struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{text(name)}, {value}" for name, value in fields.items()) + ")"


def array(items: Iterable[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def one_of(expression: str, values: Iterable[str]) -> str:
    return f"{expression} IN (" + ", ".join(text(value) for value in values) + ")"


def inside(source: str):
    """Column reference within a struct column."""
    return lambda name: f"{quoted(source)}.{quoted(name)}"
