"""Column expressions: guarded ratios, text-to-number, missing values, hashing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.functions.sql import one_of, quoted, text

# Accepted spellings of a 0/1 flag, after lower-casing and trimming.
FLAG_ALIASES = {
    "0": 0, "0.0": 0, "no": 0, "false": 0, "n": 0, "f": 0,
    "1": 1, "1.0": 1, "yes": 1, "true": 1, "y": 1, "t": 1,
}

PLAIN_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TOKEN = "^[+-]?(?i:inf|infinity)$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 where the denominator is 0 or nothing was summed."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return F.round(ratio(100.0 * numerator, denominator), digits)


def is_positive(target: str, label: str) -> Column:
    """1 for the positive label, 0 for any other value."""
    return F.coalesce((F.col(target) == label).cast("int"), F.lit(0))


def label_strict(target: str, positive: str, negative: str) -> Column:
    """1 / 0 for the two known labels and NULL for anything else."""
    return F.when(F.col(target) == positive, 1).when(F.col(target) == negative, 0)


def logistic(z: Column) -> Column:
    """Sigmoid that never exponentiates a large positive number."""
    shrunk = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + shrunk)).otherwise(shrunk / (1.0 + shrunk))


def missing_sql(name: str, kind: T.DataType) -> str:
    """NULL, NaN and blank text are all the same missing value."""
    column = quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"({column} IS NULL OR isnan({column}))"
    if isinstance(kind, T.StringType):
        return f"({column} IS NULL OR trim({column}) = '')"
    return f"({column} IS NULL)"


def number_sql(name: str, kind: T.DataType) -> str:
    """Text to double; anything but a plain decimal or an infinity token is missing."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"nullif(CAST({quoted(name)} AS DOUBLE), double('NaN'))"
    if not isinstance(kind, T.StringType):
        return f"CAST({quoted(name)} AS DOUBLE)"
    token = f"trim({quoted(name)})"
    return (
        f"CASE WHEN {token} RLIKE {text(PLAIN_NUMBER)} THEN try_cast({token} AS DOUBLE)"
        f" WHEN {token} RLIKE {text(INFINITY_TOKEN)}"
        f" THEN if({token} LIKE '-%', double('-Infinity'), double('Infinity')) END"
    )


def flag_sql(name: str, aliases: Mapping[str, int] = FLAG_ALIASES) -> str:
    """0/1 from a closed alias table, NULL when missing or unknown."""
    token = f"lower(trim(CAST({quoted(name)} AS STRING)))"
    zeros = [spelling for spelling, value in aliases.items() if value == 0]
    ones = [spelling for spelling, value in aliases.items() if value == 1]
    return f"CASE WHEN {one_of(token, zeros)} THEN 0 WHEN {one_of(token, ones)} THEN 1 END"


def is_missing(name: str, kind: T.DataType) -> Column:
    return F.expr(missing_sql(name, kind))


def to_number(name: str, kind: T.DataType) -> Column:
    return F.expr(number_sql(name, kind))


def flag_number(name: str, aliases: Mapping[str, int] = FLAG_ALIASES) -> Column:
    return F.expr(flag_sql(name, aliases))


def shuffled(name: str, seed: int, purpose: str = "") -> Column:
    """Digest of an identifier and a seed: sorting by it is a repeatable random order.

    Different seeds, and different purposes under one seed, give unrelated orders.
    """
    return F.md5(F.concat(F.col(name).cast("string"), F.lit(f":{seed}{purpose}")))
