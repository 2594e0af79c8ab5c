"""Input contract: normalise, impute and check records, then fail or quarantine.

Checking is one narrow projection that adds a ``violations`` array to every
row.  Nothing in it looks at other rows, so a record is judged the same alone
or in a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.functions.expressions import flag_number, flag_sql, is_missing, missing_sql, number_sql, to_number
from staywise.functions.sql import array, one_of, quoted, struct, text
from staywise.roles import ContractSpec
from staywise.session import fresh_path

ACCEPTED, REFUSED = "accepted", "refused"
NO_RECORDS = "no records provided"
MISSING = "missing"
UNKNOWN = "unknown_value"
INFINITE = "infinite"


class ContractViolation(ValueError):
    """A batch broke the contract; ``report`` holds every finding as a DataFrame."""

    def __init__(self, message: str, report: DataFrame | None = None):
        super().__init__(message)
        self.report = report


def require_columns(columns: Sequence[str], spec: ContractSpec) -> None:
    """Plan-time check: needs no job."""
    absent = [name for name in spec.required if name not in columns]
    if absent:
        raise ContractViolation(f"missing required columns: {', '.join(absent)}")


def required_report(df: DataFrame, spec: ContractSpec) -> DataFrame:
    """One row per required column: whether the upload has it, and in how many records it is missing (NULL if absent)."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(name in df.columns).alias("present"),
            (F.count_if(is_missing(name, df.schema[name].dataType)) if name in df.columns else F.lit(None).cast("bigint")).alias("missing"),
        )
        for name in spec.required
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _finding(test: str, feature: str, rule: str) -> str:
    row = {"feature": text(feature), "rule": text(rule), "value": f"CAST({quoted(feature)} AS STRING)"}
    return f"CASE WHEN {test} THEN {struct(row)} END"


def clean_columns(schema: T.StructType, spec: ContractSpec) -> dict[str, Column]:
    """The value each required column takes once accepted."""
    cleaned: dict[str, Column] = {}
    for name in spec.required:
        if name in spec.flags:
            cleaned[name] = flag_number(name, spec.aliases)
        elif name in spec.numerics:
            value = to_number(name, schema[name].dataType)
            stored = spec.imputed.get(name)
            cleaned[name] = value if stored is None else F.coalesce(value, F.lit(float(stored)))
        else:
            cleaned[name] = F.col(name)
    return cleaned


def violation_array(schema: T.StructType, spec: ContractSpec) -> Column:
    """array<struct<feature, rule, value>> of every rule the record breaks."""
    found: list[str] = []
    for name in spec.flags:
        missing = missing_sql(name, schema[name].dataType)
        found.append(_finding(missing, name, MISSING))
        found.append(_finding(f"NOT {missing} AND ({flag_sql(name, spec.aliases)}) IS NULL", name, UNKNOWN))
    for name in spec.numerics:
        value = number_sql(name, schema[name].dataType)
        if name not in spec.imputed:
            found.append(_finding(f"({value}) IS NULL", name, MISSING))
        found.append(_finding(f"abs({value}) = double('Infinity')", name, INFINITE))
    for name, levels in spec.domains.items():
        found.append(_finding(f"{quoted(name)} IS NULL", name, MISSING))
        found.append(_finding(f"NOT {one_of(quoted(name), levels)}", name, UNKNOWN))
    return F.expr(f"array_compact({array(found)})")


def conforms_sql(schema: T.StructType, spec: ContractSpec) -> str:
    """True exactly when :func:`violation_array` would be empty, without building it."""
    tests = [f"({flag_sql(name, spec.aliases)}) IS NOT NULL" for name in spec.flags]
    for name in spec.numerics:
        finite = f"abs({number_sql(name, schema[name].dataType)}) < double('Infinity')"
        tests.append(f"coalesce({finite}, {'true' if name in spec.imputed else 'false'})")
    tests += [f"coalesce({one_of(quoted(name), levels)}, false)" for name, levels in spec.domains.items()]
    return " AND ".join(tests)


def accepted(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Conforming records: carried columns, then the cleaned required columns in contract order."""
    require_columns(df.columns, spec)
    cleaned = clean_columns(df.schema, spec)
    return df.where(conforms_sql(df.schema, spec)).select(
        *carry, *[cleaned[name].alias(name) for name in spec.required]
    )


def rejected(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Refused records as they arrived, with the reasons."""
    require_columns(df.columns, spec)
    broken = df.where(f"NOT ({conforms_sql(df.schema, spec)})")
    return broken.select(*carry, *spec.required, violation_array(df.schema, spec).alias("violations"))


def findings(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule."""
    require_columns(df.columns, spec)
    return df.select(*carry, F.inline(violation_array(df.schema, spec)))


def violation_report(df: DataFrame, spec: ContractSpec) -> DataFrame:
    return findings(df, spec).groupBy("feature", "rule").agg(F.count("*").alias("records"))


def bad_value_report(df: DataFrame, spec: ContractSpec) -> DataFrame:
    """Every distinct refused value with its count, next to the accepted levels.

    Values stay one per row: collecting them into an array would put all
    misspellings of a column into a single task.
    """
    allowed = F.lit(None).cast("string")
    for name, levels in spec.domains.items():
        allowed = F.when(F.col("feature") == name, F.lit(", ".join(sorted(levels)))).otherwise(allowed)
    return (
        findings(df, spec)
        .where((F.col("rule") == UNKNOWN) & F.col("feature").isin(list(spec.domains)))
        .groupBy("feature", "value")
        .agg(F.count("*").alias("records"))
        .withColumn("allowed", allowed)
    )


def infinity_report(df: DataFrame, spec: ContractSpec) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(F.abs(to_number(name, df.schema[name].dataType)) == float("inf")).alias("infinite"),
            )
            for name in spec.numerics
        ]
    )
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


@dataclass(frozen=True)
class Guarded:
    """A batch judged in the pass that wrote it; both parts are read from what was written."""

    accepted: DataFrame
    refused: DataFrame
    #: Records of either verdict, and records by broken (feature, rule); bounded by the contract.
    records: dict[str, int]
    broken: dict[tuple[str, str], int]

    @property
    def refusal(self) -> str | None:
        """Why strict mode would not take the batch."""
        if not sum(self.records.values()):
            return NO_RECORDS
        lines = [f"{feature}: {rule} in {n} record(s)" for (feature, rule), n in sorted(self.broken.items())]
        return "; ".join(lines) + "; every value is in the report" if lines else None


def judged(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Every record once, by a narrow projection: its verdict, what is taken if accepted, as it arrived with the reasons if refused."""
    require_columns(df.columns, spec)
    cleaned = clean_columns(df.schema, spec)
    reasons = violation_array(df.schema, spec).alias("violations")
    rows = df.select(
        F.struct(*carry, *[cleaned[name].alias(name) for name in spec.required]).alias("taken"),
        F.struct(*carry, *spec.required, reasons).alias("record"),
    )
    refused = F.size("record.violations") > 0
    return rows.select(
        F.when(refused, REFUSED).otherwise(ACCEPTED).alias("verdict"),
        F.when(~refused, F.col("taken")).alias("taken"),
        F.when(refused, F.col("record")).alias("record"),
    )


def guard(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = (), path: str | None = None) -> Guarded:
    """Judge, write and count a batch with one scan of it: a folder per verdict under ``path``.

    Strict, quarantine and empty-batch handling all read the outcome; the batch
    itself is not looked at again.
    """
    rows = judged(df, spec, carry)
    path = path or fresh_path(df.sparkSession, "guarded")
    rows.write.partitionBy("verdict").parquet(path)
    written = df.sparkSession.read.schema(rows.schema).parquet(path)
    reasons = written.select("verdict", F.posexplode_outer("record.violations").alias("place", "found"))
    counted = reasons.groupBy("verdict", "found.feature", "found.rule").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("records")
    )
    records, broken = {ACCEPTED: 0, REFUSED: 0}, {}
    for row in counted.collect():
        records[row["verdict"]] += row["records"]
        if row["feature"] is not None:
            broken[row["feature"], row["rule"]] = row["n"]
    # The verdict is a folder name, so either part opens only its own files.
    return Guarded(
        written.where(F.col("verdict") == ACCEPTED).select("taken.*"),
        written.where(F.col("verdict") == REFUSED).select("record.*"),
        records,
        broken,
    )


def strict(df: DataFrame, spec: ContractSpec, carry: Sequence[str] = ()) -> DataFrame:
    """The cleaned batch, or :class:`ContractViolation` when any record breaks a rule or there is none.

    The message counts every broken (feature, rule), which the contract bounds;
    the refused values themselves are rows of ``report``, all of them.
    """
    guarded = guard(df, spec, carry)
    if guarded.refusal:
        raise ContractViolation(guarded.refusal, guarded.refused.select(*carry, F.inline("violations")))
    return guarded.accepted


def describe_contract(spec: ContractSpec, df: DataFrame) -> DataFrame:
    """One row per required column: role, policy, accepted levels and how the data fares against it."""
    rows = []
    for name in spec.required:
        kind = df.schema[name].dataType
        if name in spec.flags:
            role, policy, levels = "flag", "reject", "0, 1"
            fits = flag_number(name, spec.aliases).isNotNull()
        elif name in spec.numerics:
            role = "numeric"
            policy = "impute" if name in spec.imputed else "reject"
            levels = "finite number"
            fits = F.abs(to_number(name, kind)) < float("inf")
        else:
            role, policy, levels = "category", "reject", ", ".join(spec.domains[name])
            fits = F.col(name).isin(list(spec.domains[name]))
        rows.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(role).alias("role"),
                F.lit(policy).alias("missing_policy"),
                F.lit(levels).alias("accepted"),
                F.count_if(is_missing(name, kind)).alias("missing"),
                F.count_if(F.coalesce(fits, F.lit(False))).alias("conforming"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(is_missing(name, df.schema[name].dataType)).alias("missing"),
            )
            for name in columns
        ]
    )
    return df.agg(cells.alias("cells")).select(F.inline("cells"))


def lifetime_proxy(revenue: str, tenure: str) -> Column:
    """Lifetime spend approximated from the monthly bill; at least one month counts."""
    return F.col(revenue) * F.greatest(F.lit(1), F.col(tenure).cast("int"))
