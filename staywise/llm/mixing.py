"""Mixing sources to target weights by Poisson replication.

A source with weight w and c of the corpus's C characters gets the mean
repetition rate  epochs * C * (w / sum of weights) / c.  Every document draws
its number of copies from the Poisson distribution with that mean, by
inverting the distribution at a number in [0, 1) hashed from seed, id and text.
The copies are dealt by a hash of seed, id, copy number and row and sorted by
it within each partition: a global shuffle without a sampling pass.

Weights are a parameter, so sizes and distributions of the named sources are
small by construction and become literals; no source is ever gathered.

Defined cases: a source without a weight, a null source among them unless None
is a key of the weights, has the rate ``others``, 0 unless it is given; where it
is above 0, C counts the sources with a weight only, as the others keep their
own characters.  Weights of sources without a character are left out of the
sum; a null text counts no characters but is copied like an empty one; a null
id draws as the word null.  Rows equal in id and text draw the same number of
copies each, rows that differ in either draw on their own, and all are dealt
row by row.  An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import free_name

#: Hex digits of the digest that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
SEED = 42


def rates(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    epochs: float = 1.0,
    source_column: str = "source",
    text_column: str = "text",
    others: float = 0.0,
) -> dict[str | None, float]:
    """Mean repetition rate of each named source: at most one number per weight."""
    source = F.col(f"`{source_column}`")
    sizes = docs.groupBy(source.alias("source")).agg(F.coalesce(F.sum(F.length(f"`{text_column}`")), F.lit(0)).alias("size"))
    named = [name for name in weights if name is not None]
    wanted = F.col("source").isin(named) if named else F.lit(False)
    if None in weights:
        wanted = wanted | F.col("source").isNull()
    # Only the sizes of named sources come to the driver.
    total = (sizes.where(F.coalesce(wanted, F.lit(False))) if others > 0 else sizes).agg(F.sum("size")).first()[0] or 0
    found = {row["source"]: row["size"] for row in sizes.where(wanted).collect() if row["size"]}
    whole = sum(weights[name] for name in found)
    if not whole:
        return {}
    return {name: epochs * total * (weights[name] / whole) / size for name, size in found.items() if weights[name] > 0}


def distribution(rate: float) -> tuple[int, list[float]]:
    """(k0, [P(N <= k0), P(N <= k0 + 1), ...]) as far as a 52-bit number can tell the sums from 0 and 1.

    Some fourteen deviations to both sides of the mean, whatever the mean.
    """
    reach = 60 + 14 * math.sqrt(rate)
    first = max(0, math.floor(rate - reach))
    upto, sums, k = 0.0, [], first
    while True:
        upto += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if upto >= 1 - 2.0**-52 or k > rate + reach:
            return first, sums
        sums.append(upto)
        k += 1


def uniform(id_column: str, text_column: str, seed: int) -> Column:
    """A number in [0, 1) hashed from the seed, an id and a text."""
    doc, words = (F.col(f"`{name}`").cast("string") for name in (id_column, text_column))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc, F.lit("null")), F.lit(":"), F.coalesce(words, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def copies(
    source_column: str, id_column: str, text_column: str, found: Mapping[str | None, float], seed: int, others: float = 0.0
) -> Column:
    """Number of copies of a row, by inverting its source's distribution."""
    source, at = F.col(f"`{source_column}`"), uniform(id_column, text_column, seed)

    def drawn(rate: float) -> Column:
        first, sums = distribution(rate)
        return F.lit(first) + F.size(F.filter(F.array(*[F.lit(x) for x in sums]).cast("array<double>"), lambda bound: bound <= at))

    number = drawn(others) if others > 0 else F.lit(0)
    for name, rate in found.items():
        number = F.when(source.isNull() if name is None else source == name, drawn(rate) if rate > 0 else F.lit(0)).otherwise(number)
    return number


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    epochs: float = 1.0,
    seed: int = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    copy_column: str = "copy",
    others: float = 0.0,
) -> DataFrame:
    """All columns of ``docs`` and the copy number from 1, globally shuffled.

    ``copy_column`` gets underscores appended where ``docs`` has that column already.
    """
    copy = free_name(docs, copy_column)
    found = rates(docs, weights, epochs, source_column, text_column, others)
    # A weight is kept at its own rate, 0 among them; only sources without one have the rate of the others.
    number = copies(source_column, id_column, text_column, {name: 0.0 for name in weights} | found, seed, others)
    # Rows without a copy are gone before the explode: sequence(1, 0) would count down.
    spread = docs.where(number > 0).select("*", F.explode(F.sequence(F.lit(1), number)).alias(copy))
    # The row's own number keeps equal rows, and the rows of a common id, from meeting in one partition.
    key, order = F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(copy), F.monotonically_increasing_id()), free_name(spread, "order")
    return spread.withColumn(order, key).repartition(F.col(order)).sortWithinPartitions(order).drop(order)
