"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents fall into
strata of equal m.  Within a stratum the impact of a term is a function of its
count tf: postings are kept by term and tf, and an impact is worked out once
per tf, not once per document.  The largest tf of a term in a stratum bounds
what any of its documents can get from the term; their sum bounds a query's
best score there.  Strata are visited in the order of that bound: the first
few give every query its k-th best score so far, and of the others only those
are visited whose bound reaches it.  Skipped strata cannot hold a result.

Spark does the dealing.  ``build`` writes the index to the shared folder: one
row per (stratum, block, term) with its documents by tf, a block being a part
of a stratum bounded in documents and terms.  ``search`` joins the query terms
to it, brings the postings of a block to one task, where they are added up
with numpy, and keeps the best of each block per query; ranks follow from
those.  Queries are met in slices of at most ``QUERIES``, so a task's sums are
bounded whatever the number of queries.

Defined cases: a null or empty text, or one without terms, is no document of
the index and no query; rows that repeat an id are documents of their own, null
ids come last among equal scores; query rows equal in id and text are one
query, others of one id are ranked each for itself; an empty table of either
kind gives no rows; a term of weight 0 adds nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staywise.llm.common import in_batches, texts_of
from staywise.session import fresh_path, stage

RESULTS = 10
#: Most documents of a block, and about the most words of its documents.
BLOCK_DOCS, BLOCK_TERMS = 8192, 1 << 20
#: Most queries whose sums a task holds at a time.
QUERIES = 512
#: Strata that every query visits before its others are held against the scores found.
FIRST_VISITS = 8

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TERMS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
_POSTINGS = pa.schema(
    [
        ("m", pa.int64()),
        ("block", pa.int64()),
        ("term", pa.string()),
        ("tfs", pa.list_(pa.int32())),
        ("members", pa.list_(pa.list_(pa.int32()))),
        ("ids", pa.list_(pa.int64())),
    ]
)
_POSTINGS_SQL = "m bigint, block bigint, term string, tfs array<int>, members array<array<int>>, ids array<bigint>"
_SCORES = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SCORES_SQL = "query bigint, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Index:
    """Where the postings lie, and the counts that weights and normalisers depend on."""

    path: str
    documents: int
    terms: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_POSTINGS_SQL).parquet(self.path)


def terms_of(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return data.translate(_KEPT).split()


def counted_terms(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("data")):
                    counts = Counter(terms_of(data.as_buffer().to_pybytes()))
                    yield doc, counts.total(), list(counts), list(counts.values())

        return in_batches(_TERMS, rows(), lambda row: 64 * len(row[2]))

    data = texts_of(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("data"))
    return data.mapInArrow(run, "doc_id bigint, n bigint, terms array<string>, tfs array<int>")


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _postings(key: tuple, docs: pa.Table) -> pa.Table:
    """Index rows of one block: its ids, and each term's documents by tf."""
    m, block = (k.as_py() for k in key)
    docs = docs.combine_chunks()
    lists = [docs.column(name).chunk(0) for name in ("terms", "tfs")]
    coded = lists[0].flatten().dictionary_encode()
    number = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(lists[0].offsets.to_numpy()))
    term, tf = coded.indices.to_numpy(), lists[1].flatten().to_numpy()
    order = np.lexsort((number, tf, term))
    number, term, tf = number[order], term[order], tf[order]
    new_term = np.append(True, term[1:] != term[:-1])
    levels = np.flatnonzero(new_term | np.append(True, tf[1:] != tf[:-1]))
    first = np.searchsorted(levels, np.flatnonzero(new_term))
    members = _lists(_lists(pa.array(number), levels), first)
    tfs = _lists(pa.array(tf[levels]), first)
    count = len(first)
    rows = pa.Table.from_arrays(
        [
            pa.array(np.full(count, m)),
            pa.array(np.full(count, block)),
            coded.dictionary.take(pa.array(term[levels[first]])),
            tfs,
            members,
            pa.nulls(count, pa.list_(pa.int64())),
        ],
        schema=_POSTINGS,
    )
    ids = pa.Table.from_pylist([{"m": m, "block": block, "ids": docs.column("doc_id").to_pylist()}], schema=_POSTINGS)
    return pa.concat_tables([ids, rows])


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_docs: int = BLOCK_DOCS) -> Index:
    """Index every row and whole text of ``docs``."""
    spark = docs.sparkSession
    # Numbered once and written, so a repeated task deals its rows as before.
    counted = stage(counted_terms(docs, id_column, text_column).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "terms")
    total = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    path = fresh_path(spark, "index")
    index = Index(path, total["documents"], total["terms"])
    by_m = counted.withColumn("m", normaliser(index) if index.terms else F.lit(0).cast("bigint"))
    wanted = F.greatest(F.count("*") / block_docs, F.count("*") * F.max("n") / BLOCK_TERMS)
    strata = stage(by_m.groupBy("m").agg(F.ceil(wanted).cast("bigint").alias("blocks")), "strata")
    dealt = by_m.join(strata, "m").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    dealt.select("m", "block", "doc_id", "terms", "tfs").groupBy("m", "block").applyInArrow(_postings, _POSTINGS_SQL).write.parquet(path)
    return index


def normaliser(index: Index) -> Column:
    """m of a document with ``n`` terms."""
    return F.expr(f"100L - 90L + (90L * n * {index.documents}L) div {index.terms}L")


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Staged (query, item_id, term), one row per distinct term; ``query`` is a number of its own for each id and text."""
    each = texts_of(queries, id_column, text_column).distinct()
    counted = counted_terms(each, "doc_id", "text").withColumn("query", F.monotonically_increasing_id())
    return stage(counted.select("query", F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")), "queries")


def _best(key: tuple, postings: pa.Table, visits: pa.Table, results: int) -> pa.Table:
    """The best documents of a block for each query that visits it."""
    m = key[0].as_py()
    if not len(postings) or not len(visits):
        return _SCORES.empty_table()
    visitors = visits.column("visitors")[0].as_py()
    ids = visits.column("ids")[0].values
    place = {visitor["query"]: k for k, visitor in enumerate(visitors)}
    sums = np.zeros((len(visitors), len(ids)), dtype=np.int64)
    impacts: dict[int, int] = {}
    for row in range(len(postings)):
        found = [(place[a["query"]], a["weight"]) for a in postings.column("askers")[row].as_py() if a["query"] in place]
        if not found:
            continue
        at, weights = (np.array(column, dtype=np.int64) for column in zip(*found))
        for tf, members in zip(postings.column("tfs")[row].as_py(), postings.column("members")[row].values):
            if tf not in impacts:
                impacts[tf] = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            # A document occurs once among the documents of a term.
            sums[np.ix_(at, members.values.to_numpy())] += (weights * impacts[tf])[:, None]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy()
    out: list[tuple] = []
    for visitor, scores in zip(visitors, sums):
        good = np.flatnonzero(scores >= visitor["least"])
        if len(good) > results:
            edge = np.partition(scores[good], -results)[-results]
            good = good[scores[good] >= edge]
            good = good[np.lexsort((numbers[good], ~known[good], -scores[good]))][:results]
        out += [(visitor["query"], int(numbers[k]) if known[k] else None, int(scores[k])) for k in good]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, _SCORES)], schema=_SCORES)


def _visit(held: DataFrame, blocks: DataFrame, visits: DataFrame, results: int) -> DataFrame:
    """(query, doc_id, score): the best of every block in the strata that ``visits`` (query, slice, m, least) names."""
    by_stratum = visits.groupBy("m", "slice").agg(F.collect_list(F.struct("query", "least")).alias("visitors"))
    right = blocks.join(by_stratum, "m").select("m", "block", "slice", "ids", "visitors")
    left = held.join(by_stratum.select("m", "slice"), ["m", "slice"], "left_semi")
    keys = ["m", "block", "slice"]

    def best(key: tuple, postings: pa.Table, found: pa.Table) -> pa.Table:
        return _best(key, postings, found, results)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, _SCORES_SQL)


def _ranked(scores: DataFrame, results: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= results)


def search(
    index: Index,
    queries: DataFrame,
    results: int = RESULTS,
    id_column: str = "item_id",
    text_column: str = "text",
    first_visits: int = FIRST_VISITS,
    most_queries: int = QUERIES,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``results`` best documents of every query, those that score above 0."""
    spark = queries.sparkSession
    asked = query_terms(queries, id_column, text_column)
    slices = -(-asked.agg(F.count_distinct("query")).first()[0] // most_queries) or 1
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)))
    blocks = index.read(spark).where("term IS NULL").select("m", "block", "ids")
    postings = index.read(spark).where("term IS NOT NULL").select("m", "block", "term", "tfs", "members")
    size = F.aggregate("members", F.lit(0), lambda total, found: total + F.size(found))
    listed = postings.join(asked.select("term").distinct(), "term", "left_semi")
    # Staged: how often each query term occurs, and its largest count, per stratum.
    strata = stage(listed.groupBy("term", "m").agg(F.sum(size).alias("docs"), F.max(F.element_at("tfs", -1)).alias("tf")), "term-strata")
    share = F.lit(2.0 * index.documents + 2) / (2 * F.sum("docs") + 1)
    weights = strata.groupBy("term").agg(F.floor(1000 * F.log(share)).cast("bigint").alias("weight")).where("weight > 0")
    weighed = stage(asked.join(weights, "term"), "weighed")
    most = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    bounds = weighed.join(strata, "term").groupBy("query", "slice", "m").agg(F.sum(most).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "m"))
    bounds = stage(bounds.withColumn("visit", place), "bounds")
    askers = weighed.groupBy("term", "slice").agg(F.collect_list(F.struct("query", "weight")).alias("askers"))
    held = postings.join(askers, "term")

    first = bounds.where(F.col("visit") <= first_visits).select("query", "slice", "m", F.lit(1).cast("bigint").alias("least"))
    found = stage(_ranked(_visit(held, blocks, first, results), results).drop("rank"), "first-visits")
    reached = found.groupBy("query").agg(F.when(F.count("*") >= results, F.min("score")).alias("reached"))
    rest = bounds.where(F.col("visit") > first_visits).join(reached, "query", "left")
    rest = rest.select("query", "slice", "m", "bound", F.coalesce("reached", F.lit(1)).cast("bigint").alias("least"))
    more = _visit(held, blocks, rest.where("bound >= least").drop("bound"), results)
    names = asked.select("query", "item_id").distinct()
    return _ranked(found.unionByName(more), results).join(names, "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, results: int = RESULTS) -> DataFrame:
    """Index ``docs`` and search it for every row of ``queries`` (item_id, text)."""
    return search(build(docs), queries, results)
