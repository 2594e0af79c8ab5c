import math
import random
import re
from collections import Counter

import duckdb
import pytest

from staywise.llm import ranked_search, sql
from staywise.llm.queries import op13_ranked_search
from tests.llm.conftest import frame, sentences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counted = [(d, Counter(words(t))) for d, t, _ in docs]
    counted = [(d, c) for d, c in counted if c]
    N, L = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in counted:
            m = 10 + 90 * c.total() * N // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=str)


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(odd_rows):
    r = random.Random(7)
    common = sentences(9, 200, 12)
    more = [(3000 + k, " ".join(r.choices(common, k=r.randint(1, 6))) + r.choice(["", " the THE thE", " İstanbul ǅ a1-b2_c3"]), "s") for k in range(400)]
    # Equal scores, documents that share an id, and a third of the rows under a null id.
    return odd_rows + more + [(3000, "the end", "s"), (3000, "other end", "s")] + [(None, f"{common[k % 50]} z{k % 3}", "s") for k in range(200)]


@pytest.fixture(scope="module")
def items(docs):
    picked = [(k, docs[k * 3][1]) for k in range(60) if docs[k * 3][1]]
    return picked + [(900, None), (901, ""), (902, "absent-entirely qqq"), (5, "the the THE end"), (5, "the the THE end"), (None, "other end"), (903, "İSTANBUL istanbul A1 b2_c3")]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, term string, m int")


def test_against_brute_force_and_sql(spark, docs, items, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("search"))
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    benchmark(spark, items).write.parquet(f"{folder}/benchmark.parquet")
    want = brute(docs, items)
    assert made(op13_ranked_search(spark, folder)) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(sql.ranked_search()).fetchall(), key=str) == want


def test_blocks_slices_and_visits_change_nothing(spark, docs, items):
    index = ranked_search.build(frame(spark, docs), block_docs=7)
    rows = index.read(spark)
    per_block = rows.where("ids IS NOT NULL").selectExpr("m", "size(ids) AS n").collect()
    assert len({r["m"] for r in per_block}) < len(per_block)
    assert sum(r["n"] for r in per_block) == index.documents
    want = brute(docs, items, 3)
    queries = benchmark(spark, items)
    assert made(ranked_search.search(index, queries, results=3, first_visits=1, most_queries=9)) == want
    assert made(ranked_search.search(index, queries, results=3, first_visits=100_000)) == want


def test_strata_below_the_bound_are_not_visited(spark, docs, items, monkeypatch):
    seen = []
    real = ranked_search._visit
    monkeypatch.setattr(ranked_search, "_visit", lambda h, b, visits, k: seen.append(visits.count()) or real(h, b, visits, k))
    index = ranked_search.build(frame(spark, docs))
    ranked_search.search(index, benchmark(spark, items), results=1, first_visits=2).collect()
    strata = index.read(spark).select("m").distinct().count()
    assert 0 < sum(seen) < strata * len(set(items)) / 2


def test_empty(spark, none, docs, items):
    assert made(ranked_search.rank_documents(none, benchmark(spark, items))) == []
    assert made(ranked_search.rank_documents(frame(spark, docs[:5]), benchmark(spark, []))) == []
