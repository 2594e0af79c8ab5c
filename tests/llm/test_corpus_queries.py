"""The corpus queries against their SQL, and the pipeline against a brute-force version."""

import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as registry
import corpus_pipeline
from staywise.llm import byte_bpe, queries, sql, toxicity
from staywise.llm.common import load
from tests.compare_sql import connect, table
from tests.llm.test_mixing import drawn
from tests.llm.test_simhash_dedup import closed, slow_print


def test_registered():
    names = list(registry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in names
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(sql.statements()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    found = queries.QUERIES[name](spark, folder)
    result = connect(folder).execute(sql.statements()[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(names, result.fetchall())


def test_token_count_query(spark, small):
    rows = queries.op4_token_counts(spark, small).collect()
    assert sum(r["n_docs"] for r in rows) == load(spark, small).count()


def test_line_query_covers_every_line(spark, small):
    lines = sum(1 for r in load(spark, small).collect() for x in (r["text"] or "").split("\n") if re.search(r"\w", x))
    assert queries.op7_line_dedup(spark, small).count() == lines


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = load(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    # The classifier is taken as it is; everything after it is done again in plain Python.
    model = queries.toxicity_model(spark, folder)
    clean = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5}
    rows = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] in clean)
    seen, exact = set(), []
    for i, text, source in rows:
        form = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        if form not in seen:
            seen.add(form)
            exact.append((i, text, source))
    prints = {i: slow_print(text) for i, text, _ in exact}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = closed(links, ids)
    near = [row for row in exact if roots[row[0]] == row[0]]
    assert len(rows) < docs.count() and len(exact) < len(rows) and len(near) < len(exact)
    size = {}
    for _, text, source in near:
        size[source] = size.get(source, 0) + len(text)
    whole = sum(w for s, w in queries.WEIGHTS.items() if size.get(s))
    rate = {s: sum(size.values()) * w / whole / size[s] for s, w in queries.WEIGHTS.items() if size.get(s)}
    coding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(queries.BPE_FILE)), special_tokens={})
    want = []
    for i, text, source in near:
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, len(coding.encode_ordinary(text)), digest)] * drawn(rate.get(source, queries.EPOCHS), i, text)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted(want)
