from pathlib import Path

import pytest

from staywise.llm import licences
from tests.llm.conftest import frame


def found(docs, **tables):
    return {r["doc_id"]: r for r in licences.scan(docs, **tables).collect()}


def test_whole_texts_and_notices(spark):
    mit = licences.LICENCES["MIT"][0]
    shouted = "// Copyright (c) 2020 Somebody\n * " + mit.upper().replace("SUBLICENSE", "sub-licence").replace("\n", "\r\n * ").replace("NONINF", "non-inf")
    rows = [(1, mit, "s"), (2, shouted, "s"), (3, mit + " And more.", "s")]
    rows += [(4, "Prose\nreleased under the MIT licence\nAll Rights Reserved\n  # Released under the M.I.T. License", "s")]
    rows += [(5, "(c) me\nLicensed under CC BY-NC 4.0.", "s"), (6, None, "s"), (7, "Copyright only", "s"), (None, "All rights reserved.", "s")]
    got = found(frame(spark, rows))
    assert got[1]["licence"] == got[2]["licence"] == "MIT" and got[1]["digest"] == got[2]["digest"]
    assert got[3]["licence"] is None and got[3]["digest"] != got[1]["digest"]
    assert (got[4]["licence"], got[4]["n_notices"], got[4]["notices"]) == (None, 2, "MIT Proprietary")
    assert (got[5]["licence"], got[5]["notices"]) == ("CC-BY-NC-4.0", "CC-BY-NC-4.0")
    assert got[6]["digest"] == got[7]["digest"] and got[6]["licence"] is None and got[6]["n_notices"] == 0
    assert got[None]["licence"] == "Proprietary"


def test_own_tables_and_ties(spark):
    tables = {"licences": {"B": ["Same text"], "A": ["same, TEXT"]}, "notices": {}}
    got = found(frame(spark, [(1, "same text", "s"), (2, "same text\nsame text", "s"), (2, "other", "s")]), **tables)
    assert got[1]["licence"] == "A" and got[2]["licence"] is None and got[2]["n_notices"] == 0


def test_empty(none, odd, odd_rows):
    assert licences.scan(none).count() == 0
    assert licences.scan(odd).count() == len({i for i, _, _ in odd_rows})


def test_rows_of_shared_ids_are_documents_by_text(spark):
    mit = licences.LICENCES["MIT"][0]
    rows = [(None, mit, "s"), (None, "All rights reserved.\nOther", "s"), (None, None, "s"), (2, "Prose", "s"), (2, mit, "s")]
    rows += [(3, "Prose\nAll rights reserved.", "s")] * 2
    got = [(r["doc_id"], r["licence"], r["n_notices"], r["notices"]) for r in licences.scan(frame(spark, rows)).collect()]
    want = [(None, "MIT", 0, ""), (None, None, 1, "Proprietary"), (None, None, 0, ""), (2, None, 0, ""), (2, "MIT", 0, ""), (3, None, 1, "Proprietary")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sentences_beside_a_copyright_statement(spark):
    rows = [(1, "Copyright 2020 X. Released under the MIT License.", "s"), (2, "// (c) J. Doe. All rights reserved.\nProse", "s")]
    rows += [(3, "Copyright 2020 Licensed under the MIT License", "s"), (4, "# SPDX-License-Identifier: BSD-3-Clause\nx = 1", "s")]
    got = {i: (r["n_notices"], r["notices"]) for i, r in found(frame(spark, rows)).items()}
    assert got == {1: (1, "MIT"), 2: (1, "Proprietary"), 3: (0, ""), 4: (1, "BSD-3-Clause")}


def test_headings_wrapped_lines_and_marks(spark):
    mit, bsd = licences.LICENCES["MIT"][0], licences.LICENCES["BSD-3-Clause"][1]
    wrapped = "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + mit.replace(" OR COPYRIGHT HOLDERS", " OR\n COPYRIGHT HOLDERS")
    marked = "Copyright 2020, B\nAll rights reserved.\n\n" + bsd.replace("* ", "- ")
    got = found(frame(spark, [(1, wrapped, "s"), (2, marked, "s"), (3, licences.LICENCES["ISC"][0], "s"), (4, mit + " x", "s")]))
    assert [got[i]["licence"] for i in (1, 2, 3, 4)] == ["MIT", "BSD-3-Clause", "ISC", None]


def test_digests_of_long_texts(spark):
    """Against the texts that many systems keep, where there are any."""
    files = {"GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}
    texts = {name: Path("/usr/share/common-licenses", files.get(name, name)) for name in licences.DIGESTS}
    rows = [(k, path.read_text(), "s") for k, (_, path) in enumerate(texts.items()) if path.exists()]
    if not rows:
        pytest.skip("no licence texts here")
    got = found(frame(spark, rows))
    assert [got[k]["licence"] for k, _, _ in rows] == [name for name, path in texts.items() if path.exists()]


def test_plan_sends_only_lines_that_name_a_licence(odd):
    plan = licences.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1
