"""Licence scans by canonical digest.

A text is put into canonical form: lower case, copyright lines dropped,
punctuation and comment marks turned into blanks, equivalent spellings
unified, blanks collapsed.  The SHA-256 of the canonical form is looked up
among the digests of known licences by a hash join.  Two kinds of entire texts
are looked up: the whole document, and each of its lines as a notice; of a
copyright line each sentence is looked up.  A line that begins with "copyright
holder" and the like continues the line before it.

One scan makes all digests of a document; known digests are a small table by
nature, the planner joins them within the scan, and of the lines only those
that name a licence are shuffled.  Long licences are known by digest alone.

Defined cases: a null text is empty; an empty canonical form never matches; a
text of several licences' form gets the first name in order; rows sharing an
id, null among them, are one document for each different text; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.common import texts_of

# Notices by which documents name their licence.
NAMED = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, Version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Distributed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Distributed under the BSD 3-Clause License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
    "GPL-2.0": ["Licensed under the GNU General Public License, Version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, Version 3."],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, Version 2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, Version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0."],
    "Unlicense": ["Released into the public domain under the Unlicense."],
    "Zlib": ["Licensed under the zlib License."],
}
NOTICES = {name: [*texts, f"SPDX-License-Identifier: {name}"] for name, texts in NAMED.items()} | {"Proprietary": ["All rights reserved."]}

# Whole licence texts.
LICENCES = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe "
        "copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form "
        "of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS "
        "IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please "
        "refer to <https://unlicense.org/>"
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not "
        "be removed or altered from any source distribution."
    ],
}

# Clauses of the BSD licences.
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# What an ISC text has beyond a 0BSD one, after the grant.
ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies."
for count in (2, 3):
    # The clauses are numbered or have a mark that the canonical form drops.
    LICENCES[f"BSD-{count}-Clause"] = [
        "\n\n".join([BSD_GRANT, *[f"{number} {clause}" for number, clause in zip(numbers, BSD_CLAUSES[:count])], BSD_DISCLAIMER])
        for numbers in (("1.", "2.", "3."), ("*", "*", "*"))
    ]
LICENCES["ISC"] = [LICENCES["0BSD"][0].replace(" granted.", " granted" + ISC_CONDITION)]

# Headings over whole texts, beside none.
HEADINGS = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib License"],
}

# SHA-256 of the canonical form of licences too long to be kept as text.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"],
    "GFDL-1.3": ["a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"],
    "GPL-1.0": ["9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"],
    "GPL-3.0": ["093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329"],
    "LGPL-2.0": ["5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50"],
    "LGPL-2.1": ["6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}

#: Patterns understood alike by Spark and by the SQL the query is checked with.
LINE_END = r"[\r\x{2028}\x{0B}\x{0C}]"
WRAPPED = r"\n[^\p{L}\p{N}\n]*copyright (holder|owner|notice|law|licen[cs]e|interest|and related|statement|claim)"
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*"
SENTENCE_END = r"\.[ \t]+"
NOT_WORD = r"[^\p{L}\p{N}\n]{2,}|[^\p{L}\p{N}\n ]"  # single blanks, which are most, stay
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("https", "http"),
)


def lower_lines(text: Column) -> Column:
    """Lower case, line ends made one, lines that a word wrap broke before "copyright holder" joined again."""
    found = F.regexp_replace(F.concat(F.lower(text), F.lit("\n")), LINE_END, "\n")
    return F.regexp_replace(found, WRAPPED, " copyright $1")


def words_only(lines: Column) -> Column:
    """Words between single blanks in one spelling, lines kept apart."""
    found = F.regexp_replace(lines, NOT_WORD, " ")
    # A blank at either side of every word lets spellings match whole words only.
    found = F.concat(F.lit(" "), F.replace(found, F.lit("\n"), F.lit(" \n ")))
    for spelt, meant in SPELLINGS:
        found = F.replace(found, F.lit(f" {spelt} "), F.lit(f" {meant} "))
    return found


def canonical(lines: Column) -> Column:
    """Canonical form of :func:`lower_lines`, lines kept apart."""
    return words_only(F.regexp_replace(lines, COPYRIGHT_LINE, "$1"))


def statements(lines: Column) -> Column:
    """Canonical form of the sentences on copyright lines, one a line."""
    found = F.array_join(F.regexp_extract_all(lines, F.lit(COPYRIGHT_LINE), 0), "")
    return words_only(F.regexp_replace(found, SENTENCE_END, "\n"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]{2,}|\n", " "))


def headed(licences: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(licence, whole text) with and without its headings, and with all rights reserved beside the copyright line."""
    return [
        (name, "\n".join([*heading, *reserved, text]))
        for name, texts in licences.items()
        for text in texts
        for heading in ([], *[[found] for found in HEADINGS.get(name, [])])
        for reserved in ([], ["All rights reserved."])
    ]


def known(
    spark: SparkSession,
    licences: Mapping[str, Sequence[str]] = LICENCES,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    digests: Mapping[str, Sequence[str]] = DIGESTS,
) -> DataFrame:
    """(kind, digest, licence) of the known texts; kind is ``text`` or ``line``."""
    noted = [(name, text) for name, texts in notices.items() for text in texts]
    rows = [("text", name, text) for name, text in headed(licences) + noted] + [("line", name, text) for name, text in noted]
    texts = _table(spark, ("kind", "name", "text"), rows)
    made = texts.select("kind", F.sha2(_flat(canonical(lower_lines(F.col("text")))), 256).alias("digest"), "name")
    given = _table(spark, ("kind", "digest", "name"), [("text", digest, name) for name, found in digests.items() for digest in found])
    return made.unionByName(given).groupBy("kind", "digest").agg(F.min("name").alias("licence"))


def _table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple[str, ...]]) -> DataFrame:
    """Rows of text as literals, so that the planner knows how small they are."""
    listed = [F.struct(*[F.lit(value).cast("string").alias(name) for name, value in zip(names, row)]) for row in [*rows, [None] * len(names)]]
    return spark.range(1).select(F.inline(F.array(*listed))).where(F.col(names[0]).isNotNull())


def scan(
    docs: DataFrame,
    licences: Mapping[str, Sequence[str]] = LICENCES,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    digests: Mapping[str, Sequence[str]] = DIGESTS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, digest, licence, n_notices, notices).

    ``licence`` names the licence that the whole text is, ``notices`` the
    distinct licences named by its lines, in order and joined by blanks,
    ``n_notices`` how many lines name one.
    """
    lowered = texts_of(docs, id_column, text_column).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("text_digest"), lower_lines(F.col("text")).alias("lowered")
    )
    forms = lowered.select("doc_id", "text_digest", canonical(F.col("lowered")).alias("form"), statements(F.col("lowered")).alias("said"))
    # Within a line of a canonical form no two blanks follow each other.
    lines = F.filter(F.transform(F.split(F.concat("form", F.lit("\n"), "said"), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("kind"), F.sha2(_flat(F.col("form")), 256).alias("digest"))),
        F.transform(lines, lambda line: F.struct(F.lit("line").alias("kind"), F.sha2(line, 256).alias("digest"))),
    )
    looked_up = forms.select("doc_id", "text_digest", F.inline(units))
    matched = looked_up.join(known(docs.sparkSession, licences, notices, digests), ["kind", "digest"], "left")
    # Lines that name nothing go no further.
    matched = matched.where("kind = 'text' OR licence IS NOT NULL")
    whole, line = F.col("kind") == "text", F.col("kind") == "line"
    # Rows repeating an id and text have their units as often as they occur, so notices are counted per whole text.
    return (
        matched.groupBy("doc_id", "text_digest")
        .agg(
            F.min(F.when(whole, F.col("digest"))).alias("digest"),
            F.min(F.when(whole, F.col("licence"))).alias("licence"),
            F.expr("count(CASE WHEN kind = 'line' THEN licence END) DIV count(CASE WHEN kind = 'text' THEN digest END)").alias("n_notices"),
            # At most as many names as there are known licences.
            F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("licence")))), " ").alias("notices"),
        )
        .drop("text_digest")
    )
