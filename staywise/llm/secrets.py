"""Secret scans: all rules compiled into one automaton, one pass over the bytes of each whole text.

The three base rules are assignments of a password or key, access-key ids and
long hexadecimal runs; further rules know the shapes of some common tokens.
The automaton is compiled once by the driver (``automaton.compile_rules``) and
sent to the tasks as a transition array of some thousand states; scanning is a
narrow map, without a shuffle.  Positions are code points, ends exclusive.

Defined cases: a null or empty text has no spans; rows that repeat an id are
scanned and returned one by one, as are rows with a null id; only letters of
ASCII have two cases; a very long text is read in segments of fixed size, the
state carried across; spans of different rules may overlap, spans of one rule
never do; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.automaton import Rule, Scanner, compile_rules
from staywise.llm.common import in_batches, texts_of

_NAME = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", _NAME + "([A-Za-z0-9+/_.=-]+)", _NAME + "([A-Za-z0-9+/_.=-]{6,})", any_case=True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    # A shorter run is no part of a longer one, so it need not be found first.
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further shapes of tokens.  Each rule that is open-ended multiplies the states of the combined automaton.
MORE_RULES = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

_CONTINUATION = bytes(range(0x80, 0xC0))
_FOUND = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])


def spans_of(data: bytes, scanner: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start and then rule."""
    found = scanner.matches(data)
    if not found:
        return []
    # Code points up to every bound, counted along the text once.
    points, counted, at = {}, 0, 0
    for bound in sorted({b for start, _, end in found for b in (start, end)}):
        counted += len(data[at:bound].translate(None, _CONTINUATION))
        points[bound], at = counted, bound
    return [(points[start], rule, points[end]) for start, rule, end in found]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, stops) of every row: parallel arrays of its spans by start, then rule order."""
    scanner = compile_rules(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("data")):
                    spans = spans_of(data.as_buffer().to_pybytes(), scanner)
                    yield doc, [scanner.kinds[r] for _, r, _ in spans], [s for s, _, _ in spans], [e for _, _, e in spans]

        return in_batches(_FOUND, rows(), lambda row: 32 * len(row[1]))

    data = texts_of(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("data"))
    return data.mapInArrow(run, "doc_id bigint, kinds array<string>, starts array<bigint>, stops array<bigint>")


def listed(kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans of some kinds, or of all, comma-joined in their order."""
    spans = F.arrays_zip("kinds", "starts", "stops")
    if kinds is not None:
        spans = F.filter(spans, lambda span: span["kinds"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kinds"], span["starts"].cast("string"), span["stops"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("kinds", lambda found: found == kind)).cast("bigint")
