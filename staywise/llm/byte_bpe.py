"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string and the encodings of its prefixes are linked:
for every prefix there is exactly one token that can end it, namely the one
that fits behind the last token of the prefix before it.  A token fits behind
another when merging their joined bytes gives just these two back.  Storing
that last token per prefix gives the encoding by walking back from the end,
makes appending exact (only new prefixes are filled in) and confines the work
after an edit to what follows it within the same piece.

Text is cut into pieces by the tokenizer's pattern first and each piece is
encoded on its own; a piece that is itself a token is that token.

Defined cases: a null text is empty and gives no ids; any length works, cost
is linear in bytes times the longest token; ids outside the table are refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from staywise.llm.common import in_batches, texts_of

#: Distinct pieces, and pairs of tokens, that a worker remembers before it starts afresh: some 80 MB.
REMEMBERED = 250_000

#: Characters of text whose pieces a worker looks up together.
TOGETHER = 2 << 20

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Last valid token of every prefix of one piece.

    Tokens are handled by rank.  ``parts`` holds the two tokens that the last
    merge of a token joins, or None for a single byte; a token that merging
    can't reach has none and never occurs inside a piece.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.token = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        for token, rank in ranks.items():
            two = self.merged(token, 2)
            if len(token) == 1 or len(two) == 2:
                self.parts[rank] = (ranks[two[0]], ranks[two[1]]) if len(token) > 1 else None
        #: Tokens that merging their own bytes gives back; no other can occur inside a piece.
        self.whole = {token: rank for token, rank in ranks.items() if rank in self.parts}

    def merged(self, data: bytes, stop_at: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost on ties, down to ``stop_at`` parts.

        Only ever used on one token; also the yardstick in tests.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        none = 1 << 60
        while len(parts) > stop_at:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two whole tokens gives just these two.

        It does unless, on the way up, a part at the end of the left token
        joins a part at the start of the right one before both have grown on.
        The later merge of the two is undone step by step; ``limit`` is the
        rank below which a join across the border would have come first.
        """
        ranks, token, parts = self.ranks, self.token, self.parts
        limit = 1 << 60
        while True:
            if ranks.get(token[left] + token[right], limit) < limit:
                return False
            below_left, below_right = parts[left], parts[right]
            if not below_left and not below_right:
                return True
            if below_left and (not below_right or left > right):
                # On a tie of ranks the merge further left comes first.
                limit, left = left, below_left[1]
            else:
                limit, right = right + 1, below_right[0]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill in the last tokens of the prefixes of ``data`` that ``last`` doesn't cover yet."""
        rank_of, longest, known, fits = self.whole.get, self.longest, self._fits, self.fits
        if len(known) > REMEMBERED:
            known.clear()
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                rank = rank_of(data[start:end])
                if rank is None:
                    continue
                if start:
                    left = last[start - 1]
                    pair = left << 32 | rank
                    fit = known.get(pair)
                    if fit is None:
                        fit = known[pair] = fits(left, rank)
                    if not fit:
                        continue
                last.append(rank)
                break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix filled in."""
        size, found, end = self.size, [], len(last)
        while end:
            rank = last[end - 1]
            found.append(rank)
            end -= size[rank]
        return found[::-1]

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.walk(self.extend(piece, []))


class Tokenizer:
    """Pattern, table and encoder of one tokenizer file."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoder = PrefixEncoder(ranks)
        self.pattern = regex.compile(pattern)
        #: Piece to packed ids.
        self.pieces: dict[str, bytes] = {}
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in byte order: each starts from the prefixes it shares with the one before."""
        encoder, last, before = self.encoder, [], b""
        for data in sorted(piece.encode() for piece in pieces):
            rank = encoder.ranks.get(data)
            if rank is None:
                shared, most = 0, min(len(before), len(data))
                while shared < most and before[shared] == data[shared]:
                    shared += 1
                last, before = encoder.extend(data, last[:shared]), data
            found = encoder.walk(last) if rank is None else [rank]
            self.pieces[data.decode()] = np.array(found, dtype="<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(text) for text in texts]
        new = set().union(*cut)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self.learn(new.difference(self.pieces))
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


class EditableText:
    """A text whose encoding follows appends and edits.

    Where a piece ends depends on at most two characters behind it, so pieces
    that end further in front of a change stay as they are.  From there the
    text is cut anew until an old cut behind the change is met, since a cut
    depends only on what follows it.  The first changed piece keeps the last
    tokens of the bytes it shares with the piece it replaces.
    """

    AHEAD = 2

    def __init__(self, tokens: Tokenizer, text: str = ""):
        self.tokens = tokens
        self.text = ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        #: Prefixes filled in so far, the measure of the work done.
        self.filled = 0
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` up to ``end``."""
        encoder, shift = self.tokens.encoder, len(new) - (end - start)
        ends = [*self.starts[1:], len(self.text)][: len(self.starts)]
        kept = sum(1 for stop in ends if stop <= start - self.AHEAD)
        again = {at + shift: i for i, at in enumerate(self.starts) if at >= end and i >= kept}
        shared = self.tables[kept] if kept < len(self.tables) else []
        at = self.starts[kept] if kept < len(self.starts) else ends[-1] if ends else 0
        self.text = self.text[:start] + new + self.text[end:]
        starts, tables = self.starts[:kept], self.tables[:kept]
        while at < len(self.text) and at not in again:
            stop = self.tokens.pattern.match(self.text, at).end()
            data = self.text[at:stop].encode()
            old = b"".join(encoder.token[rank] for rank in encoder.walk(shared))
            same = next((i for i, (x, y) in enumerate(zip(old, data)) if x != y), min(len(old), len(data)))
            self.filled += len(data) - same
            starts.append(at)
            tables.append(encoder.extend(data, shared[:same]))
            at, shared = stop, []
        if at in again:
            starts += [x + shift for x in self.starts[again[at] :]]
            tables += self.tables[again[at] :]
        self.starts, self.tables = starts, tables

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        encoder, found = self.tokens.encoder, []
        for at, stop, last in zip(self.starts, [*self.starts[1:], len(self.text)], self.tables):
            piece = self.text[at:stop].encode()
            whole = encoder.ranks.get(piece)
            found += encoder.walk(last) if whole is None else [whole]
        return found


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]): packed ids of every whole text, and the bytes they decode to.

    No shuffle.  ``path`` is a tokenizer file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path, pattern)

        def done(docs: list[int], held: list[str]) -> Iterator[tuple]:
            for doc, ids in zip(docs, tokens.encode_many(held)):
                yield doc, len(ids) // 4, ids, tokens.decode(ids) if decoded else None

        def rows() -> Iterator[tuple]:
            docs: list[int] = []
            held: list[str] = []
            size = 0
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    docs.append(doc)
                    held.append(text.as_py())
                    size += len(held[-1])
                    if size >= TOGETHER:
                        yield from done(docs, held)
                        docs, held, size = [], [], 0
            yield from done(docs, held)

        return in_batches(_OUT, rows(), lambda row: 2 * len(row[2]))

    found = texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
    return found if decoded else found.drop("decoded")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of packed ids; an id outside the table is refused."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path, pattern)
        pairs = ((d, i) for b in batches for d, i in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
        return in_batches(schema, ((d, tokens.decode(i or b"")) for d, i in pairs), lambda row: len(row[1]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
