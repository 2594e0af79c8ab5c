"""Removal of repeated substrings with suffix arrays built by difference covers.

A byte is removed when a string of ``length`` bytes that covers it also starts
in a document with a smaller id.  Suffix arrays of whole corpora don't fit a
task, so the work is dealt by content:

1. Every window of ``length`` bytes has an anchor, the smallest hash among its
   grams of ``gram`` bytes.  Equal windows have equal anchors.  The windows of
   a document that share an anchor are neighbours and form a block.  Least
   hashes are small numbers, so they are mixed once more before they deal.
2. Documents are grouped by id.  Each group sends its distinct anchor hashes,
   dealt by hash; an anchor that one group alone has, and there in one place,
   belongs to windows that nothing repeats.  The groups get one bit per hash back.
3. Each group sends the distinct blocks of the other anchors, with the places
   where they occur, to the shard of the anchor.  All windows that can be
   equal now lie in one shard.
4. Blocks that are the only ones of their anchor are one string wherever they
   occur.  A shard puts the others, where copies begin, end or differ, into
   strings of about ``SYMBOLS`` bytes, blocks of one anchor never apart, and
   builds the suffix array of each: sampled triples are sorted, recursion
   orders their names, the remaining suffixes are merged in.  Suffixes next to
   each other whose first ``length`` bytes agree are one string, and its
   smallest document is known.  The number of shards follows the bytes of the
   input, so a shard holds as much whatever their sum and the session's settings.
5. Places of windows that a smaller document has go back to their group, which
   cuts them out of the texts.

Hashes only decide what is compared; equality is decided on bytes.  Copies of
a text or passage are combined within their group before they are sent, and
within a shard before it is sorted.  The three exchanges are the texts by
group, 8 bytes per anchor, and the distinct blocks.

Defined cases: a null text is empty; texts shorter than ``length`` keep all
bytes; a null id counts as larger than all others; rows sharing an id never
remove from each other; overlaps count, within a document too; strings are
judged on the input; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import partitions, texts_of
from staywise.llm.suffix_array import suffix_array

LENGTH = 50
GRAM = 24
#: Documents whose ids agree but for so many last bits form a group; more bits, up to the second number, for large inputs.
GROUP_BITS, MOST_BITS = 9, 12
#: Bytes that a group of more documents may have on average, and messages between groups and shards that make it worth while.
GROUP_BYTES, MESSAGES = 4 << 20, 1 << 20
#: Positions that are hashed at a time, so that the arrays stay in cache.
SEGMENT = 1 << 15
#: Shards per shuffle partition at least, and bytes of text per shard at most: a shard is what one call holds in memory.
SHARDS, SHARD_BYTES = 4, 4 << 20
#: Symbols that one suffix array is meant to hold; a shard is split by its anchors' hashes to stay below.
SYMBOLS = 1 << 20

_LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 20) - 1)
_HASHES = pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("grp", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("kept", pa.binary())
])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at every position, by doubling."""
    step = np.uint64(0x9E3779B97F4A7C15)
    have, width, power = data.astype(np.uint64) + np.uint64(1), 1, step
    found, done = None, 0
    rest = gram
    while rest:
        if rest & 1:
            if found is None:
                found = have
            else:
                size = len(have) - done
                found = found[:size] * power + have[done:]
            done += width
        rest >>= 1
        if rest:
            have = have[: len(have) - width] * power + have[width:]
            power = power * power
            width *= 2
    found = found[: len(data) - gram + 1]
    found = (found ^ (found >> np.uint64(32))) * step
    return found ^ (found >> np.uint64(29))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """One to one; spreads the least of many hashes, which lie near zero, evenly over all numbers."""
    with np.errstate(over="ignore"):
        found = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        found = (found ^ (found >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return found ^ (found >> np.uint64(31))


@dataclass
class Texts:
    """The texts of a group in one array of bytes, ordered by id and text."""

    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Texts:
        texts = [x.encode() if isinstance(x, str) else x for x in table.column("text").to_pylist()]
        ids = [_LAST if x is None else x for x in table.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order])]).astype(np.int64)
        return cls(np.array([ids[i] for i in order], dtype=np.int64), data, bounds)

    def windows(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, hash) of every block: runs of windows of one document with one anchor.

        ``size`` is the number of windows; equal hashes in a window are won by the leftmost gram.
        """
        per = length - gram + 1
        total = len(self.data) - length + 1
        none = np.zeros(0, dtype=np.int64)
        if total <= 0:
            return none, none, none.astype(np.uint64)
        starts, sizes, hashes = [], [], []
        last = -1
        # A window is whole if its document doesn't end within it.
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        for low in range(0, total, SEGMENT):
            high = min(total, low + SEGMENT)
            with np.errstate(over="ignore"):
                grams = gram_hashes(self.data[low : high + length - 1], gram)
            placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            least, width = placed, 1
            while 2 * width <= per:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            size = high - low
            least = np.minimum(least[:size], least[per - width : per - width + size])
            anchor = (least & _PLACE).astype(np.int64)
            at = np.arange(low, high)
            whole = at + length <= ends[low:high]
            new = np.empty(size, dtype=bool)
            new[0] = True
            new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
            # Documents that end are followed by windows that aren't whole, except for empty gaps.
            begins = np.flatnonzero(new)
            stops = np.append(begins[1:], size)
            keep = whole[begins]
            begins, stops = begins[keep], stops[keep]
            starts.append(begins + low)
            sizes.append(stops - begins)
            hashes.append(mixed(grams[anchor[begins]]))
            last = high
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Shard of each hash: equal ranges of its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _strips_of(hashes: np.ndarray) -> np.ndarray:
    """The lower half, which tells the anchors of a shard apart but for rare collisions."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message, bytes of equal weight next to each other."""
    planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in map(np.ascontiguousarray, arrays)]
    whole = b"".join(planes)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _expanded(message: bytes) -> bytes:
    return pa.decompress(message[8:], int.from_bytes(message[:8], "little"), codec="zstd", asbytes=True)


def _array(planes: bytes, kind: type, count: int, at: int) -> np.ndarray:
    """One array of ``count`` numbers out of the planes that begin at byte ``at``."""
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(planes, np.uint8, count * width, at).reshape(width, count)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _send_hashes(table: pa.Table, length: int, gram: int, parts: int) -> pa.Table:
    """Distinct anchor hashes of a group, one sorted run per shard."""
    group = table.column("grp")[0].as_py()
    distinct = np.unique(Texts.of(table).windows(length, gram)[2])
    cuts = np.searchsorted(_parts_of(distinct, parts), np.arange(parts + 1))
    # Sorted hashes as differences: their leading bytes are few.
    runs = [(p, distinct[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
    return _table(_HASHES, [(p, group, _squeezed(np.diff(run, prepend=np.uint64(0)))) for p, run in runs])


def _mark_hashes(table: pa.Table) -> pa.Table:
    """For each group's run, one bit per hash: whether another group has it too."""
    part = table.column("part")[0].as_py()
    sent = [_expanded(x) for x in table.column("payload").to_pylist()]
    runs = [np.cumsum(_array(x, np.uint64, len(x) // 8, 0), dtype=np.uint64) for x in sent]
    distinct, counts = np.unique(np.concatenate(runs), return_counts=True)
    shared = distinct[counts > 1]
    rows = [(g, part, np.packbits(_member(run, shared)).tobytes()) for g, run in zip(table.column("grp").to_pylist(), runs)]
    return _table(_ANSWER, rows)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _rows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, width: int) -> np.ndarray:
    """Blocks as rows of equal width: their bytes, zeros behind them, and the number of windows last."""
    rows = np.zeros((len(starts), width + 2), dtype=np.uint8)
    rows[:, width:] = sizes.astype("<u2").view(np.uint8).reshape(-1, 2)
    column = np.arange(width)
    for low in range(0, len(starts), SEGMENT // 8):
        some = slice(low, low + SEGMENT // 8)
        have = column < (sizes[some] + length - 1)[:, None]
        rows[some, :width][have] = data[(starts[some, None] + column)[have]]
    return rows


def _bytes_of(data: np.ndarray, starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The spans of ``data`` one behind the other."""
    first = np.repeat(np.cumsum(spans) - spans, spans)
    return data[np.repeat(starts, spans) + np.arange(int(spans.sum())) - first]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each kind, kind of each row)."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return index, inverse.ravel()


def _send_blocks(docs: pa.Table, marks: pa.Table, length: int, gram: int, parts: int, bits: int) -> pa.Table:
    """Distinct blocks that may repeat, with their places, one message per shard."""
    if not docs.num_rows:
        return _HASHES.empty_table()
    group, texts = docs.column("grp")[0].as_py(), Texts.of(docs)
    starts, sizes, hashes = texts.windows(length, gram)
    distinct, counts = np.unique(hashes, return_counts=True)
    wanted = counts > 1
    cuts = np.searchsorted(_parts_of(distinct, parts), np.arange(parts + 1))
    for part, payload in zip(marks.column("part").to_pylist(), marks.column("payload").to_pylist()):
        a, b = cuts[part], cuts[part + 1]
        wanted[a:b] |= np.unpackbits(np.frombuffer(payload, np.uint8), count=b - a).astype(bool)
    chosen = _member(hashes, distinct[wanted])
    starts, sizes, hashes = starts[chosen], sizes[chosen], hashes[chosen]
    owner = _parts_of(hashes, parts)
    order = np.argsort(owner, kind="stable")
    starts, sizes, owner, strips = starts[order], sizes[order], owner[order], _strips_of(hashes[order])
    doc = np.searchsorted(texts.bounds, starts, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(parts + 1))
    sent = []
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            sent.append((part, group, _pack(texts, starts[a:b], sizes[a:b], strips[a:b], doc[a:b], length, gram, bits)))
    return _table(_HASHES, sent)


def _pack(
    texts: Texts, starts: np.ndarray, sizes: np.ndarray, strips: np.ndarray, doc: np.ndarray, length: int, gram: int, bits: int
) -> bytes:
    """Distinct blocks (windows, strip, bytes) and, per place, kind, start and document."""
    rows = _rows_of(texts.data, starts, sizes, length, 2 * length - gram)
    index, kind = _distinct(rows)
    head = np.array([len(index), len(starts)], dtype=np.int64)
    body = _bytes_of(texts.data, starts[index], sizes[index] + length - 1)
    ids = texts.ids[doc]
    # Within a group the last bits tell ids apart; a null id has a number of its own.
    short = np.where(ids == _LAST, 1 << bits, ids & ((1 << bits) - 1)).astype(np.uint16)
    # Groups are far below 4 GB: a row that long is more than Spark holds.
    return _squeezed(head, sizes[index].astype(np.uint16), strips[index], kind.astype(np.uint32), starts.astype(np.uint32), short, body)


def _unpack(group: int, message: bytes, bits: int) -> tuple[np.ndarray, ...]:
    """(windows, strips, bytes) of distinct blocks, (kind, start, id) of places."""
    planes = _expanded(message)
    distinct, places = _array(planes, np.int64, 2, 0).tolist()
    at, found = 16, []
    for kind, count in ((np.uint16, distinct), (np.uint32, distinct), (np.uint32, places), (np.uint32, places), (np.uint16, places)):
        found.append(_array(planes, kind, count, at))
        at += count * np.dtype(kind).itemsize
    sizes, strips, kinds, starts, short = found
    ids = np.where(short == 1 << bits, _LAST, np.left_shift(np.int64(group), bits) + short.astype(np.int64))
    return sizes, strips, np.frombuffer(planes, np.uint8, offset=at), kinds.astype(np.int64), starts.astype(np.int64), ids


def window_owners(sizes: np.ndarray, body: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """Smallest owner of each window's string, windows in block order.

    ``body`` holds the blocks one behind the other; a block of k windows has k + length - 1 bytes.
    """
    spans = sizes.astype(np.int64) + length - 1
    # Blocks are divided by a symbol smaller than any byte.
    inside = np.arange(len(body)) + np.repeat(np.arange(len(spans)), spans)
    text = np.zeros(len(body) + len(spans), dtype=np.int64)
    text[inside] = body.astype(np.int64) + 1
    begins = np.concatenate([[0], np.cumsum(spans + 1)])[:-1]
    number = np.full(len(text), -1, dtype=np.int64)
    total = int(sizes.sum())
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(begins, sizes) + np.arange(total) - first
    number[at] = np.arange(total)
    order = suffix_array(text)
    order = order[number[order] >= 0]
    # Neighbours whose first ``length`` bytes agree hold the same string.
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(length):
        symbol = text[order + k]
        same &= symbol[1:] == symbol[:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    of_block = np.repeat(owners, sizes)
    windows = number[order]
    least = np.empty(total, dtype=np.int64)
    if len(order):
        smallest = np.minimum.reduceat(of_block[windows], heads)
        least[windows] = np.repeat(smallest, np.diff(np.append(heads, len(order))))
    return least


def _own_blocks(table: pa.Table, length: int, gram: int, bits: int) -> pa.Table:
    """Places of removed windows, (start, windows) in the group's bytes, for every group that sent blocks.

    The messages stay packed: their blocks are taken out first and their places, one message's at a time, at the end.
    """
    part = table.column("part")[0].as_py()
    groups, messages = table.column("grp").to_pylist(), table.column("payload").to_pylist()
    width = 2 * length - gram
    parts = []
    for group, message in zip(groups, messages):
        n, strips, body, kinds, _, ids = _unpack(group, message, bits)
        least = np.full(len(n), _LAST, dtype=np.int64)
        np.minimum.at(least, kinds, ids)
        parts.append((n, strips, body.copy(), least))
    sizes, strips, body, least = (np.concatenate(x) for x in zip(*parts))
    shifts = np.cumsum([0, *(len(x[0]) for x in parts)]).tolist()
    del parts
    sizes = sizes.astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + length - 1)])[:-1]
    index, kind = _distinct(_rows_of(body, begins, sizes, length, width))
    # One owner per distinct block of the shard: the smallest document that has it.
    owners = np.full(len(index), _LAST, dtype=np.int64)
    np.minimum.at(owners, kind, least)
    ahead = np.cumsum(sizes[index]) - sizes[index]
    # A block that is the only one of its anchor shares no window with another, and its windows differ.
    least = np.repeat(owners, sizes[index])
    strips = strips[index]
    _, numbered, blocks = np.unique(strips, return_inverse=True, return_counts=True)
    rivals = np.flatnonzero(blocks[numbered] > 1)
    # Blocks of one anchor have one strip, so runs of strips can be sorted on their own.
    order = rivals[np.argsort(strips[rivals], kind="stable")]
    spans = sizes[index][order] + length
    filled = np.cumsum(spans)
    edges = np.flatnonzero(np.concatenate([[True], strips[order][1:] != strips[order][:-1], [True]])) if len(order) else order
    low = 0
    while low < len(order):
        # As many whole strips as fit, one at least.
        room = filled[low] - spans[low] + SYMBOLS
        fits = edges[(edges > low) & (filled[np.maximum(edges, 1) - 1] <= room)]
        high = int(fits[-1]) if len(fits) else int(edges[edges > low][0])
        some = index[order[low:high]]
        found = window_owners(sizes[some], _bytes_of(body, begins[some], sizes[some] + length - 1), owners[order[low:high]], length)
        first = np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        least[np.repeat(ahead[order[low:high]], sizes[some]) + np.arange(len(found)) - first] = found
        low = high
    rows = []
    sizes = sizes[index]
    for group, message, shift in zip(groups, messages, shifts):
        _, _, _, kinds, starts, ids = _unpack(group, message, bits)
        kinds = kind[shift + kinds]
        count = sizes[kinds]
        first = np.repeat(np.cumsum(count) - count, count)
        offset = np.arange(int(count.sum())) - first
        gone = least[np.repeat(ahead[kinds], count) + offset] < np.repeat(ids, count)
        at = np.sort((np.repeat(starts, count) + offset)[gone])
        if len(at):
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            runs = np.diff(np.append(new, len(at)))
            rows.append((group, part, _squeezed(np.concatenate([np.diff(at[new], prepend=0), runs]))))
    return _table(_ANSWER, rows)


def _cut(docs: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    """Each document of a group without its removed bytes."""
    if not docs.num_rows:
        return _OUT.empty_table()
    texts = Texts.of(docs)
    edge = np.zeros(len(texts.data) + 1, dtype=np.int32)
    for payload in answers.column("payload").to_pylist():
        found = _expanded(payload)
        steps, runs = _array(found, np.int64, len(found) // 8, 0).reshape(2, -1)
        at = np.cumsum(steps)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + runs - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rows = []
    for doc, a, b in zip(texts.ids.tolist(), texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
        flags = np.concatenate([[False], gone[a:b], [False]])
        turns = np.flatnonzero(flags[1:] != flags[:-1])
        kept = texts.data[a:b][~gone[a:b]].tobytes()
        rows.append((None if doc == _LAST else doc, b - a, turns[::2].tolist(), turns[1::2].tolist(), kept))
    return _table(_OUT, rows)


def layout(rows: int, size: int, parts: int) -> tuple[int, int]:
    """(shards, bits of an id that a group leaves out) for so many documents and bytes; ``parts`` shards at least.

    Every group may send to every shard, so larger inputs get larger groups, else messages would grow with the square.
    """
    shards, bits = max(parts, -(-size // SHARD_BYTES)), GROUP_BITS
    while bits < MOST_BITS and (rows >> bits) * shards > MESSAGES and (size << bits + 1) <= GROUP_BYTES * rows:
        bits += 1
    return shards, bits


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, starts, stops, kept): removed byte runs and the remaining bytes of every row."""
    gram = gram or max(1, length * GRAM // LENGTH)
    rows = texts_of(docs, id_column, text_column)
    seen = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("bytes")).first()
    parts, bits = layout(seen["rows"], seen["bytes"], SHARDS * partitions(docs.sparkSession))
    # Null ids are dealt by their text, so that they don't form one group.
    group = F.coalesce(F.shiftright("doc_id", bits), F.xxhash64("text"))
    grouped = rows.select(group.alias("grp"), "doc_id", F.col("text").cast("binary").alias("text")).repartition("grp")
    hashes = grouped.groupBy("grp").applyInArrow(
        lambda table: _send_hashes(table, length, gram, parts), "part int, grp bigint, payload binary"
    )
    marks = hashes.groupBy("part").applyInArrow(_mark_hashes, "grp bigint, part int, payload binary")
    blocks = grouped.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(
        lambda left, right: _send_blocks(left, right, length, gram, parts, bits), "part int, grp bigint, payload binary"
    )
    answers = blocks.groupBy("part").applyInArrow(
        lambda table: _own_blocks(table, length, gram, bits), "grp bigint, part int, payload binary"
    )
    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        lambda left, right: _cut(left, right, length),
        "doc_id bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept binary",
    )
