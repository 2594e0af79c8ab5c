"""Rules compiled into one deterministic automaton over bytes.

A rule's pattern goes through three steps: a nondeterministic automaton, its
subset construction, and minimisation.  The searches of all rules then run side
by side: a state of the combined automaton holds, for every rule, the open
candidates by age, so that one pass over the bytes reports where the leftmost,
longest, non-overlapping matches of each rule end.  The combined automaton is
minimised too and stored as a transition array over classes of bytes that no
rule tells apart.  Where a match begins is read from the reversed pattern,
backwards from its end.

Patterns know characters of ASCII, ``[..]`` classes with ranges, ``\\xHH`` and
escaped characters, groups, ``|`` and the repeats ``? * + {n} {n,} {n,k}``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

DEAD = -1
#: Bytes handled at a time, which bounds the copy that byte classes need.
SEGMENT = 1 << 20
#: States of the combined automaton; a rule set beyond that is refused.
MOST_STATES = 200_000

Tree = tuple


class PatternError(ValueError):
    """A pattern that the compiler doesn't know or can't search in one pass."""


class _Reader:
    """Recursive descent over a pattern: ('set', bytes), ('cat', parts), ('or', parts), ('rep', part, least, most)."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.pattern, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise PatternError(f"{self.pattern!r} ends too early")
        self.at += 1
        return self.pattern[self.at - 1]

    def whole(self) -> Tree:
        tree = self.choice()
        if self.at < len(self.pattern):
            raise PatternError(f"unexpected {self.peek()!r} in {self.pattern!r}")
        return tree

    def choice(self) -> Tree:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> Tree:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> Tree:
        part = self.atom()
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            sign = self.take()
            if sign == "{":
                least, comma, most = self.until("}").partition(",")
                part = ("rep", part, int(least), int(most) if most else None if comma else int(least))
            else:
                part = ("rep", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def until(self, end: str) -> str:
        found = ""
        while (c := self.take()) != end:
            found += c
        return found

    def atom(self) -> Tree:
        c = self.take()
        if c == "(":
            tree = self.choice()
            if self.take() != ")":
                raise PatternError(f"group not closed in {self.pattern!r}")
            return tree
        if c == "[":
            return self.members()
        if c in "*+?{}^$." or ord(c) > 127:
            raise PatternError(f"{c!r} is not supported in {self.pattern!r}")
        return self.cased({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise PatternError(f"escape {c!r} is not supported in {self.pattern!r}")
        return ord(c)

    def members(self) -> Tree:
        if self.peek() == "^":
            raise PatternError("negated classes are not supported")
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = ord(self.take())
            found.update(range(low, high + 1))
        return self.cased(found)

    def cased(self, found: set[int]) -> Tree:
        if max(found, default=0) > 127:
            raise PatternError("only ASCII characters are supported")
        if self.any_case:
            found = found | {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return ("set", frozenset(found))


def parse(pattern: str, any_case: bool = False) -> Tree:
    return _Reader(pattern, any_case).whole()


def reverse(tree: Tree) -> Tree:
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(part) for part in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(part) for part in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


@dataclass(frozen=True)
class Automaton:
    """Deterministic: ``steps[state][class]`` is the next state or ``DEAD``; state 0 starts."""

    steps: tuple[tuple[int, ...], ...]
    final: frozenset[int]
    classes: bytes


class _Network:
    """Nondeterministic automaton: free moves and moves on a set of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree: Tree, start: int) -> int:
        """Attach a pattern behind ``start``; its end."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            inner = self.node()
            self.free[start].append(inner)
            self.moves[inner] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.node()
        if kind == "or":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.node()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def reach(self, nodes: Iterable[int]) -> frozenset[int]:
        open_nodes, found = list(nodes), set(nodes)
        while open_nodes:
            for other in self.free[open_nodes.pop()]:
                if other not in found:
                    found.add(other)
                    open_nodes.append(other)
        return frozenset(found)


def byte_classes(trees: Iterable[Tree]) -> bytes:
    """For each byte its class: bytes that lie in the same sets of all patterns share one."""
    sets: list[frozenset[int]] = []

    def gather(tree: Tree) -> None:
        if tree[0] == "set":
            sets.append(tree[1])
        else:
            for part in tree[1] if tree[0] in ("cat", "or") else [tree[1]]:
                gather(part)

    for tree in trees:
        gather(tree)
    distinct = list(dict.fromkeys(sets))
    numbers: dict[tuple[bool, ...], int] = {}
    return bytes(numbers.setdefault(tuple(b in found for found in distinct), len(numbers)) for b in range(256))


def minimise(steps: Sequence[Sequence[int]], colours: Sequence[int]) -> list[int]:
    """Block of every state: equal for states with the same colour and, forever, the same next colours."""
    blocks = list(colours)
    count = len(set(blocks))
    while True:
        numbers: dict[tuple, int] = {}
        blocks = [
            numbers.setdefault((blocks[s], tuple(DEAD if t == DEAD else blocks[t] for t in row)), len(numbers)) for s, row in enumerate(steps)
        ]
        if len(numbers) == count:
            return blocks
        count = len(numbers)


def determinise(tree: Tree, classes: bytes) -> Automaton:
    """Subset construction of one anchored pattern, minimised."""
    net = _Network()
    start = net.node()
    end = net.add(tree, start)
    sample = [classes.index(c) for c in range(max(classes) + 1)]
    first = net.reach([start])
    numbers, queue, steps = {first: 0}, [first], []
    for nodes in queue:
        row = []
        for byte in sample:
            after = net.reach([net.moves[n][1] for n in nodes if net.moves[n] and byte in net.moves[n][0]])
            if not after:
                row.append(DEAD)
                continue
            if after not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            row.append(numbers[after])
        steps.append(row)
    colours = [int(end in nodes) for nodes in queue]
    # Number the blocks by their first state, so that the start stays 0.
    blocks = minimise(steps, colours)
    order = {block: k for k, block in enumerate(dict.fromkeys(blocks))}
    small: dict[int, tuple[int, ...]] = {}
    for state, row in enumerate(steps):
        small.setdefault(order[blocks[state]], tuple(DEAD if t == DEAD else order[blocks[t]] for t in row))
    final = frozenset(order[blocks[s]] for s, colour in enumerate(colours) if colour)
    return Automaton(tuple(small[k] for k in range(len(small))), final, classes)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are searched one after another; those that ``keep`` matches whole are reported."""

    kind: str
    pattern: str
    keep: str | None = None
    any_case: bool = False


@dataclass(frozen=True)
class Scanner:
    """Combined automaton as one flat transition array, and the reversed patterns of each rule.

    ``table[state + class]`` is the next state, states being multiples of the
    number of classes; from ``alarm`` on, entering a state means that the
    rules in ``ended[state]`` had a match end just before the byte read.
    ``open_at[state]`` are the rules that have a match if the text ends there.
    """

    kinds: tuple[str, ...]
    classes: bytes
    table: tuple[int, ...]
    start: int
    alarm: int
    ended: dict[int, tuple[int, ...]]
    open_at: dict[int, tuple[int, ...]]
    backward: tuple[tuple[Automaton, Automaton], ...]

    @property
    def states(self) -> int:
        return len(self.table) // (max(self.classes) + 1)

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of every match that its rule keeps, by start and then rule."""
        state, table, alarm = self.start, self.table, self.alarm
        events: list[tuple[int, int]] = []
        for base in range(0, len(data), SEGMENT):
            # The one pass over the bytes, for all rules together.
            for at, c in enumerate(data[base : base + SEGMENT].translate(self.classes), base):
                state = table[state + c]
                if state >= alarm:
                    events.append((at, state))
        ends = [(at, rule) for at, found in events for rule in self.ended[found]]
        ends += [(len(data), rule) for rule in self.open_at.get(state, ())]
        floor = [0] * len(self.kinds)
        found = []
        for end, rule in ends:
            begin, kept = self._begin(data, rule, floor[rule], end)
            floor[rule] = end
            if kept:
                found.append((begin, rule, end))
        return sorted(found)

    def _begin(self, data: bytes, rule: int, floor: int, end: int) -> tuple[int, bool]:
        """Leftmost start at ``floor`` or behind of a match that ends at ``end``; whether the keeping pattern matches the same bytes."""
        forms, keeps = self.backward[rule]
        form = keep = 0
        begin, kept = end, False
        for at in range(end - 1, floor - 1, -1):
            form = forms.steps[form][forms.classes[data[at]]]
            if form == DEAD:
                break
            if keep != DEAD:
                keep = keeps.steps[keep][keeps.classes[data[at]]]
            if form in forms.final:
                begin, kept = at, keep in keeps.final
        return begin, kept


def _search_step(rule: Automaton, open_states: tuple[int, ...], c: int) -> tuple[tuple[int, ...], bool]:
    """Candidates after a byte, oldest first, and whether a match ended before the byte.

    Equal states have equal futures, so the older candidate stands for both;
    behind a matched candidate nothing younger may begin.
    """
    matched = bool(open_states) and open_states[-1] in rule.final
    after = [rule.steps[s][c] for s in open_states]
    ended = matched and after[-1] == DEAD
    if ended or not matched:
        after = ([] if ended else after) + [rule.steps[0][c]]
    left: list[int] = []
    for state in after:
        if state != DEAD and state not in left:
            left.append(state)
            if state in rule.final:
                break
    if len(left) > 1 and left[-1] in rule.final:
        raise PatternError("a match may lie within a longer, older candidate; such rules are not searched in one pass")
    return tuple(left), ended


@lru_cache(maxsize=16)
def compile_rules(rules: tuple[Rule, ...]) -> Scanner:
    """Combine the searches of all rules.

    A rule must match at least one byte, and a match that may go on must stay a
    match with every byte it takes; else it is refused with ``PatternError``.
    """
    trees = [(parse(r.pattern, r.any_case), parse(r.keep or r.pattern, r.any_case)) for r in rules]
    classes = byte_classes(tree for pair in trees for tree in pair)
    width = max(classes) + 1
    anchored = [determinise(form, classes) for form, _ in trees]
    for rule, machine in zip(rules, anchored):
        if 0 in machine.final:
            raise PatternError(f"{rule.pattern!r} matches nothing at all")
        if any(t != DEAD and t not in machine.final for s in machine.final for t in machine.steps[s]):
            raise PatternError(f"a match of {rule.pattern!r} may go on without a match")
    first = (tuple(() for _ in rules), ())
    numbers, queue, steps = {first: 0}, [first], []
    for searches, _ in queue:
        row = []
        for c in range(width):
            moved = [_search_step(machine, found, c) for machine, found in zip(anchored, searches)]
            after = (tuple(found for found, _ in moved), tuple(k for k, (_, ended) in enumerate(moved) if ended))
            if after not in numbers:
                if len(numbers) >= MOST_STATES:
                    raise PatternError(f"the rules need more than {MOST_STATES} states")
                numbers[after] = len(numbers)
                queue.append(after)
            row.append(numbers[after])
        steps.append(row)

    def matched(searches: tuple) -> tuple[int, ...]:
        return tuple(k for k, found in enumerate(searches) if found and found[-1] in anchored[k].final)

    # A state is told apart by what it reports: matches that ended, and matches if the text ends here.
    reports = [(ended, matched(searches)) for searches, ended in queue]
    colour = {report: k for k, report in enumerate(dict.fromkeys(reports))}
    blocks = minimise(steps, [colour[report] for report in reports])
    member = {block: state for state, block in reversed(list(enumerate(blocks)))}
    order = sorted(member, key=lambda block: (bool(reports[member[block]][0]), member[block]))
    place = {block: k * width for k, block in enumerate(order)}
    table = tuple(place[blocks[t]] for block in order for t in steps[member[block]])
    ended = {place[b]: reports[member[b]][0] for b in order if reports[member[b]][0]}
    backward = tuple(tuple(determinise(reverse(tree), classes) for tree in pair) for pair in trees)
    return Scanner(
        kinds=tuple(r.kind for r in rules),
        classes=classes,
        table=table,
        start=place[blocks[0]],
        alarm=min(ended, default=len(table)),
        ended=ended,
        open_at={place[b]: reports[member[b]][1] for b in order if reports[member[b]][1]},
        backward=backward,
    )
