"""Regular expressions over bytes as minimal deterministic automata.

Syntax: literals, ``\\xHH`` and escaped characters, ``[...]`` with ranges,
groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``.  Characters
above U+007F cannot be named, so bytes of other scripts belong to no class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ALL_BYTES = 256


class Automaton(NamedTuple):
    """Transitions as one flat array: state + byte -> state, states being multiples of 256.

    States from ``first_accepting`` on accept; ``accepts[state >> 8]`` has a bit
    for each rule.  State ``start`` begins; a state equal to ``dead`` cannot accept.
    """

    table: list[int]
    start: int
    first_accepting: int
    accepts: list[int]
    dead: int


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.pattern, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.pattern[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.pattern[self.at - 2:self.at], 16)
        if ord(c) > 127:
            raise ValueError(f"not an ASCII character: {c!r}")
        return ord(c)

    def cased(self, codes: set[int]) -> tuple:
        if self.any_case:
            codes = codes | {ord(chr(c).swapcase()) for c in codes}
        return ("set", frozenset(codes))

    def either(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("either", options)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.single()))
        return ("sequence", items)

    def single(self) -> tuple:
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take()
            return inner
        if self.peek() != "[":
            return self.cased({self.char()})
        self.take()
        codes: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.pattern[self.at + 1:self.at + 2] != "]":
                self.take()
                high = self.char()
            codes.update(range(low, high + 1))
        self.take()
        return self.cased(codes)

    def repeated(self, node: tuple) -> tuple:
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at:end].partition(",")
                self.at = end + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
            node = ("repeat", node, least, most)
        return node


class _Graph:
    """A nondeterministic automaton: byte-set edges and empty edges between numbered states."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, node: tuple, begin: int, backwards: bool) -> int:
        """Append a node after state ``begin``; returns the state behind it."""
        if node[0] == "set":
            end = self.state()
            self.edges[begin].append((node[1], end))
            return end
        if node[0] == "sequence":
            for item in reversed(node[1]) if backwards else node[1]:
                begin = self.add(item, begin, backwards)
            return begin
        if node[0] == "either":
            end = self.state()
            for option in node[1]:
                own = self.state()
                self.empty[begin].append(own)
                self.empty[self.add(option, own, backwards)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            begin = self.add(inner, begin, backwards)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[begin].append(loop)
            self.empty[self.add(inner, loop, backwards)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[begin].append(end)
            own = self.state()
            self.empty[begin].append(own)
            begin = self.add(inner, own, backwards)
        self.empty[begin].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def compile_rules(patterns: list[str], any_case: list[bool] | None = None, backwards: bool = False,
                  search: bool = False) -> Automaton:
    """One minimal automaton for all patterns; rule i has bit i of ``accepts``.

    ``backwards`` reads texts from their end; ``search`` lets matches begin at
    every byte, so that a state accepts where a match of the rule is complete.
    """
    graph, begin = _Graph(), None
    begin = graph.state()
    final: dict[int, int] = {}
    for i, pattern in enumerate(patterns):
        own = graph.state()
        graph.empty[begin].append(own)
        node = _Parser(pattern, bool(any_case and any_case[i])).either()
        final[graph.add(node, own, backwards)] = 1 << i

    groups: dict[tuple[bool, ...], int] = {}  # bytes that no edge tells apart
    sets = list({s for edges in graph.edges for s, _ in edges})
    group_of = np.zeros(ALL_BYTES, np.int64)
    for byte in range(ALL_BYTES):
        group_of[byte] = groups.setdefault(tuple(byte in s for s in sets), len(groups))
    sample = [int(np.argmax(group_of == g)) for g in range(len(groups))]

    first = graph.closed({begin})
    number, rows, todo = {first: 0}, [], [first]
    for subset in todo:  # grows while it is read: subset construction
        row = []
        for byte in sample:
            reached = {t for s in subset for allowed, t in graph.edges[s] if byte in allowed}
            after = graph.closed(reached | ({begin} if search else set()))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum({final[s] for s in subset if s in final}) for subset in todo])

    block = np.unique(accepts, return_inverse=True)[1]  # minimisation: split until stable
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    kinds = block.max() + 1
    member = np.array([int(np.argmax(block == k)) for k in range(kinds)])
    order = np.argsort(accepts[member] > 0, kind="stable")  # accepting states last
    place = np.empty(kinds, np.int64)
    place[order] = np.arange(kinds)
    small = place[block[step[member[order]]]]
    table = (small[:, group_of] * ALL_BYTES).ravel()
    accept = accepts[member[order]]
    stuck = [s for s in range(kinds) if not accept[s] and (small[s] == s).all()]
    return Automaton(table.tolist(), int(place[block[0]]) * ALL_BYTES, int((accept == 0).sum()) * ALL_BYTES,
                     accept.tolist(), stuck[0] * ALL_BYTES if stuck else -1)


def match_starts(found: Automaton, data: bytes) -> list[tuple[int, int]]:
    """(position, rules) where matches begin, last first: one pass over the bytes.

    ``found`` must be compiled backwards for searching.
    """
    table, accepting, state, at, out = found.table, found.first_accepting, found.start, len(data), []
    for byte in reversed(data):
        at -= 1
        state = table[state + byte]
        if state >= accepting:
            out.append((at, found.accepts[state >> 8]))
    return out


def match_end(rule: Automaton, data: bytes, start: int) -> int:
    """Where the longest match that begins at ``start`` ends; -1 if none does."""
    table, state, end = rule.table, rule.start, -1
    if state >= rule.first_accepting:
        end = start
    for at in range(start, len(data)):
        state = table[state + data[at]]
        if state >= rule.first_accepting:
            end = at + 1
        elif state == rule.dead:
            break
    return end
