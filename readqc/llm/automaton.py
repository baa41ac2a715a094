"""Regular expressions over bytes as minimal deterministic automata with transition arrays.

A pattern is parsed into edges of a nondeterministic automaton; several tagged patterns become one deterministic automaton
by subset construction over classes of bytes that no pattern tells apart, and Moore's refinement merges equal states.
Patterns know literals, classes, groups, |, ?, *, +, {n}, {n,}, {n,m} and escapes (\\xHH or a plain character).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ALL = frozenset(range(255))  # 0xFF is no byte of UTF-8 and belongs to no class
_OPEN = -1


class Nfa:
    """Edges (from, bytes or None, to) between numbered states; ``any_case`` adds the other case of ASCII letters."""

    def __init__(self, pattern: str, any_case: bool = False):
        self.edges: list[tuple[int, frozenset | None, int]] = []
        self.states, self._text, self._at, self._fold = 0, pattern, 0, any_case
        self.first, self.last = self._either()
        if self._at != len(pattern):
            raise ValueError(f"unexpected {pattern[self._at]!r} at {self._at} of {pattern!r}")

    def _peek(self) -> str:
        return self._text[self._at : self._at + 1]

    def _next(self) -> str:
        self._at += 1
        return self._text[self._at - 1 : self._at]

    def _new(self) -> int:
        self.states += 1
        return self.states - 1

    def _link(self, a: int, b: int, what: frozenset | None = None) -> None:
        self.edges.append((a, what, b))

    def _either(self) -> tuple[int, int]:
        first, last = self._new(), self._new()
        while True:
            a, b = self._chain()
            self._link(first, a)
            self._link(b, last)
            if self._peek() != "|":
                return first, last
            self._next()

    def _chain(self) -> tuple[int, int]:
        first = last = self._new()
        while self._peek() not in ("", "|", ")"):
            began = self._at
            a, b = self._atom()
            ended, (least, most) = self._at, self._repeats()
            after = self._at
            for i in range(max(least, 1 if most == _OPEN else most)):
                if i:  # another copy of the atom
                    self._at = began
                    a, b = self._atom()
                    assert self._at == ended
                self._link(last, a)
                if i >= least:
                    self._link(a, b)
                last = b
            if most == _OPEN:
                self._link(b, a)
            self._at = after
        return first, last

    def _repeats(self) -> tuple[int, int]:
        simple = {"?": (0, 1), "*": (0, _OPEN), "+": (1, _OPEN)}
        if self._peek() in simple and self._peek():
            return simple[self._next()]
        if self._peek() != "{":
            return 1, 1
        end = self._text.index("}", self._at)
        least, comma, most = self._text[self._at + 1 : end].partition(",")
        self._at = end + 1
        return int(least), int(most) if most else _OPEN if comma else int(least)

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self._next()
            ends = self._either()
            if self._next() != ")":
                raise ValueError(f"open group in {self._text!r}")
            return ends
        a, b = self._new(), self._new()
        self._link(a, b, self._class() if self._peek() == "[" else self._both_cases({self._byte()}))
        return a, b

    def _byte(self) -> int:
        c = self._next()
        if c == "\\" and self._peek() == "x":
            self._at += 3
            return int(self._text[self._at - 2 : self._at], 16)
        return ord((self._next() if c == "\\" else c).encode("ascii"))

    def _class(self) -> frozenset:
        self._next()
        inverse, out = self._peek() == "^", set()
        self._at += inverse
        while self._peek() != "]":
            low = self._byte()
            high = low
            if self._peek() == "-" and self._text[self._at + 1] != "]":
                self._next()
                high = self._byte()
            out |= set(range(low, high + 1))
        self._next()
        out = self._both_cases(out)
        return ALL - out if inverse else out

    def _both_cases(self, what: set[int]) -> frozenset:
        return frozenset(what | {b ^ 32 for b in what if chr(b).isascii() and chr(b).isalpha()} if self._fold else what)


class Dfa(NamedTuple):
    """``step[state, kind[byte]]`` is the next state and ``tags[state]`` the bits of the patterns that end there; state 0 begins."""

    kind: np.ndarray
    step: np.ndarray
    tags: np.ndarray


def _kinds(sets: set[frozenset]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and a byte of each class: bytes that are in the same sets are one class."""
    seen: dict[tuple, int] = {}
    kind = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)], np.uint8)
    return kind, [int(np.flatnonzero(kind == k)[0]) for k in range(len(seen))]


def _minimal(step: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no text tells apart; the first state stays first."""
    group = np.unique(tags, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = list(dict.fromkeys(group.tolist()))  # groups by their first state
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    member = np.array([int(np.flatnonzero(group == g)[0]) for g in order])
    return number[group[step[member]]], tags[member]


def automaton(patterns: list[tuple[Nfa, int]], backwards: bool = False, anywhere: bool = False) -> Dfa:
    """One minimal automaton of (pattern, tag bits). backwards: of the patterns read from their end; anywhere: a match may begin at every byte."""
    after: dict[int, list[tuple[frozenset | None, int]]] = {}
    begin, end, base = set(), {}, 0
    for nfa, bits in patterns:
        for a, what, b in nfa.edges:
            a, b = (b, a) if backwards else (a, b)
            after.setdefault(a + base, []).append((what, b + base))
        first, last = (nfa.last, nfa.first) if backwards else (nfa.first, nfa.last)
        begin.add(first + base)
        end[last + base] = bits
        base += nfa.states

    def closed(states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for what, to in after.get(todo.pop(), ()):
                if what is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    kind, example = _kinds({what for edges in after.values() for what, _ in edges if what is not None})
    start = closed(begin)
    moves: dict[int, list[tuple[int, frozenset]]] = {}  # of an NFA state: (class, closed states reached), made once
    for state, edges in after.items():
        reached = [(k, closed([to])) for what, to in edges if what is not None for k, b in enumerate(example) if b in what]
        if reached:
            moves[state] = reached
    number, todo, step = {start: 0}, [start], []
    for now in todo:
        to = [set(start) if anywhere else set() for _ in example]
        for s in now:
            for k, states in moves.get(s, ()):
                to[k] |= states
        row = []
        for t in map(frozenset, to):
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            row.append(number[t])
        step.append(row)
    tags = np.zeros(len(todo), np.int64)
    for i, states in enumerate(todo):
        for s in states & end.keys():
            tags[i] |= end[s]
    return Dfa(kind, *_minimal(np.array(step, np.int64), tags))


def run(dfa: Dfa, data: np.ndarray, state: int = 0, lanes: int = 2048) -> tuple[np.ndarray, int]:
    """The states after each byte of data, and the last one.

    The data are cut into ``lanes`` pieces that step together, a byte each at a time. All but the first begin in state 0; a
    piece whose predecessor ends in another state is run again from there, until it meets the states that it had.
    """
    n = len(data)
    lanes = max(1, min(lanes, n // 256))
    width = -(-n // lanes)
    kinds = np.zeros(width * lanes, np.uint8)
    kinds[:n] = dfa.kind[data]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, width).T)
    many = dfa.step.shape[1]
    table = (dfa.step * many).ravel()  # states are kept times the number of classes
    seen = np.empty((width, lanes), np.int32)
    begin = np.zeros(lanes, np.int64)
    begin[0] = state * many
    now, at = begin.copy(), np.empty(lanes, np.int64)
    for t in range(width):
        np.add(now, kinds[t], out=at)
        np.take(table, at, out=now)
        seen[t] = now
    while width:
        wrong = 1 + np.flatnonzero(seen[-1, :-1] != begin[1:])
        if not len(wrong):
            break
        begin[wrong] = now = seen[-1, wrong - 1].astype(np.int64)
        for t in range(width):
            now = table[now + kinds[t, wrong]]
            new = now != seen[t, wrong]
            if not new.any():
                break
            wrong, now = wrong[new], now[new]
            seen[t, wrong] = now
    states = (seen.T.ravel()[:n] // many).astype(np.int32)
    return states, int(states[-1]) if n else state
