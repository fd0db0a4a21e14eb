"""The syllable canon, a regular expression over syllable letters, as a small deterministic automaton.

Understood are letters, ( ) | * + ? and [ ]. Lookarounds are passed over here, which accepts too much; where a canon has
them, the whole expression is applied to finished parses besides. States from which no end can be reached are left out, so
a parse that the canon cannot complete has no step. A canon has a few dozen states: this is configuration, not data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Canon:
    start: int
    moves: dict[tuple[int, str], int]
    accepting: frozenset[int]

    def after(self, state: int, letters: str) -> int | None:
        """The state after some letters, or None if the canon cannot be completed."""
        for x in letters:
            state = self.moves.get((state, x), -1)
            if state < 0:
                return None
        return state

    @property
    def states(self) -> set[int]:
        return {self.start, *self.accepting, *(q for q, _ in self.moves), *self.moves.values()}


def has_lookaround(pattern: str) -> bool:
    return bool(re.search(r"\(\?[=!<]", pattern))


def _without_lookarounds(pattern: str) -> str:
    while (m := re.search(r"\(\?<?[=!]", pattern)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[i], 0)
            i += 1
        pattern = pattern[: m.start()] + pattern[i:]
    return pattern.replace("(?:", "(")


class _Nfa:
    """Fragments (begin, end) of an automaton with empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[str | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def on(self, letters: str) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.edges[a] += [(x, b) for x in letters]
        return a, b

    def link(self, a: int, b: int) -> None:
        self.edges[a].append((None, b))


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.nfa = text, 0, _Nfa()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in parts:
            self.nfa.link(a, x), self.nfa.link(y, b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            x, y = self.repeated()
            self.nfa.link(b, x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        a, b = self.single()
        while (c := self.peek()) and c in "*+?":
            self.at += 1
            x, y = self.nfa.state(), self.nfa.state()
            self.nfa.link(x, a), self.nfa.link(b, y)
            if c in "*?":
                self.nfa.link(x, y)
            if c in "*+":
                self.nfa.link(b, a)
            a, b = x, y
        return a, b

    def single(self) -> tuple[int, int]:
        c = self.peek()
        self.at += 1
        if c == "(":
            made = self.choice()
            if self.peek() != ")":
                raise ValueError(f"unbalanced canon: {self.text}")
            self.at += 1
            return made
        if c == "[":
            end = self.text.index("]", self.at)
            letters, self.at = self.text[self.at : end], end + 1
            return self.nfa.on(letters)
        if c in ")*+?|":
            raise ValueError(f"canon not understood at {self.at}: {self.text}")
        return self.nfa.on(c)


def compile_canon(pattern: str) -> Canon:
    p = _Parser(_without_lookarounds(pattern).removeprefix("^").removesuffix("$"))
    begin, end = p.choice()
    if p.at < len(p.text):
        raise ValueError(f"unbalanced canon: {pattern}")

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x, q in p.nfa.edges[todo.pop()]:
                if x is None and q not in seen:
                    seen.add(q), todo.append(q)
        return frozenset(seen)

    first = closed({begin})
    number, todo, moves = {first: 0}, [first], {}
    while todo:
        s = todo.pop()
        for x in sorted({x for q in s for x, _ in p.nfa.edges[q] if x is not None}):
            t = closed({r for q in s for y, r in p.nfa.edges[q] if y == x})
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            moves[number[s], x] = number[t]
    accepting = {i for s, i in number.items() if end in s}
    live = set(accepting)
    while more := {q for (q, _), t in moves.items() if t in live} - live:
        live |= more
    return Canon(0, {k: t for k, t in moves.items() if t in live and k[0] in live}, frozenset(accepting))
