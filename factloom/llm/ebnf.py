"""Small grammars in EBNF, and the relations between adjacent tokens that follow from them.

Notation: ``Name = ... ;`` with ``|``, ``( )``, ``[ ]`` for optional and ``{ }`` for repeated parts. Names that start
with a capital are productions; quoted marks and other names are terminals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

_PART = re.compile(r"""\s*(?:("[^"]+")|([A-Za-z_][\w$]*)|([|()\[\]{};=]))""")


@dataclass
class Grammar:
    """Productions as alternatives of symbol tuples; groups become productions of their own."""

    text: str
    rules: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        parts, at = [], 0
        body = self.text.rstrip()
        while at < len(body):
            m = _PART.match(body, at)
            if not m:
                raise ValueError(f"grammar: {body[at : at + 40]!r}")
            parts.append(("t", m[1][1:-1]) if m[1] else ("n", m[2]) if m[2] else ("m", m[3]))
            at = m.end()
        self._parts, self._at = parts, 0
        while self._at < len(parts):
            name = parts[self._at][1]
            self._at += 2
            self.rules.setdefault(name, []).extend(self._alternatives(";"))

    def _fresh(self, alternatives: list[tuple[str, ...]]) -> str:
        name = f"_{len(self.rules)}"
        self.rules[name] = alternatives
        return name

    def _alternatives(self, end: str) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        now: list[str] = []
        while True:
            kind, x = self._parts[self._at]
            self._at += 1
            if kind == "m" and x == end:
                return [*out, tuple(now)]
            if kind == "m" and x == "|":
                out.append(tuple(now))
                now = []
            elif kind == "m" and x in "([{":
                name = self._fresh([])
                inner = self._alternatives({"(": ")", "[": "]", "{": "}"}[x])
                self.rules[name] = inner if x == "(" else [*inner, ()] if x == "[" else [*[(*a, name) for a in inner], ()]
                now.append(name)
            else:
                now.append(x)

    @cached_property
    def nullable(self) -> set[str]:
        out: set[str] = set()
        while new := {n for n, alts in self.rules.items() if n not in out and any(all(s in out for s in a) for a in alts)}:
            out |= new
        return out

    def _edge(self, step: int) -> dict[str, set[str]]:
        sets: dict[str, set[str]] = {n: set() for n in self.rules}
        grown = True
        while grown:
            grown = False
            for n, alts in self.rules.items():
                for alt in alts:
                    for s in alt[::step]:
                        new = sets[s] if s in self.rules else {s}
                        if not new <= sets[n]:
                            sets[n] |= new
                            grown = True
                        if s not in self.nullable:
                            break
        return sets

    @cached_property
    def first(self) -> dict[str, set[str]]:
        return self._edge(1)

    @cached_property
    def last(self) -> dict[str, set[str]]:
        return self._edge(-1)

    def adjacent(self, start: str) -> set[tuple[str, str]]:
        """All pairs of terminals that can stand next to each other, with ``BOF`` and ``EOF`` around ``start``."""
        out: set[tuple[str, str]] = set()
        for alts in [*self.rules.values(), [("BOF", start, "EOF")]]:
            for alt in alts:
                for k, a in enumerate(alt):
                    for b in alt[k + 1 :]:
                        out |= {(x, y) for x in (self.last[a] if a in self.rules else {a}) for y in (self.first[b] if b in self.rules else {b})}
                        if b not in self.nullable:
                            break
        return out
