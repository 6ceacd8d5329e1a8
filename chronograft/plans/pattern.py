"""Patterns: small directed graphs with labelled vertices, parsed and checked on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LABELS = "ABCDE"


class PatternError(ValueError):
    """A pattern or an option that can't be used; the message says where."""


@dataclass(frozen=True)
class Pattern:
    """Vertices 0..n-1 in order of first appearance, with labels; directed arcs, each once."""

    labels: tuple[str, ...]
    arcs: tuple[tuple[int, int], ...]
    names: tuple[str, ...] = ()
    arc_labels: tuple[str | None, ...] = field(default=())

    @property
    def n(self) -> int:
        return len(self.labels)

    def out(self, q: int) -> list[int]:
        return [b for a, b in self.arcs if a == q]

    def inc(self, q: int) -> list[int]:
        return [a for a, b in self.arcs if b == q]

    def neighbours(self, q: int) -> list[int]:
        return sorted({*self.out(q), *self.inc(q)} - {q})

    def connected(self) -> bool:
        seen, todo = {0}, [0]
        while todo:
            new = [x for x in self.neighbours(todo.pop()) if x not in seen]
            seen.update(new)
            todo += new
        return len(seen) == self.n


def _vertex(token: str, known: dict[str, int], labels: list[str], where: str, alphabet: str | None) -> int:
    name, colon, label = token.rpartition(":")
    if not colon:
        name = label = token
    if not name or not label or alphabet is not None and label not in tuple(alphabet):
        raise PatternError(f"{where}: {token!r} is no LABEL or id:LABEL with a label of {alphabet or 'any letters'}")
    if name in known and labels[known[name]] != label:
        raise PatternError(f"{where}: {name!r} has the labels {labels[known[name]]} and {label}")
    if name not in known:
        known[name] = len(labels)
        labels.append(label)
    return known[name]


def parse(text: str, mode: str = "strict", self_loops: bool | None = None, alphabet: str | None = LABELS) -> Pattern:
    """A pattern from lines ``TOKEN TOKEN``; a token is a label (its own identity) or id:label.

    strict: exactly two tokens, blank lines and ``#`` comments anywhere, self-loops accepted.
    loose: two tokens or more of which two count, a comment only as a line's first character,
    blank lines rejected, self-loops rejected.
    edges: two tokens and an optional arc label, any string being a label.
    """
    if mode not in ("strict", "loose", "edges"):
        raise PatternError(f"no such mode: {mode}")
    loops = mode == "strict" if self_loops is None else self_loops
    known: dict[str, int] = {}
    labels: list[str] = []
    arcs: dict[tuple[int, int], str | None] = {}
    for number, line in enumerate(text.splitlines(), 1):
        where = f"line {number}"
        if mode == "strict":
            line = line.split("#", 1)[0]
        elif line.startswith("#"):
            continue
        tokens = line.split()
        if not tokens and (mode != "loose" or line == ""):
            continue
        most = {"strict": 2, "loose": len(tokens), "edges": 3}[mode]
        if not 2 <= len(tokens) <= most:
            raise PatternError(f"{where}: {len(tokens)} tokens")
        a, b = (_vertex(x, known, labels, where, None if mode == "edges" else alphabet) for x in tokens[:2])
        if a == b and not loops:
            raise PatternError(f"{where}: self-loop")
        arcs.setdefault((a, b), tokens[2] if mode == "edges" and len(tokens) == 3 else None)
    if not arcs:
        raise PatternError("the pattern has no arcs")
    return Pattern(tuple(labels), tuple(arcs), tuple(known), tuple(arcs.values()))


def of(*arcs: str) -> Pattern:
    """A pattern from arcs ``"x:A y:B"``."""
    return parse("\n".join(arcs))


def check(pattern: Pattern, k: int | None = None, least_k: int = 1, single_vertex: bool = False) -> None:
    """Raises unless the pattern is connected and non-empty and k is in its domain."""
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k < least_k):
        raise PatternError(f"k has to be an integer of {least_k} or more")
    if not pattern.n or not pattern.arcs and not (single_vertex and pattern.n == 1):
        raise PatternError("the pattern has no arcs")
    if not pattern.connected():
        raise PatternError("the pattern isn't connected")


def check_seed(seed: int | str) -> int:
    if not re.fullmatch(r"\d{1,10}", str(seed)) or int(seed) >= 1 << 32:
        raise PatternError("the seed has to be a number below 2^32")
    return int(seed)
