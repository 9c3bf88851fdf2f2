"""Which of many patterns can match a text at all: one pass by an automaton over the literals that their matches must hold.

From a pattern come clauses: sets of lower-case literals, of each of which every match holds at least one. A pattern is tried on a
text only if the text, lower-cased, has a literal of every clause; one without clauses is always tried. What the patterns find
is the same."""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import product

import ahocorasick

#: Characters of the shortest literal that a clause may have; spellings that a part of a pattern may have to be listed.
LEAST, MOST = 3, 128

Clause = frozenset[str]


def _either(spellings: Iterable[set[str] | None]) -> set[str] | None:
    found: set[str] = set()
    for some in spellings:
        if some is None:
            return None
        found |= some
        if len(found) > MOST:
            return None
    return found


def _joined(parts: Sequence[set[str] | None]) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > MOST:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _spelled(op, arg) -> set[str] | None:
    """All that an item of a pattern can match, in lower case, if that is little; None otherwise."""
    if op is ops.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is ops.IN:
        if any(kind is not ops.LITERAL or value > 127 for kind, value in arg):
            return None
        return {chr(value).lower() for _, value in arg}
    if op is ops.SUBPATTERN:
        return None if arg[1] or arg[2] else _joined([_spelled(*item) for item in arg[3]])
    if op is ops.BRANCH:
        return _either(_joined([_spelled(*item) for item in branch]) for branch in arg[1])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, body = arg
        once = _joined([_spelled(*item) for item in body]) if high is not ops.MAXREPEAT and high <= 4 else None
        return None if once is None else _either(_joined([once] * n) for n in range(low, high + 1))
    return {""} if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT) else None


def _clauses(items) -> list[Clause]:
    """Clauses of a sequence: of its stretches that can be spelled, and of the parts between them that must occur."""
    out: list[Clause] = []
    stretch: set[str] = {""}

    def close() -> None:
        nonlocal stretch
        if min(map(len, stretch), default=0) >= LEAST:
            out.append(frozenset(stretch))
        stretch = {""}

    for op, arg in items:
        some = _spelled(op, arg)
        longer = None if some is None else _joined([stretch, some])
        if longer is not None:
            stretch = longer
            continue
        close()
        if some is not None:
            stretch = set(some)
        elif op is ops.SUBPATTERN:
            out += _clauses(arg[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
        elif op is ops.BRANCH:
            # of each branch its clause with the longest shortest literal; if a branch has none, nothing need occur
            best = [max(_clauses(branch), key=lambda c: min(map(len, c)), default=None) for branch in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
    close()
    return out


def clauses(pattern: str) -> list[Clause]:
    return _clauses(parser.parse(pattern, re.ASCII))


class Literals:
    """The automaton of some patterns."""

    def __init__(self, patterns: Sequence[str]):
        self.n = len(patterns)
        self.free = [i for i, p in enumerate(patterns) if not clauses(p)]
        needs = [(i, c) for i, p in enumerate(patterns) for c in clauses(p)]
        self.owners = [i for i, _ in needs]
        self.open = [sum(o == i for o in self.owners) for i in range(self.n)]
        places: dict[str, list[int]] = {}
        for k, (_, clause) in enumerate(needs):
            for literal in clause:
                places.setdefault(literal, []).append(k)
        self.automaton = ahocorasick.Automaton() if places else None
        for literal, where in places.items():
            # a literal tells what its parts tell: the automaton reports each of them
            self.automaton.add_word(literal, tuple(where))
        if places:
            self.automaton.make_automaton()

    def wanted(self, text: str) -> list[int]:
        """The patterns to try on this text, in order."""
        if self.automaton is None:
            return self.free
        seen: set[int] = set()
        known: set[tuple[int, ...]] = set()
        for _, where in self.automaton.iter(text.lower()):
            if where not in known:
                known.add(where)
                seen.update(where)
                if len(seen) == len(self.owners):
                    break
        if not seen:
            return self.free
        left = list(self.open)
        for k in seen:
            left[self.owners[k]] -= 1
        return [i for i in range(self.n) if not left[i]]


@lru_cache(maxsize=64)
def literals(patterns: tuple[str, ...]) -> Literals:
    """One automaton a process for the same patterns."""
    return Literals(patterns)
