"""Boolean trigram queries that every match of a regular expression fulfils.

The syntax tree of the expression is folded bottom up.  A part is described by
the set of texts it matches while that set is small, else by what its matches
can begin and end with, and by a query: a set of conjunctions, each a set of
trigrams, one of which must be contained as a whole.  Letters are compared in
lower case.  A query may ask for less than the expression does, never for more,
so texts that fail it hold no match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from re import _constants as C  # noqa: PLC2701 - the standard library's own syntax tree
from re import _parser  # noqa: PLC2701

Query = frozenset  # of frozensets of trigrams; a conjunction without trigrams holds for every text

ANY: Query = frozenset([frozenset()])
MOST_TEXTS = 64  # texts kept for a part; a part with more is known by its ends only
MOST_CONJUNCTIONS = 64


def _least(conjunctions) -> Query:
    """Without conjunctions that another one implies."""
    found = set(conjunctions)
    return frozenset(c for c in found if not any(other < c for other in found))


def either(a: Query, b: Query) -> Query:
    found = _least(a | b)
    return found if len(found) <= MOST_CONJUNCTIONS else ANY


def both(a: Query, b: Query) -> Query:
    found = _least(x | y for x, y in product(a, b))
    if len(found) <= MOST_CONJUNCTIONS:
        return found
    return min(a, b, key=len)


def trigrams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def query_of(texts: frozenset) -> Query:
    return _least(trigrams(t) for t in texts)


@dataclass(frozen=True)
class Part:
    """texts: all it matches, or None; first, last: every match begins and ends with one of these."""

    texts: frozenset | None
    first: frozenset = frozenset([""])
    last: frozenset = frozenset([""])
    need: Query = ANY

    def opened(self) -> Part:
        """Known by its ends and its query."""
        if self.texts is None:
            return self
        return Part(None, self.texts, self.texts, query_of(self.texts))


EMPTY = Part(frozenset([""]))
UNKNOWN = Part(None)


def _short(texts: frozenset, from_start: bool) -> tuple[frozenset, Query]:
    """Ends of two letters, and what the texts ask for."""
    return frozenset(t[:2] if from_start else t[-2:] for t in texts), query_of(texts)


def follow(a: Part, b: Part) -> Part:
    """The matches of ``a`` with matches of ``b`` behind them."""
    if a.texts is not None and b.texts is not None and len(a.texts) * len(b.texts) <= MOST_TEXTS:
        return Part(frozenset(x + y for x, y in product(a.texts, b.texts)))
    first = frozenset(x + y for x, y in product(a.texts, b.opened().first)) if a.texts is not None else a.first
    last = frozenset(x + y for x, y in product(a.opened().last, b.texts)) if b.texts is not None else b.last
    a, b = a.opened(), b.opened()
    need = both(a.need, b.need)
    if len(a.last) * len(b.first) <= MOST_TEXTS:  # trigrams over the border
        need = both(need, query_of(frozenset(x[-2:] + y[:2] for x, y in product(a.last, b.first))))
    first, of_first = _short(first, True)
    last, of_last = _short(last, False)
    need = both(both(need, of_first), of_last)
    return Part(None, first if len(first) <= MOST_TEXTS else frozenset([""]), last if len(last) <= MOST_TEXTS else frozenset([""]), need)


def choice(a: Part, b: Part) -> Part:
    if a.texts is not None and b.texts is not None and len(a.texts | b.texts) <= MOST_TEXTS:
        return Part(a.texts | b.texts)
    a, b = a.opened(), b.opened()
    return Part(None, a.first | b.first, a.last | b.last, either(a.need, b.need))


def _letters(items: list) -> frozenset | None:
    """The letters of a class in lower case; None if they are many or not listed."""
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < 256:
            found.update(chr(x).lower() for x in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _repeated(low: int, high: int, part: Part) -> Part:
    if high == 1:
        return choice(EMPTY, part) if low == 0 else part
    if low == 0:
        return UNKNOWN
    whole = EMPTY
    for _ in range(min(low, 4)):  # more copies tell no more
        whole = follow(whole, part)
    if low == high <= 4:
        return whole
    one, whole = part.opened(), whole.opened()
    return Part(None, whole.first if part.texts is not None else one.first, whole.last if part.texts is not None else one.last, whole.need)


def _part(tree) -> Part:
    whole = EMPTY
    for kind, value in tree:
        if kind is C.LITERAL:
            found = Part(frozenset([chr(value).lower()]))
        elif kind is C.IN:
            letters = _letters(value)
            found = UNKNOWN if letters is None else Part(letters)
        elif kind is C.SUBPATTERN:
            found = _part(value[-1])
        elif kind is C.BRANCH:
            branches = [_part(b) for b in value[1]]
            found = branches[0]
            for other in branches[1:]:
                found = choice(found, other)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found = _repeated(value[0], value[1], _part(value[2]))
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            found = EMPTY
        else:  # any letter, a letter other than one, references
            found = UNKNOWN
        whole = follow(whole, found)
    return whole


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match of ``pattern`` contains; ``ANY`` if nothing is mandatory.

    Only for texts in which lower case is that of single letters: the texts
    searched must be lower-cased as a whole.
    """
    return _part(_parser.parse(pattern, re.A)).opened().need
