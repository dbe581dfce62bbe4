"""Boolean trigram queries derived from regular expressions.

Of every part of an expression it is known which texts it can be as a whole, if they are few, how
its matches begin and end, and which trigrams they must hold. Sequences join these facts: what
ends one part and begins the next makes trigrams across the border. Letters A-Z count as small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

#: Whole texts of a part that are told apart, members of a class that are, and conjunctions of a query; beyond that less is known.
MOST_TEXTS, MOST_CHARACTERS, MOST_PARTS = 64, 12, 64

#: Alternatives, each a set of trigrams that a match must hold; ``ANYTHING`` rules nothing out.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def least(parts: Iterable[frozenset[str]]) -> Query:
    """The alternatives without those that another one implies."""
    parts = set(parts)
    return frozenset(p for p in parts if not any(q < p for q in parts))


def both(a: Query, b: Query) -> Query:
    """What holds if both do; the stronger of the two alone if their alternatives would be too many."""
    out = least(p | q for p in a for q in b) if len(a) * len(b) <= MOST_PARTS**2 else MOST_PARTS * [0]
    return out if len(out) <= MOST_PARTS else min(a, b, key=lambda q: (q == ANYTHING, len(q)))


def either(a: Query, b: Query) -> Query:
    out = least(a | b)
    return out if len(out) <= MOST_PARTS else ANYTHING


def of_texts(texts: Iterable[str]) -> Query:
    """That one of the texts is there."""
    return least(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


@dataclass(frozen=True)
class Part:
    """``whole``: all texts that the part can be, or None; ``head`` and ``tail``: how they begin and end, two characters at most."""

    whole: frozenset[str] | None
    head: frozenset[str]
    tail: frozenset[str]
    query: Query

    def must(self) -> Query:
        return self.query if self.whole is None else of_texts(self.whole)


def texts(whole: Iterable[str]) -> Part:
    whole = frozenset(whole)
    ends = frozenset(t[:2] for t in whole), frozenset(t[-2:] for t in whole)
    return Part(whole, *ends, ANYTHING) if len(whole) <= MOST_TEXTS else Part(None, *ends, of_texts(whole))


UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANYTHING)
EMPTY = texts([""])


def then(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None:
        return texts(x + y for x in a.whole for y in b.whole)
    # the whole texts of one side together with what the other begins or ends with
    known = of_texts(x + y for x in (a.whole if a.whole is not None else a.tail) for y in (b.whole if b.whole is not None else b.head))
    rest = both(a.query, b.query)
    head = frozenset((x + y)[:2] for x in a.whole for y in b.head) if a.whole is not None else a.head
    tail = frozenset((x + y)[-2:] for x in a.tail for y in b.whole) if b.whole is not None else b.tail
    return Part(None, head, tail, both(known, rest))


def alternatives(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None:
        return texts(a.whole | b.whole)
    return Part(None, a.head | b.head, a.tail | b.tail, either(a.must(), b.must()))


def repeated(part: Part, low: int, high: int) -> Part:
    if high == 1:
        return alternatives(part, EMPTY) if low == 0 else part
    if low == 0:
        return UNKNOWN
    # between the first and the last one there may be more of them
    return then(part, then(UNKNOWN, part)) if low > 1 else Part(None, part.head, part.tail, part.must())


def small(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def one_of(items: list) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(small(value))
        elif kind is C.RANGE and value[1] - value[0] < 2 * MOST_CHARACTERS:
            found |= {small(c) for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    return texts(found) if len(found) <= MOST_CHARACTERS else UNKNOWN


def analysed(parsed) -> Part:
    out = EMPTY
    for kind, value in parsed:
        if kind is C.LITERAL:
            part = texts([small(value)])
        elif kind is C.IN:
            part = one_of(value)
        elif kind is C.BRANCH:
            part = analysed(value[1][0])
            for other in value[1][1:]:
                part = alternatives(part, analysed(other))
        elif kind is C.SUBPATTERN:
            part = analysed(value[3])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            part = repeated(analysed(value[2]), value[0], value[1])
        elif kind is C.ATOMIC_GROUP:
            part = analysed(value)
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = EMPTY
        else:
            part = UNKNOWN
        out = then(out, part)
    return out


def query_of(regex: str) -> Query:
    """Alternatives of mandatory trigrams, in small letters; empty if nothing is mandatory, so that every text has to be scanned."""
    found = analysed(_parser.parse(regex)).must()
    return frozenset() if frozenset() in found else found


def fits(text: str, query: Query) -> bool:
    """Whether a text in small letters can hold a match."""
    return not query or any(all(g in text for g in part) for part in query)


def named(queries: Iterable[Query]) -> list[str]:
    """The trigrams that the queries name, in order."""
    return sorted(set(itertools.chain.from_iterable(itertools.chain.from_iterable(queries))))
