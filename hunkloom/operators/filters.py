"""Filters of a vector store, given as trees of dictionaries, compiled to one condition.

    {"$and": [{"repo": "o/r"}, {"severity": {"$in": ["high", "critical"]}}]}        # of metadata
    {"$or": [{"$contains": "token"}, {"$not_contains": "test"}]}                     # of the text

The condition is an ordinary column of comparisons, so what it says of stored columns reaches the scan, below the search. A document
without the field meets `$ne` and `$nin` only (other conditions are null for it, which no filter lets pass).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
}
_NEGATED = {"$ne": "$eq", "$nin": "$in"}
_TEXT: dict[str, Callable[[Column, str], Column]] = {"$contains": lambda c, v: c.contains(v), "$regex": lambda c, v: c.rlike(v)}
_TEXT_NEGATED = {"$not_contains": "$contains", "$not_regex": "$regex"}
_JOIN = {"$and": lambda a, b: a & b, "$or": lambda a, b: a | b}


def _negated(c: Column, met: Column) -> Column:
    return c.isNull() | ~met


def _joined(tree: dict, one: Callable[[dict], Column]) -> Column | None:
    """The condition of a node that joins others; None for other nodes."""
    (name,) = tree if len(tree) == 1 else (None,)
    if name not in _JOIN:
        return None
    if not isinstance(tree[name], list) or not tree[name]:
        raise ValueError(f"{name} takes a list of conditions, not {tree[name]!r}")
    return reduce(_JOIN[name], (one(t) for t in tree[name]))


def metadata(where: dict | None, field: Callable[[str], Column] = F.col) -> Column:
    """The condition of a tree over metadata; `field` gives a name's column (for a map: `lambda n: F.col("metadata")[n]`)."""
    if not where:
        return F.lit(True)
    if (found := _joined(where, lambda t: metadata(t, field))) is not None:
        return found
    parts = []
    for name, value in where.items():
        if name.startswith("$"):
            raise ValueError(f"unknown operator {name!r}")
        for sign, wanted in (value if isinstance(value, dict) else {"$eq": value}).items():
            if sign in _COMPARE:
                parts.append(_COMPARE[sign](field(name), wanted))
            elif sign in _NEGATED:
                parts.append(_negated(field(name), _COMPARE[_NEGATED[sign]](field(name), wanted)))
            else:
                raise ValueError(f"unknown operator {sign!r} for {name!r}")
    return reduce(_JOIN["$and"], parts)


def document(where: dict | None, content: str = "content") -> Column:
    """The condition of a tree over a document's text."""
    if not where:
        return F.lit(True)
    if (found := _joined(where, lambda t: document(t, content))) is not None:
        return found
    parts = []
    for sign, wanted in where.items():
        if sign in _TEXT:
            parts.append(_TEXT[sign](F.col(content), wanted))
        elif sign in _TEXT_NEGATED:
            parts.append(_negated(F.col(content), _TEXT[_TEXT_NEGATED[sign]](F.col(content), wanted)))
        else:
            raise ValueError(f"unknown operator {sign!r}")
    return reduce(_JOIN["$and"], parts)
