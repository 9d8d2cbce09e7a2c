"""Prefix expressions: one form for the JSON notations, canonical form, skeleton and numbers."""

from __future__ import annotations

import json
from typing import Any

#: Operators whose two arguments may change places.
COMMUTATIVE = ("add", "mul")
HOLE = "#"


class Unreadable(ValueError):
    """The text is no expression."""


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _value(x: Any) -> Any:
    """Whole floats as ints, so that 20 and 20.0 are one number."""
    return int(x) if isinstance(x, float) and x.is_integer() else x


def _same(x: Any, v: int) -> bool:
    return number(x) and x == v


def _is(x: Any, op: str, arity: int) -> bool:
    return isinstance(x, list) and len(x) == arity + 1 and x[0] == op


def text_of(x: Any) -> str:
    return json.dumps(x, ensure_ascii=True, sort_keys=True, separators=(",", ":"), default=str)


def listed(x: Any) -> Any:
    """Nested lists of any notation: ``{"op": o, "args": [...]}`` becomes ``[o, ...]``, numbers their value."""
    if isinstance(x, dict):
        op, args = x.get("op"), x.get("args", [])
        if isinstance(op, str):
            return [op, *map(listed, args if isinstance(args, list) else [args])]
        return {k: listed(v) for k, v in sorted(x.items())}
    if isinstance(x, list):
        return [str(x[0]), *map(listed, x[1:])] if x else x
    return _value(x) if number(x) else x


def _negated(x: Any) -> Any:
    if _same(x, 0):
        return 0
    if _is(x, "neg", 1):
        return x[1]
    return _difference(x[2], x[1]) if _is(x, "sub", 2) else ["neg", x]


def _difference(a: Any, b: Any) -> Any:
    if _same(b, 0):
        return a
    if _same(a, 0):
        return _negated(b)
    return 0 if text_of(a) == text_of(b) else ["sub", a, b]


def _sum(a: Any, b: Any) -> Any:
    for x, y in ((a, b), (b, a)):
        if _same(x, 0):
            return y
        if _is(x, "neg", 1) and text_of(x[1]) == text_of(y):
            return 0
    return ["add", *sorted((a, b), key=text_of)]


def _product(a: Any, b: Any) -> Any:
    if _same(a, 0) or _same(b, 0):
        return 0
    for unit, made in ((1, lambda y: y), (-1, _negated)):
        for x, y in ((a, b), (b, a)):
            if _same(x, unit):
                return made(y)
    return ["mul", *sorted((a, b), key=text_of)]


def _quotient(op: str):
    return lambda a, b: a if _same(b, 1) else [op, a, b]


#: What an operator of that many arguments becomes, its arguments being canonical.
_RULES = {
    ("neg", 1): _negated,
    ("add", 2): _sum,
    ("sub", 2): _difference,
    ("mul", 2): _product,
    ("div", 2): _quotient("div"),
    ("safe_div", 2): _quotient("safe_div"),
    ("rolling_mean", 2): _quotient("rolling_mean"),  # a mean of one row is the row
}


def canonical(x: Any) -> Any:
    """The canonical form of an expression in nested lists (``listed``): identity only, not for execution,
    since ``x * 0`` and ``x - x`` are null where x is."""
    if isinstance(x, dict):
        return {k: canonical(v) for k, v in x.items()}
    if not isinstance(x, list) or not x:
        return x
    op, args = x[0], [canonical(a) for a in x[1:]]
    rule = _RULES.get((op, len(args)))
    return rule(*args) if rule else [op, *args]


def parse(text: str | None) -> Any:
    """The expression of a JSON text in nested lists. Unreadable: null, blank, broken, ``null``, an empty list or
    object, a NaN or infinity, and a nesting deeper than Python's parser follows."""

    def refuse(name: str) -> None:
        raise Unreadable(name)

    if text is None or not text.strip():
        raise Unreadable("blank")
    try:
        x = listed(json.loads(text, parse_constant=refuse))
    except (ValueError, RecursionError, OverflowError) as e:
        raise Unreadable(str(e)) from None
    if x is None or x == [] or x == {}:
        raise Unreadable("empty")
    return x


def skeleton(x: Any) -> tuple[str, list[float]]:
    """The compact text of an expression with a hole for each number, and the numbers from left to right."""
    numbers: list[float] = []

    def walk(y: Any) -> Any:
        if number(y):
            numbers.append(float(y))
            return HOLE
        if isinstance(y, list):
            return [walk(z) for z in y]
        if isinstance(y, dict):
            return {k: walk(v) for k, v in y.items()}
        return "\\" + y if isinstance(y, str) and y.startswith((HOLE, "\\")) else y

    return text_of(walk(x)), numbers


def canonical_skeleton(text: str | None) -> tuple[str, list[float]] | None:
    """Skeleton and numbers of the canonical form; None if the text is unreadable."""
    try:
        return skeleton(canonical(parse(text)))
    except (Unreadable, RecursionError, OverflowError):
        return None
