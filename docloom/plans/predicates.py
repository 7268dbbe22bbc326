"""The predicate language and its compilation to columns.

Leaves compile to a pair, the condition and its complement, and NOT swaps the two down to the leaves.  So logic has two
values, a missing field included, without wrapping anything that would keep a filter from the scan.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import number_of
from .paths import PathError
from .resolve import Pair, always, flipped, never


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: object = None


class And:
    def __init__(self, *parts):
        self.parts = parts


class Or:
    def __init__(self, *parts):
        self.parts = parts


@dataclass(frozen=True)
class Not:
    part: object


def listed(value: object) -> list | None:
    """A condition's list; None for what isn't one."""
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else None


def bound_of(value: object) -> float | int | None:
    """A bound of a comparison; whole numbers stay exact, for columns of whole numbers."""
    return value if type(value) is int and number_of(value) is not None else number_of(value)


def compile_leaf(op: str, value: object, field) -> Pair:
    """The pair of one operator on a resolved field."""
    op = op.upper()
    if op == "EQ":
        return field.eq(value)
    if op == "NEQ":
        return field.neq(value)
    if op in ("GT", "GTE", "LT", "LTE"):
        c = bound_of(value)
        return never() if c is None else field.compare(op, c)
    if op in ("INSIDE", "OUTSIDE", "BETWEEN"):
        bounds = listed(value)
        if bounds is None or len(bounds) != 2 or None in (ends := [bound_of(x) for x in bounds]):
            return never()
        low, high = ends
        a, b = {"INSIDE": ("GT", "LT"), "BETWEEN": ("GTE", "LT"), "OUTSIDE": ("LT", "GT")}[op]
        (lt, lf), (ht, hf) = field.compare(a, low), field.compare(b, high)
        return (lt | ht, lf & hf) if op == "OUTSIDE" else (lt & ht, lf | hf)
    if op == "WITHIN":
        values = listed(value)
        return never() if values is None else field.within(values)
    if op == "WITHOUT":
        values = listed(value)
        return always() if values is None else flipped(field.within(values))
    if op == "CONTAINS":
        return field.contains(value)
    return never()


def compile_pair(pred, resolver) -> Pair:
    """The condition and its complement; None and a list are the empty and the plain conjunction."""
    if pred is None:
        return always()
    if isinstance(pred, (list, tuple)):
        pred = And(*pred)
    if isinstance(pred, Cond):
        try:
            field = resolver.value(pred.field)
        except PathError as e:
            warnings.warn(f"no row can match: {e}", stacklevel=2)
            return never()
        return compile_leaf(pred.op, pred.value, field)
    if isinstance(pred, Not):
        return flipped(compile_pair(pred.part, resolver))
    if isinstance(pred, Column):
        return pred, ~F.coalesce(pred, F.lit(False))
    if isinstance(pred, (And, Or)):
        if not pred.parts:
            return always() if isinstance(pred, And) else never()
        trues, falses = zip(*(compile_pair(p, resolver) for p in pred.parts))
        t, f = trues[0], falses[0]
        for x, y in zip(trues[1:], falses[1:]):
            t, f = (t & x, f | y) if isinstance(pred, And) else (t | x, f & y)
        return t, f
    raise TypeError(f"not a predicate: {pred!r}")


def is_noop(pred) -> bool:
    return pred is None or isinstance(pred, (list, tuple)) and not pred or isinstance(pred, And) and all(is_noop(p) for p in pred.parts)


def compile_predicate(pred, resolver) -> Column:
    return compile_pair(pred, resolver)[0]


def required_fields(pred) -> list[str]:
    """The fields that a predicate names, each once, in order."""
    if isinstance(pred, Cond):
        return [pred.field]
    parts = pred if isinstance(pred, (list, tuple)) else getattr(pred, "parts", [pred.part] if isinstance(pred, Not) else [])
    return list(dict.fromkeys(f for p in parts for f in required_fields(p)))
