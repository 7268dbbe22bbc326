"""The predicate language in plain Python, to hold the compiled columns against."""

import math
import re

from docloom.plans import And, Cond, Not, Or

MISSING = object()


def number(v):
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, str):
        if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", v, re.ASCII):
            return float(v) if math.isfinite(float(v)) else None
        if re.fullmatch(r"[+-]?0[xX][0-9a-fA-F]+\.?[0-9a-fA-F]*[pP][+-]?\d+", v):
            return float.fromhex(v)
        if re.fullmatch(r"[+-]?inf(inity)?", v, re.I):
            return -math.inf if v[0] == "-" else math.inf
    return None


def kind(v):
    return "nil" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str" if isinstance(v, str) else "deep"


def equal(a, b):
    if kind(a) != kind(b):
        return False
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b if kind(a) == "deep" else a == b


def holds(v, op, c):
    n, k = number(v), number(c)
    two = isinstance(c, list) and len(c) == 2 and None not in map(number, c)
    if op == "EQ":
        return equal(v, c)
    if op == "NEQ":
        if kind(v) == "deep":
            return not equal(v, c)
        if kind(v) == "nil":
            return c is not None
        return kind(v) == kind(c) and v != c
    if op in ("GT", "GTE", "LT", "LTE"):
        return n is not None and k is not None and {"GT": n > k, "GTE": n >= k, "LT": n < k, "LTE": n <= k}[op]
    if op in ("INSIDE", "OUTSIDE", "BETWEEN"):
        if n is None or not two:
            return False
        lo, hi = map(number, c)
        return {"INSIDE": lo < n < hi, "OUTSIDE": n < lo or n > hi, "BETWEEN": lo <= n < hi}[op]
    if op == "WITHIN":
        return isinstance(c, list) and any(equal(v, x) for x in c)
    if op == "WITHOUT":
        return not isinstance(c, list) or not any(equal(v, x) for x in c)
    if op == "CONTAINS":
        return isinstance(v, list) and any(equal(x, c) for x in v)
    return False


def evaluate(doc, p):
    if isinstance(p, Cond):
        return holds((doc or {}).get(p.field), p.op, p.value)
    if isinstance(p, Not):
        return not evaluate(doc, p.part)
    if isinstance(p, And):
        return all(evaluate(doc, x) for x in p.parts)
    if isinstance(p, Or):
        return any(evaluate(doc, x) for x in p.parts)
    raise TypeError(p)
