"""What counts as a number in a comparison, for literals at plan time and for columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"
HEX = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"


def number_of(value: object) -> float | None:
    """A literal as a number: numbers, booleans as 1 and 0, texts that are a number through and through; else None.

    NaN is None as well, since no comparison with it holds; a finite text beyond the range of a double is None too.
    """
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        try:
            x = float(value)
        except OverflowError:
            return None
        return None if math.isnan(x) else x
    if isinstance(value, str):
        if re.fullmatch(DECIMAL, value, re.ASCII):
            x = float(value)
            return x if math.isfinite(x) else None
        if re.fullmatch(HEX, value):
            try:
                return float.fromhex(value)
            except OverflowError:
                return None
        if re.fullmatch("[+-]?inf(inity)?", value, re.IGNORECASE):
            return -math.inf if value[0] == "-" else math.inf
    return None


def text_number(s: Column) -> Column:
    """A text column as a number, by the same rules; null where it isn't one."""
    cast = s.try_cast("double")
    inf = F.lit(math.inf)
    return (
        F.when(s.rlike(DECIMAL) | s.rlike(HEX), F.when(F.abs(cast) < inf, cast))
        .when(s.rlike(INFINITE), F.when(s.startswith("-"), F.lit(-math.inf)).otherwise(inf))
        .otherwise(F.lit(None).cast("double"))
    )
