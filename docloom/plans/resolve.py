"""What a field is in a table: a place in a VARIANT document, or a column (or nested field) of a typed table."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number_of, text_number
from .paths import Path, filter_path

Pair = tuple[Column, Column]  # a condition and its complement, both free of nulls where it matters to NOT


def never() -> Pair:
    return F.lit(False), F.lit(True)


def always() -> Pair:
    return F.lit(True), F.lit(False)


def flipped(p: Pair) -> Pair:
    return p[1], p[0]


def _null_safe(true: Column) -> Pair:
    return true, ~F.coalesce(true, F.lit(False))


def kind_of(value: object) -> str:
    """nil, bool, num, str or deep."""
    if value is None:
        return "nil"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    return "str" if isinstance(value, str) else "deep"


def canonical(value: object) -> Column:
    """A literal list or object in the one spelling that `to_json` gives variants."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


class VariantValue:
    """Conditions on a VARIANT column v; a missing field (null) and a JSON null are both nil."""

    def __init__(self, v: Column):
        self.v = v
        self.tag = F.schema_of_variant(v)

    def as_(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)

    def nil(self) -> Pair:
        return self.v.isNull() | F.is_variant_null(self.v), self.v.isNotNull() & ~F.is_variant_null(self.v)

    def is_deep(self) -> Column:
        return self.tag.startswith("ARRAY") | self.tag.startswith("OBJECT")

    def is_num(self) -> Column:
        return self.tag.isin("BIGINT", "DOUBLE", "FLOAT") | self.tag.startswith("DECIMAL")

    def is_str(self) -> Column:
        return self.tag == "STRING"

    def is_bool(self) -> Column:
        return self.tag == "BOOLEAN"

    def text(self) -> Column:
        return self.as_("string")

    def number(self) -> Column:
        return F.when(self.is_num() | self.is_bool(), self.as_("double")).when(self.is_str(), text_number(self.text()))

    def same(self, c: object) -> Column:
        """Equal and of one type; null or false otherwise."""
        kind = kind_of(c)
        if kind == "str":
            return self.is_str() & (self.text() == F.lit(c))
        if kind == "bool":
            return self.is_bool() & (self.number() == F.lit(float(c)))
        if kind == "num":
            x = number_of(c)
            return F.lit(False) if x is None else self.is_num() & (self.number() == F.lit(x))
        return self.is_deep() & (F.to_json(self.v) == canonical(c))

    def eq(self, c: object) -> Pair:
        return self.nil() if c is None else _null_safe(self.same(c))

    def neq(self, c: object) -> Pair:
        kind, nil = kind_of(c), self.nil()[0]
        if kind == "nil":
            return _null_safe(self.is_deep())
        if kind == "deep":
            return _null_safe(nil | (self.is_deep() & (F.to_json(self.v) != canonical(c))))
        own = {"str": self.is_str(), "bool": self.is_bool(), "num": self.is_num()}[kind]
        return _null_safe(nil | (own & ~F.coalesce(self.same(c), F.lit(False))) | self.is_deep())

    def within(self, values: list) -> Pair:
        out = F.lit(False)
        for c in values:
            out = out | F.coalesce(self.eq(c)[0], F.lit(False))
        return out, ~out

    def contains(self, c: object) -> Pair:
        own = F.try_variant_get(self.v, "$", "array<variant>")
        found = F.exists(own, lambda x: F.coalesce(VariantValue(x).eq(c)[0], F.lit(False)))
        return _null_safe(F.when(self.tag.startswith("ARRAY"), found).otherwise(F.lit(False)))

    def compare(self, op: str, c: float | int) -> Pair:
        return compare(self.number(), op, c)


class IndexedValue(VariantValue):
    """The same conditions on an index row, whose columns kind, number and text hold what most of them need.

    These reach the scan as pushed filters, so a lookup in a stored index decodes no value that it doesn't return.
    """

    COLUMNS = "kind string, number double, text string, value variant"

    def __init__(self):
        super().__init__(F.col("value"))

    @staticmethod
    def columns(v: Column) -> list[Column]:
        own = VariantValue(v)
        kind = F.when(own.nil()[0], "nil").when(own.is_num(), "num").when(own.is_str(), "str").when(own.is_bool(), "bool").when(own.is_deep(), "deep").otherwise("other")
        return [kind.alias("kind"), own.number().alias("number"), F.when(own.is_str(), own.text()).alias("text"), v.alias("value")]

    def nil(self) -> Pair:
        return F.col("kind") == "nil", F.col("kind") != "nil"

    def is_deep(self) -> Column:
        return F.col("kind") == "deep"

    def is_num(self) -> Column:
        return F.col("kind") == "num"

    def is_str(self) -> Column:
        return F.col("kind") == "str"

    def is_bool(self) -> Column:
        return F.col("kind") == "bool"

    def text(self) -> Column:
        return F.col("text")

    def number(self) -> Column:
        return F.col("number")


def compare(n: Column, op: str, c: float) -> Pair:
    """A comparison of a double that is null where there is no number, and its complement."""
    x = F.lit(float(c))
    true = {"GT": n > x, "GTE": n >= x, "LT": n < x, "LTE": n <= x}[op]
    false = {"GT": n <= x, "GTE": n < x, "LT": n >= x, "LTE": n > x}[op]
    return true, n.isNull() | false


class TypedValue:
    """Conditions on a column of a known type, in forms that reach the scan as pushed filters."""

    def __init__(self, col: Column, kind: T.DataType):
        self.col, self.type = col, kind
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.CharType, T.VarcharType)):
            self.col, self.type = (F.base64(col) if isinstance(kind, T.BinaryType) else col.cast("string")), T.StringType()
        t = self.type
        self.integral = isinstance(t, T.IntegralType)
        self.numeric = isinstance(t, T.NumericType)
        self.floating = isinstance(t, (T.DoubleType, T.FloatType))
        self.kind = "num" if self.numeric else "bool" if isinstance(t, T.BooleanType) else "str" if isinstance(t, T.StringType) else "nil" if isinstance(t, T.NullType) else "deep"

    def nil(self) -> Pair:
        return self.col.isNull(), self.col.isNotNull()

    def literal(self, c: object) -> Column | None:
        """c as a literal of the column's kind; None if no value of the column equals it."""
        if kind_of(c) != self.kind or self.kind in ("deep", "nil"):
            return None
        if self.integral:
            x = number_of(c)
            if x is None or not math.isfinite(x) or x != math.floor(x):
                return None
            whole = c if isinstance(c, int) else int(x)
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(self.type)]
            return F.lit(whole).cast(self.type) if -(1 << bits) <= whole < 1 << bits else None
        if self.numeric:
            x = number_of(c)
            return None if x is None else F.lit(x)
        return F.lit(c)

    def json(self) -> Column:
        return F.to_json(F.parse_json(F.to_json(self.col)))

    def eq(self, c: object) -> Pair:
        if c is None:
            return self.nil()
        if self.kind == "deep" and kind_of(c) == "deep":
            return self.col.isNotNull() & (self.json() == canonical(c)), self.col.isNull() | (self.json() != canonical(c))
        x = self.literal(c)
        return never() if x is None else (self.col == x, self.col.isNull() | (self.col != x))

    def neq(self, c: object) -> Pair:
        kind = kind_of(c)
        if kind == "nil":
            return self.nil()[::-1] if self.kind == "deep" else never()
        if self.kind == "deep":
            return flipped(self.eq(c)) if kind == "deep" else always()
        if kind != self.kind:
            return self.nil()
        x = self.literal(c)
        return always() if x is None else (self.col.isNull() | (self.col != x), self.col == x)

    def within(self, values: list) -> Pair:
        if self.kind == "deep":
            out, none = never()
            for c in values:
                t, f = self.eq(c)
                out, none = out | t, none & f
            return out, none
        known = [x for c in values if c is not None and (x := self.literal(c)) is not None]
        has_nil = any(c is None for c in values)
        if not known:
            return self.nil() if has_nil else never()
        inside = self.col.isin(*known)
        return (inside | self.col.isNull(), self.col.isNotNull() & ~inside) if has_nil else (inside, self.col.isNull() | ~inside)

    def contains(self, c: object) -> Pair:
        if not isinstance(self.type, T.ArrayType):
            return never()
        return _null_safe(F.exists(self.col, lambda x: F.coalesce(TypedValue(x, self.type.elementType).eq(c)[0], F.lit(False))))

    def compare(self, op: str, c: float | int) -> Pair:
        if self.kind in ("deep", "nil"):
            return never()
        if self.kind == "str":
            return compare(text_number(self.col), op, c)
        if self.kind == "bool":
            return compare(self.col.cast("double"), op, c)
        if self.integral:
            return self._compare_whole(op, c)
        true, false = compare(self.col, op, c)
        if self.floating:  # NaN is larger than anything to Spark; here no comparison with it holds
            return (true & ~F.isnan(self.col), false | F.isnan(self.col)) if op in ("GT", "GTE") else (true, false)
        return true, false

    def _compare_whole(self, op: str, c: float) -> Pair:
        """The bound is made whole, not the column a double, so that the filter is pushed and large values stay exact."""
        if not -(2.0**63) <= c < 2.0**63:
            above = c > 0
            true = (op in ("LT", "LTE")) == above
            return (self.col.isNotNull(), self.col.isNull()) if true else never()
        bound = {"GT": math.floor, "LTE": math.floor, "GTE": math.ceil, "LT": math.ceil}[op](c)
        if not -(1 << 63) <= bound < 1 << 63:
            return never() if op in ("GTE", "GT") else (self.col.isNotNull(), self.col.isNull())
        x = F.lit(bound).cast("long") if isinstance(self.type, T.LongType) or not -(1 << 31) <= bound < 1 << 31 else F.lit(bound)
        n = self.col
        true = {"GT": n > x, "GTE": n >= x, "LT": n < x, "LTE": n <= x}[op]
        false = {"GT": n <= x, "GTE": n < x, "LT": n >= x, "LTE": n > x}[op]
        return true, n.isNull() | false


class VariantResolver:
    """Fields of documents in a VARIANT column, with the pseudo-fields _id and _label."""

    def __init__(self, doc: str = "doc", id_col: str = "_id", label: str | None = None, parse=filter_path):
        self.doc, self.id_col, self.label, self.parse = doc, id_col, label, parse

    def value(self, field: str):
        path: Path = self.parse(field)
        if path.segments == ("_id",):
            return TypedValue(F.col(self.id_col), T.StringType())
        if path.segments == ("_label",) and self.label is not None:
            return TypedValue(F.lit(self.label), T.StringType())
        if path.is_wild and not path.never_matches:  # all matches as one array; a lone match is itself
            return VariantValue(F.try_parse_json(F.get_json_object(F.to_json(F.col(self.doc)), path.json_path())))
        if path.never_matches:
            return TypedValue(F.lit(None), T.NullType())
        v = F.col(self.doc)
        for step in path.variant_steps():
            if step.startswith("="):  # a key with both kinds of quotes
                v = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(step[1:]))
            else:
                v = F.variant_get(v, step, "variant")
        return VariantValue(v)


class TypedResolver:
    """Fields of a table with columns; nested fields by structs, array positions and map keys.  Unknown fields are missing."""

    def __init__(self, schema: T.StructType, id_col: str | None = None, label: str | None = None, parse=filter_path):
        self.schema, self.id_col, self.label, self.parse = schema, id_col, label, parse

    def value(self, field: str):
        path: Path = self.parse(field)
        if path.segments == ("_id",) and self.id_col:
            return TypedValue(F.col(self.id_col).cast("string"), T.StringType())
        if path.segments == ("_label",) and self.label is not None:
            return TypedValue(F.lit(self.label), T.StringType())
        missing = TypedValue(F.lit(None), T.NullType())
        col, kind = None, self.schema
        for i, s in enumerate(path.segments):
            if isinstance(kind, T.StructType) and isinstance(s, str):
                if s not in kind.names:
                    return missing
                col, kind = (F.col(f"`{s}`") if col is None else col.getField(s)), kind[s].dataType
            elif isinstance(kind, T.ArrayType) and isinstance(s, int):
                if s < 0:
                    return missing
                col, kind = F.get(col, F.lit(s)), kind.elementType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(s, str):
                col, kind = F.try_element_at(col, F.lit(s)), kind.valueType
            elif isinstance(kind, T.VariantType):
                at = Path(path.segments[i:]).variant_path()
                return missing if at is None else VariantValue(F.variant_get(col, at, "variant"))
            else:
                return missing
        if col is None:
            return missing
        return VariantValue(col) if isinstance(kind, T.VariantType) else TypedValue(col, kind)
