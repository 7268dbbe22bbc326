"""Hashes, keys and labels, as columns and as codecs."""

from __future__ import annotations

import json
import secrets
import string
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
VERTEX, EDGE = "v_", "e_"


def kind_of_table(name: Column | str):
    """The two-character prefix of a table name, as a column or of a text."""
    return name[:2] if isinstance(name, str) else F.substring(name, 1, 2)


def label_of_table(name: Column | str):
    return name[2:] if isinstance(name, str) else F.substring(name, 3, 1 << 30)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes as a long, in [0, 2^32)."""
    h = F.encode(text, "UTF-8")
    at = F.sequence(F.lit(1), F.octet_length(text))
    step = lambda acc, i: (acc.bitwiseXOR(F.conv(F.hex(F.substring(h, i, F.lit(1))), 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.octet_length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("long"), step))


def partition_of(row_id: Column, n: int = 4) -> Column:
    """The hash partition of an id: FNV-1a modulo n, kept to a byte."""
    return F.pmod(F.pmod(fnv1a(row_id), F.lit(n)), F.lit(256)).cast("int")


def pad_six(text: Column) -> Column:
    """Zeros before a text up to six characters; longer ones stay whole."""
    return F.when(F.char_length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def field_key(field: Column, label: Column, value: Column, row_id: Column) -> Column:
    return F.concat_ws(SEPARATOR, F.lit("F"), field, label, value, row_id)


def reverse_key(label: Column, field: Column, row_id: Column) -> Column:
    return F.concat_ws(SEPARATOR, F.lit("R"), label, field, row_id)


def field_key_parts(key: Column) -> Column:
    """struct(field, label, value, row_id); the value is the JSON text that was put in."""
    p = F.split(key, SEPARATOR, 5)
    return F.struct(p[1].alias("field"), p[2].alias("label"), p[3].alias("value"), p[4].alias("row_id"))


def encode_field_key(field: str, label: str, value: object, row_id: bytes) -> bytes:
    text = json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return SEPARATOR.encode().join([b"F", field.encode(), label.encode(), text.encode(), row_id])


def decode_field_key(key: bytes) -> tuple[str, str, object, bytes]:
    _, field, label, value, row_id = key.split(SEPARATOR.encode(), 4)
    return field.decode(), label.decode(), json.loads(value), row_id


def encode_table_key(name: bytes) -> bytes:
    return b"T" + name


def decode_table_key(key: bytes) -> bytes:
    return key[1:]


def encode_position_key(table: int, row_id: bytes) -> bytes:
    return b"P" + struct.pack("<H", table) + row_id


def decode_position_key(key: bytes) -> tuple[int, bytes]:
    return struct.unpack_from("<H", key, 1)[0], key[3:]


def encode_location(table: int, section: int, offset: int, size: int) -> bytes:
    return struct.pack("<HHII", table, section, offset, size)


def decode_location(data: bytes) -> tuple[int, int, int, int]:
    return struct.unpack("<HHII", data)


def random_name(n: int) -> str:
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(n))


def _little_endian(n: Column, size: int) -> Column:
    """The hex digits of a whole number's lowest bytes, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])


def table_key(name: Column) -> Column:
    """The key of a table's name, as bytes."""
    return F.encode(F.concat(F.lit("T"), name), "UTF-8")


def position_key(table: Column, row_id: Column) -> Column:
    """The key of a row in a numbered table, as bytes."""
    return F.unhex(F.concat(F.lit("50"), _little_endian(table, 2), F.hex(F.encode(row_id, "UTF-8"))))


def location(table: Column, section: Column, offset: Column, size: Column) -> Column:
    """The twelve bytes of a row's location."""
    return F.unhex(F.concat(_little_endian(table, 2), _little_endian(section, 2), _little_endian(offset, 4), _little_endian(size, 4)))
