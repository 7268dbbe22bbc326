import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import scalar as S
from docloom.functions.numbers import number_of, text_number
from docloom.operators.files import Files


def test_numbers(spark):
    texts = ["1", " 1", "1d", "-3.", ".5", "+1E3", "1e400", "NaN", "inf", "-Infinity", "0x1p4", "abc", "", "0x", "1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_number(F.col("t")).alias("n"))
    for row in df.collect():
        assert row["n"] == number_of(row["t"]), row
    assert number_of(True) == 1.0 and number_of(float("nan")) is None and number_of([1]) is None and number_of(10**400) is None
    assert number_of("inf") == math.inf


def test_fnv1a_and_partitions(spark):
    df = spark.createDataFrame([("a",), ("",), ("foobar",), ("é",)], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", S.fnv1a(F.col("s")), S.partition_of(F.col("s"))).collect()}
    assert got["a"][0] == 0xE40C292C and got[""][0] == 0x811C9DC5 and got["foobar"][0] == 0xBF9CF968
    assert all(p == h % 4 for h, p in got.values())


def test_codecs():
    assert S.decode_position_key(S.encode_position_key(5, b"MyKey")) == (5, b"MyKey")
    assert S.decode_location(S.encode_location(0, 0, 12345, 2028)) == (0, 0, 12345, 2028) and len(S.encode_location(1, 2, 3, 4)) == 12
    assert S.decode_table_key(S.encode_table_key(b"v_A")) == b"v_A"
    for value in ("x<y", 1.5, None, {"b": 1, "a": [True]}):
        assert S.decode_field_key(S.encode_field_key("name", "v_A", value, b"r\x1f1")) == ("name", "v_A", value, b"r\x1f1")
    assert S.encode_field_key("f", "l", "<", b"i") == b"F\x1ff\x1fl\x1f\"\\u003c\"\x1fi"


@pytest.mark.parametrize("n,want", [("1", "000001"), ("123456", "123456"), ("1234567", "1234567"), ("", "000000")])
def test_pad_six(spark, n, want):
    assert spark.range(1).select(S.pad_six(F.lit(n))).first()[0] == want


def test_labels_names_and_files(spark, tmp_path):
    assert (S.kind_of_table("v_Person"), S.label_of_table("v_Person"), S.label_of_table("x")) == ("v_", "Person", "")
    assert len(S.random_name(8)) == 8 and S.random_name(8) != S.random_name(8)
    files = Files(spark, str(tmp_path))
    assert files.write_new(files.at("a"), "some text") and not files.write_new(files.at("a"), "other")
    assert files.exists(files.at("a")) and not files.is_dir(files.at("a")) and files.is_dir(files.at()) and not files.exists(files.at("no"))
    assert files.copy(files.at("a"), files.at("b")) == 9 and files.read(files.at("b")) == "some text"


def test_codec_columns(spark):
    row = spark.range(1).select(S.table_key(F.lit("v_A")), S.position_key(F.lit(517), F.lit("Mé")), S.location(F.lit(1), F.lit(65535), F.lit(12345), F.lit(2028))).first()
    assert [bytes(x) for x in row] == [S.encode_table_key(b"v_A"), S.encode_position_key(517, "Mé".encode()), S.encode_location(1, 65535, 12345, 2028)]
