from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators import transforms as tr


def test_normalize_types(spark):
    df = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP'2024-01-02 03:04:05' AS t, 1 AS n, X'00' AS b")
    out = tr.normalize_types(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["timestamp_ntz", "timestamp_ntz", "int", "binary"]
    assert out.first()["d"] == datetime(2024, 1, 2)


def test_format_change_times(spark):
    df = spark.createDataFrame(
        [(19723, 3_723_000_000, datetime(2024, 7, 1, 12, 0, 0, 500000), datetime(2024, 7, 1, 12), date(2024, 2, 29))],
        "d int, t long, dt timestamp_ntz, ts timestamp_ntz, dd date",
    )
    kinds = {"d": "DATE", "t": "TIME", "dt": "DATETIME", "ts": "TIMESTAMP", "dd": "DATE"}
    out = tr.format_change_times(df, kinds, "America/New_York").first()  # summer time
    assert tuple(out) == ("2024-01-01", "01:02:03", "2024-07-01 12:00:00.5", "2024-07-01 08:00:00", "2024-02-29")
    winter = spark.createDataFrame([(datetime(2024, 1, 1, 12),)], "ts timestamp_ntz")
    assert tr.format_change_times(winter, {"ts": "TIMESTAMP"}, "America/New_York").first()[0] == "2024-01-01 07:00:00"
    with pytest.raises(ValueError):
        tr.format_change_times(df, {"d": "YEAR"})


def test_decode_binary(spark):
    df = spark.createDataFrame([("AAE=", b"x"), (None, None)], "a string, b binary")
    out = tr.decode_binary(df, ["a", "b"]).collect()
    assert bytes(out[0]["a"]) == b"\x00\x01" and bytes(out[0]["b"]) == b"x" and out[1]["a"] is None


def test_double_to_decimal(spark):
    df = spark.createDataFrame([(0.1,), (1e20,), (123.456,), (float("nan"),), (None,)], "v double")
    out = [r[0] for r in tr.double_to_decimal(df, ["v"], 10, 2).collect()]
    assert out == [Decimal("0.10"), None, Decimal("123.46"), None, None]


DOC = '''{"_id":{"$oid":"5f"},"n":{"$numberLong":"12"},"price":{"$numberDecimal":"1.50"},"bin":{"$binary":"QQ=="},
 "at":{"$date":0},"obj":{"x":{"$oid":"in"},"y":2},"arr":[{"$oid":"e1"},"e2",3],"two":{"$oid":"a","$date":1},"f":1.5,"i":7,
 "b":true,"text":"{\\"$oid\\":\\"no\\"}","nul":null}'''


def test_normalize_document(spark):
    schema = (
        "_id string, n bigint, price decimal(5,2), bin string, at timestamp_ntz, obj struct<x: string, y: int>, arr array<string>, "
        "two string, f double, i int, b boolean, text string, nul string, gone int"
    )
    df = spark.createDataFrame([(DOC,), ("not json",), (None,)], "d string")
    out = [r["d"] for r in tr.normalize_document(df, "d", schema, "+08:00").collect()]
    got = out[0]
    assert got["_id"] == "5f" and got["n"] == 12 and got["price"] == Decimal("1.50") and got["bin"] == "QQ=="
    assert got["at"] == datetime(1970, 1, 1, 8) and tuple(got["obj"]) == ("in", 2) and got["arr"] == ["e1", "e2", "3"]
    assert got["two"] == '{"$date":1,"$oid":"a"}' and (got["f"], got["i"], got["b"]) == (1.5, 7, True)
    assert got["text"] == '{"$oid":"no"}' and got["nul"] is None and got["gone"] is None
    assert out[1] is None and out[2] is None


def test_drop_null_fields(spark):
    df = spark.createDataFrame([((1, None, "x"),), ((None, None, None),), (None,)], "s struct<a: int, b: int, c: string>")
    assert [r["s"] for r in tr.drop_null_fields(df, "s").collect()] == [{"a": "1", "c": "x"}, {}, None]


def test_filter_rows(spark):
    df = spark.createDataFrame([(1, (5, "a")), (2, (None, "b")), (3, None)], "id int, after struct<v: int, id: string>")
    assert [r["id"] for r in tr.filter_rows(df.select("id", "after"), "v > 1", "after").collect()] == [1]
    assert [r["id"] for r in tr.filter_rows(df, "id > 1").collect()] == [2, 3]


def test_map_rows(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    out = tr.map_rows(df, {"compute": {"c": "concat(a, b)"}, "cast": {"a": "int"}, "rename": {"b": "name"}, "drop": ["zzz"]})
    assert out.first().asDict() == {"a": 1, "name": "x", "c": "1x"}
    bad = spark.createDataFrame([("q",)], "a string")
    assert tr.map_rows(bad, {"cast": {"a": "int"}}).first()[0] is None


@pytest.mark.parametrize("text", [
    "java_method('java.lang.Runtime', 'x')", "`reflect`('a', 'b')", "upper(reflect('a'))", "concat(r'\\', reflect('java.lang.System', 'getProperty', 'java.version'), '')", "(select 1)", "a in (select 1)", "upper(",
    "a; drop table t", "reflect ('x')", "system.builtin.java_method('x')",
])
def test_safe_expr_refuses(spark, text):
    with pytest.raises(ValueError):
        tr.safe_expr(spark.createDataFrame([("x",)], "a string"), "o", text)


def test_safe_expr(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert tr.safe_expr(df, "o", "concat(upper(a), 'java_method(')").first()["o"] == "Xjava_method("


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Id int, NAME int, name int")
    out = tr.resolve_columns(df, ["ID", "Name"])
    assert out.columns == ["ID", "Name"] and tuple(out.first()) == (1, 3)
    exact = tr.resolve_columns(df, ["name"], ignore_case=False)
    assert exact.columns == ["Id", "NAME", "name"]


def test_align_to_table(spark):
    target = spark.createDataFrame([], "b string, a bigint, c double").schema
    out = tr.align_to_table(spark.createDataFrame([(1, "x", 0)], "a int, b string, z int"), target)
    assert out.schema.names == ["b", "a", "c"] and tuple(out.first()) == ("x", 1, None)


def test_preview(spark):
    df = spark.createDataFrame([(i, "abcdef") for i in range(5)], "i int, t string")
    assert [tuple(r) for r in tr.preview(df, 2, 3, ["i"]).collect()] == [(0, "abc......[3个字符被截断]"), (1, "abc......[3个字符被截断]")]
    assert tr.preview(df, -1, -1).count() == 5 and tr.preview(df, None, None).first()["t"] == "abcdef"
    assert tuple(tr.preview(df, 1, 0).first()) == (None, None)


def test_row_transforms_do_not_shuffle(spark, plan):
    df = spark.range(10).select(F.col("id").cast("string").alias("a"), F.struct("id").alias("after"))
    out = tr.mask_columns(tr.filter_rows(df, "id > 3", "after"), {"a": "GENERAL"})
    text = plan(tr.drop_null_fields(out, "after"))
    assert "Exchange" not in text and "Python" not in text
