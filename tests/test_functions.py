import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.functions import (
    iso_datetime, iso_time, java_hash, mask, number_rows, percent, render_template, shard_of, truncate_text,
)
from sluice.session import staging_root


def java(text: str) -> int:
    data, value = text.encode("utf-16-be", "surrogatepass"), 0
    for i in range(0, len(data), 2):
        value = (value * 31 + int.from_bytes(data[i:i + 2], "big")) & 0xFFFFFFFF
    return value


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


@pytest.mark.parametrize("text", ["", "abc", "Ünïcødé", "中文", "a😀b", "x" * 300])
def test_java_hash(spark, text):
    assert one(spark, java_hash(F.col("t")), t=text) == java(text)


def test_java_hash_known_value_and_null(spark):
    assert one(spark, java_hash(F.col("t")), t="abc") == 96354
    assert spark.range(1).select(java_hash(F.lit(None).cast("string"))).first()[0] is None
    assert one(spark, shard_of(F.col("t"), 10), t="abc") == 96354 % 10


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=30))
def test_java_hash_property(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(java_hash(F.col("t"))).collect()] == [java(t) for t in texts]


@pytest.mark.parametrize("kind, text, masked", [
    ("GENERAL", "ab", "**"), ("GENERAL", "abc", "a*c"), ("GENERAL", "abcde", "a***e"), ("GENERAL", "abcdef", "ab**ef"),
    ("ID_CARD", "123", "***"), ("ID_CARD", "123456", "12**56"), ("NAME", "Zhang", "Z****"), ("PHONE", "05711234567", "0571*****67"),
    ("TEL", "13912345678", "139****5678"), ("EMAIL", "joe@x.org", "j**@x.org"), ("EMAIL", "none", "none"),
    ("PASSWORD", "abc", "***"), ("BANK_CARD", "1234567890", "1234**7890"), ("GENERAL", "", ""),
])
def test_mask(spark, kind, text, masked):
    assert one(spark, mask(F.col("t"), kind), t=text) == masked


def test_mask_null_and_unknown(spark):
    assert spark.range(1).select(mask(F.lit(None).cast("string"), "GENERAL")).first()[0] is None
    with pytest.raises(ValueError):
        mask(F.col("t"), "NOSE")


@pytest.mark.parametrize("text, shown", [
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02 00:00:00.5", "2024-01-02 00:00:00.5"),
    ("2024-01-02 03:04:10.120000", "2024-01-02 03:04:10.12"), ("2024-01-02 03:04:05.000001", "2024-01-02 03:04:05.000001"),
])
def test_iso_datetime(spark, text, shown):
    assert one(spark, iso_datetime(F.col("t").cast("timestamp_ntz")), t=text) == shown


@pytest.mark.parametrize("micros, shown", [(0, "00:00:00"), (3_600_000_000, "01:00:00"), (86_399_500_000, "23:59:59.5")])
def test_iso_time(spark, micros, shown):
    assert one(spark, iso_time(F.col("m").cast("long")), m=micros) == shown


def test_truncate_text(spark):
    assert one(spark, truncate_text(F.col("t"), 3), t="abcdef") == "abc......[3个字符被截断]"
    assert one(spark, truncate_text(F.col("t"), 6), t="abcdef") == "abcdef"
    assert one(spark, truncate_text(F.col("t"), -1), t="abcdef") == "abcdef"
    assert one(spark, truncate_text(F.col("t"), 0), t="abcdef") is None


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 32), (2, 3), (0, 0), (1, 1)], "a long, b long")
    assert [str(r[0]) for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == ["3.13", "66.67", "None", "100.00"]


@pytest.mark.parametrize("template, text", [
    ("plain", "plain"), ("${a}", "1"), ("x ${ a } y", "x 1 y"), ("${a}${b}", "1"), ("${none}!", "!"), ("cost $5 ${a", "cost $5 ${a"),
    ("${$s}-{a}", "9-{a}"),
])
def test_render_template(spark, template, text):
    params = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"), F.lit("$s"), F.lit("9"))
    assert one(spark, render_template(F.col("t"), params), t=template) == text


def test_number_rows_overall_and_in_groups(spark):
    # one group holds most rows
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    overall = number_rows(df, [F.desc("id")]).collect()
    assert sorted(r["position"] for r in overall) == list(range(1, 5001))
    assert all(r["position"] == 5000 - r["id"] for r in overall)
    seen: dict = {}
    for r in sorted(number_rows(df, ["id"], ["g"]).collect(), key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["position"] == seen[r["g"]]


def test_number_rows_null_group_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    assert sorted((r["id"], r["position"]) for r in number_rows(df, ["id"], ["g"]).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert number_rows(df.filter("id > 9"), ["id"]).count() == 0


def test_staging_uses_the_folder_of_the_session(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_clear_staging(spark):
    import os

    from sluice import session

    other = dict(session._STAGED)
    session._STAGED.clear()
    try:
        staged = session.stage(spark.range(3), "probe")
        path = staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert staged.count() == 3 and os.path.isdir(path)
        assert session.clear_staging(spark) == 1 and not os.path.exists(path) and session.clear_staging(spark) == 0
    finally:
        session._STAGED.update(other)
