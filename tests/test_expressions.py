from datetime import date, datetime

from pyspark.sql import functions as F

from moraine.functions import expressions as E


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_json(spark):
    p = '{"a": 3, "b": {"c": "t"}, "s": "x"}'
    assert one(spark, E.json_text("p", "s"), p=p) == "x" and one(spark, E.json_text("p", "b.c"), p=p) == "t"
    assert one(spark, E.json_int("p", "a"), p=p) == 3
    assert one(spark, E.json_int("p", "s"), p=p) is None and one(spark, E.json_int("p", "none", 0), p=p) == 0


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (None,)], "x double")
    assert [r.y for r in df.select(E.to_bigint("x").alias("y")).collect()] == [2, 4, -2, None]


def test_aggregates_skip_nulls(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("y", 0)], "v string, ts long")
    assert tuple(df.agg(E.arg_max("v", "ts"), E.arg_min("v", "ts")).first()) == ("x", "y")
    assert df.where("ts = 2").unionByName(df.where("ts = 1")).agg(E.any_value("v")).first()[0] == "x"
    assert spark.range(4).agg(E.median("id")).first()[0] == 1.5
    assert spark.range(100).agg(E.uniq("id")).first()[0] in range(90, 111)


def test_times(spark):
    ms = 1686176939445
    assert one(spark, E.epoch_ms("m"), m=ms) == datetime(2023, 6, 7, 22, 28, 59, 445000)
    assert one(spark, E.to_epoch_ms(E.epoch_ms("m")), m=ms) == ms
    assert one(spark, E.day_of_ms("m"), m=ms) == "2023-06-07"
    assert one(spark, E.month_start(E.epoch_ms("m")), m=ms) == datetime(2023, 6, 1)
    assert one(spark, E.month(E.epoch_ms("m")), m=ms) == "2023-06" and one(spark, E.day(E.epoch_ms("m")), m=ms) == "2023-06-07"
    assert one(spark, E.parse_month("m"), m="2023-06") == date(2023, 6, 1)
    a = one(spark, E.parse_timestamp("t"), t="01/31/2023 01:00:00 PM")
    assert a == one(spark, E.parse_timestamp("t"), t="2023-01-31 13:00:00 UTC") and a is not None
    assert one(spark, E.parse_timestamp("t"), t="soon") is None


def test_times_in_other_zones(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            ms = 1686110400000
            assert one(spark, E.epoch_ms("m").cast("string"), m=ms) == "2023-06-07 04:00:00" and one(spark, E.day_of_ms("m"), m=ms) == "2023-06-07"
            assert one(spark, E.to_epoch_ms(E.epoch_ms("m")), m=ms) == ms and one(spark, E.month(E.epoch_ms("m")), m=ms) == "2023-06"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_paths(spark):
    assert one(spark, E.from_path("p", "d"), p="/x/_data/u=a/d=2023-06-07/f.parquet") == "2023-06-07"
    assert one(spark, E.from_path("p", "d"), p="/x/_data/ad=1/f.parquet") == ""
