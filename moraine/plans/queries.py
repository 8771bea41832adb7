"""One query for each operator of tables, and the SQL that gives the same from the raw tables.

Each builds tables of its own below the workspace, does what it is named for, and returns a lazy DataFrame of their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import expressions as E
from moraine.functions.schema import SchemaConflict
from moraine.operators import joins, recipes
from moraine.operators.table import MergeTable
from moraine.operators.views import table_function
from moraine.sources.workspace import workspace
from moraine.streaming.sink import TableSink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = {"d": "date_format(ts, 'yyyy-MM-dd')"}
ALL_EVENTS = "SELECT * FROM events"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_table(spark: SparkSession, **options) -> MergeTable:
    return MergeTable(spark, workspace(spark), **{"partitioning": DAY, "sort_order": ["event_type", "ts"]} | options)


def by_month(spark: SparkSession, column: str, **options) -> MergeTable:
    return MergeTable(spark, workspace(spark), {"m": f"date_format({column}, 'yyyy-MM')"}, [column], row_group_size=8192, **options)


def two_halves(t: MergeTable, df: DataFrame, key: str = "event_id") -> MergeTable:
    """Two inserts, so that every partition has two files."""
    t.insert_df(df.where(F.col(key) % 2 == 0))
    t.insert_df(df.where(F.col(key) % 2 == 1))
    return t


def remove_before(t: MergeTable, partition: str) -> None:
    """A call removes a bounded number of files, so it is repeated until nothing is left."""
    while t.remove_partitions(lambda ps: [p for p in ps if p < partition])[0]:
        pass


@query(ALL_EVENTS)
def insert_scan(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read()


@query(ALL_EVENTS)
def insert_opaque_partition(spark, d):
    t = events_table(spark, partitioning=F.lit("unused"))
    t.insert_df(raw(spark, d, "events").withColumn("_partition", F.concat(F.lit("bucket "), (F.col("event_id") % 16).cast("string"))))
    return t.read()


@query(ALL_EVENTS)
def insert_partition_function(spark, d):
    t = events_table(spark, partitioning=lambda row: f"type={row['event_type']}/w={row['ts'].isocalendar()[1]:02d}")
    t.insert_df(raw(spark, d, "events"))
    return t.read()


@query("SELECT *, strftime(ts, '%Y-%m-%d') AS _partition FROM events")
def insert_preserve_partition(spark, d):
    t = events_table(spark, preserve_partition=True, codec="ZSTD")
    t.insert_df(raw(spark, d, "events").withColumn("_partition", E.day("ts")))
    return t.read()


@query(ALL_EVENTS)
def multi_insert_union(spark, d):
    return two_halves(events_table(spark, codec="GZIP"), raw(spark, d, "events")).read()


@query("SELECT * FROM events WHERE event_id % 2 = 0")
def time_travel(spark, d):
    t = events_table(spark)
    e = raw(spark, d, "events")
    t.insert_df(e.where("event_id % 2 = 0"), timestamp=1_000)
    t.insert_df(e.where("event_id % 2 = 1"), timestamp=2_000)
    return t.read(as_of_ms=2_000)


@query("SELECT *, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS doubled FROM events")
def schema_evolution(spark, d):
    t = events_table(spark)
    e = raw(spark, d, "events")
    t.insert_df(e.where("event_id % 2 = 1"))
    t.insert_df(e.where("event_id % 2 = 0").withColumn("doubled", F.col("value") * 2))
    t.merge_all()
    return t.read()


@query(ALL_EVENTS)
def merge_default(spark, d):
    t = two_halves(events_table(spark), raw(spark, d, "events"))
    t.merge()
    t.merge_all()
    return t.read()


@query("SELECT user_id, event_type, count(*)::BIGINT AS cnt, max(ts) AS ts FROM events GROUP BY ALL")
def merge_aggregating(spark, d):
    r = recipes.aggregating(["user_id", "event_type"], {"ts": "max"}, count="cnt")
    t = events_table(spark, merge_query=r.merge, insert_query="select *, 1::bigint as cnt from _rows")
    two_halves(t, raw(spark, d, "events").select("event_id", "user_id", "event_type", "ts")).merge_all()
    return r.finish(t.read())


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def merge_replacing(spark, d):
    r = recipes.replacing(["user_id"], by="ts")
    t = MergeTable(spark, workspace(spark), {"u": "user_id % 8"}, ["user_id"], merge_query=r.merge)
    e = raw(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    for k in range(2):
        t.insert_df(e.where(F.col("event_id") % 2 == k).drop("event_id"))
    t.merge_all()
    return r.finish(t.read())


@query(ALL_EVENTS)
def merge_dedup(spark, d):
    r = recipes.deduplicating(["event_id"])
    t = events_table(spark, merge_query=r.merge)
    t.insert_df(raw(spark, d, "events"))
    t.insert_df(raw(spark, d, "events"))
    t.merge_all()
    return r.finish(t.read())


@query("SELECT user_id, event_type, count(*)::BIGINT AS cnt FROM events GROUP BY ALL")
def materialized_view(spark, d):
    r = recipes.aggregating(["user_id", "event_type"], {}, count="cnt")
    base = events_table(spark)
    top = MergeTable(spark, workspace(spark), {"u": "user_id % 8"}, ["user_id"], insert_query="select user_id, event_type, 1::bigint as cnt from _rows", merge_query="select user_id, event_type, sum(cnt)::bigint as cnt from source_files group by user_id, event_type")
    e = raw(spark, d, "events")
    for k in range(2):
        for t in (base, top):
            t.insert_df(e.where(F.col("event_id") % 2 == k))
    top.merge_all()
    return r.finish(top.read())


@query("SELECT * FROM events WHERE ts >= '2024-01-11'")
def remove_partitions(spark, d):
    t = two_halves(events_table(spark), raw(spark, d, "events"))
    remove_before(t, "d=2024-01-11")
    return t.read()


@query("SELECT * FROM events WHERE ts >= '2024-01-11'")
def remove_then_merge_cleanup(spark, d):
    t = events_table(spark)
    e = raw(spark, d, "events")
    t.insert_df(e.where("event_id % 2 = 0"))
    remove_before(t, "d=2024-01-11")
    t.insert_df(e.where("event_id % 2 = 1 AND ts >= '2024-01-11'"))
    t.merge_all()
    t.cleanup(0)
    t.merge_all()
    t.cleanup(0)
    return t.read()


@query("SELECT * FROM events WHERE NOT (strftime(ts, '%Y-%m-%d') = '2024-01-05' AND event_type = 'error')")
def rewrite_partition(spark, d):
    t = two_halves(events_table(spark), raw(spark, d, "events"))
    t.rewrite_partition("d=2024-01-05", "select * from _rows where event_type != 'error'")
    return t.read()


@query(ALL_EVENTS)
def cleanup_preserves(spark, d):
    t = two_halves(events_table(spark), raw(spark, d, "events"))
    t.merge_all()
    t.cleanup(0)
    return t.read()


@query("SELECT user_id, json_extract_string(props, '$.k') AS page, count(*)::BIGINT AS cnt FROM events GROUP BY ALL")
def json_page_counts(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read().groupBy("user_id", E.json_text("props", "k").alias("page")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"))


@query("SELECT sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS total, sum(coalesce(try_cast(json_extract_string(props, '$.none') AS BIGINT), 0))::BIGINT AS missing FROM events")
def json_int_sum(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read().agg(F.sum(E.json_int("props", "k", 0)).alias("total"), F.sum(E.json_int("props", "none", 0)).alias("missing"))


@query("SELECT count(DISTINCT strftime(ts, '%Y-%m-%d'))::BIGINT AS files, count(*)::BIGINT AS n FROM events")
def count_distinct_files(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read(file_name=True).agg(F.countDistinct("filename").alias("files"), F.count("*").alias("n"))


@query("SELECT true AS within, count(*)::BIGINT AS n FROM events")
def approx_distinct_users(spark, d):
    """Is the approximate number of users within four times its documented error (5 %) of the exact one?"""
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    exact = F.count_distinct("user_id")
    return t.read().agg((F.abs(E.uniq("user_id") - exact) <= F.greatest(F.lit(1), exact * 0.2)).alias("within"), F.count("*").alias("n"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS m, l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY ALL")
def partition_prune_month(spark, d):
    t = by_month(spark, "l_shipdate")
    t.insert_df(raw(spark, d, "lineitem"))
    return t.read(partition_columns=True, partitions=lambda p: "m=1997-01" <= p <= "m=1997-12").where("m BETWEEN '1997-01' AND '1997-12'").groupBy("m", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, 8 AS mnth, count(*)::BIGINT AS n FROM lineitem WHERE month(l_shipdate) = 8 GROUP BY ALL")
def partition_month_filter(spark, d):
    t = by_month(spark, "l_shipdate")
    t.insert_df(raw(spark, d, "lineitem"))
    m = F.month(E.parse_month("m"))
    return t.read(partition_columns=True).where(m == 8).groupBy("l_returnflag", m.alias("mnth")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def count_by_path_month(spark, d):
    t = by_month(spark, "o_orderdate")
    t.insert_df(raw(spark, d, "orders"))
    return t.read(file_name=True).groupBy(E.from_path("filename", "m").alias("m")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS mnth, quantile_cont(round_even(o_totalprice, 0)::BIGINT, 0.5)::DOUBLE AS med_price, avg(round_even(o_totalprice, 0)::BIGINT) AS avg_price FROM orders GROUP BY 1")
def quantile_avg_by_month(spark, d):
    t = by_month(spark, "o_orderdate")
    t.insert_df(raw(spark, d, "orders"))
    price = E.to_bigint("o_totalprice")
    return t.read().groupBy(E.month_start("o_orderdate").alias("mnth")).agg(E.median(price).alias("med_price"), F.avg(price).alias("avg_price")).orderBy(F.desc("mnth"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def count_by_priority(spark, d):
    t = by_month(spark, "o_orderdate")
    t.insert_df(raw(spark, d, "orders"))
    return t.read().groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 30")
def topn_limit(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read().select("event_id", "user_id", "value").orderBy(F.desc("event_id")).limit(30)


@query("SELECT user_id, sum(coalesce(cnt, 1))::BIGINT AS cnt FROM (SELECT user_id, NULL::BIGINT AS cnt FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, 1::BIGINT FROM events WHERE event_id % 2 = 1) GROUP BY user_id")
def seed_union_by_name(spark, d):
    t = events_table(spark)
    e = raw(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    t.insert_df(e.where("event_id % 2 = 0"))
    seed = t.read().withColumn("cnt", F.lit(None).cast("bigint"))
    rest = e.where("event_id % 2 = 1").withColumn("cnt", F.lit(1).cast("bigint"))
    return seed.unionByName(rest, allowMissingColumns=True).groupBy("user_id").agg(F.sum(F.ifnull("cnt", F.lit(1))).cast("bigint").alias("cnt"))


@query("SELECT * FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-08'")
def partition_range_files(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read(files=t.files("d=2024-01-03", "d=2024-01-07"), schema=t.schema())


@query("SELECT * EXCLUDE props, CASE WHEN props IS NOT NULL THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS props FROM events WHERE value IS NOT NULL")
def star_except_to_json(spark, d):
    t = events_table(spark, insert_query="select * except (props), to_json(from_json(props, 'k bigint')) as props from _rows")
    t.insert_df(raw(spark, d, "events"))
    return t.read().where(F.col("value").isNotNull())


@query("SELECT *, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'purchase'")
def hive_columns_scan(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read(partition_columns=True).where("event_type = 'purchase'")


@query(ALL_EVENTS)
def csv_source(spark, d):
    folder = workspace(spark)
    e = raw(spark, d, "events")
    e.withColumn("ts", F.col("ts").cast("string")).write.option("header", True).option("escape", '"').csv(f"{folder}/in")
    t = events_table(spark)
    t.insert_csv(f"{folder}/in", lambda df: df.select(*[F.col(c).cast(e.schema[c].dataType) for c in e.columns]), escape='"')
    return t.read()


@query(ALL_EVENTS)
def json_source(spark, d):
    folder = workspace(spark)
    e = raw(spark, d, "events")
    e.withColumn("ts", F.col("ts").cast("string")).write.json(f"{folder}/in")
    t = events_table(spark)
    t.insert_json(f"{folder}/in", lambda df: df.select(*[F.col(c).cast(e.schema[c].dataType) for c in e.columns]))
    return t.read()


@query(ALL_EVENTS)
def adopt_files(spark, d):
    t = events_table(spark)
    raw(spark, d, "events").withColumn("d", E.day("ts")).write.partitionBy("d").parquet(t.data.full("_data"))
    t.adopt([e.path for e in t.data.list("_data", recursive=True, suffix=".parquet")])
    return t.read()


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, 1::BIGINT AS files FROM events GROUP BY 1")
def snapshot_markers(spark, d):
    t = two_halves(events_table(spark), raw(spark, d, "events"))
    t.merge_all()
    alive = [(m.partition.removeprefix("d="), m.bytes) for m in t.snapshot().alive]
    files = spark.createDataFrame(alive, "day string, bytes long").groupBy("day").agg(F.count("*").alias("files"))
    return t.read().groupBy(E.day("ts").alias("day")).agg(F.count("*").alias("n")).join(files, "day")


@query("SELECT event_type, count(*)::BIGINT AS n, any_value(event_type) AS kind FROM events GROUP BY event_type")
def sql_over_view(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    t.create_view("moraine_events")
    return spark.sql("SELECT event_type, count(user_id) AS n, any_value(event_type, true) AS kind FROM moraine_events GROUP BY event_type, event_type ORDER BY count(event_id) DESC")


@query("SELECT * FROM events")
def log_in_another_root(spark, d):
    t = events_table(spark, log_root=workspace(spark), prefix="tenant")
    t.insert_df(raw(spark, d, "events"))
    t.cleanup(0)
    return t.read()


@query(ALL_EVENTS)
def stream_micro_batch(spark, d):
    t = events_table(spark)
    folder = workspace(spark)
    e = raw(spark, d, "events")
    e.repartition(3).write.parquet(f"{folder}/in")
    sink = TableSink(t, "events", merge_every=2, cleanup_every=0)
    sink.start(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return t.read()


@query("SELECT n_name, count(*)::BIGINT AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_join_snapshots(spark, d):
    orders = by_month(spark, "o_orderdate")
    orders.insert_df(raw(spark, d, "orders"))
    customers = MergeTable(spark, workspace(spark), {"segment": "c_mktsegment"}, ["c_custkey"])
    customers.insert_df(raw(spark, d, "customer"))
    nations = MergeTable(spark, workspace(spark), F.lit("all"), ["n_nationkey"])
    nations.insert_df(raw(spark, d, "nation"))
    j = orders.read().join(customers.read(), F.col("o_custkey") == F.col("c_custkey")).join(nations.read(), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT 'user_id' AS column_name, 'BIGINT' AS have, 'VARCHAR' AS came")
def schema_conflict(spark, d):
    t = events_table(spark)
    e = raw(spark, d, "events")
    t.insert_df(e)
    try:
        t.check(e.withColumn("user_id", F.col("user_id").cast("string")))
    except SchemaConflict as x:
        return spark.createDataFrame([(x.column, x.current, x.new)], "column_name string, have string, came string")
    raise AssertionError("a change of type went unnoticed")


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY CUBE (user_id, event_type)")
def cube_over_snapshot(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read().cube("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-08' GROUP BY event_type")
def table_macro_range(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    table_function(t, "moraine_range")
    return spark.sql("SELECT event_type, count(*) AS n FROM moraine_range(first => 'd=2024-01-03', last => 'd=2024-01-07') GROUP BY event_type")


@query("SELECT event_id, user_id, 'k' AS tag FROM events WHERE len(props) > 8")
def scalar_udf(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    t.create_view("moraine_udf_events")

    @F.pandas_udf("array<string>")
    def keys_of(props: pd.Series) -> pd.Series:
        return props.map(lambda p: [k for k in json.loads(p)] if p else [])

    spark.udf.register("keys_of", keys_of)
    return spark.sql("SELECT event_id, user_id, keys_of(props)[0] AS tag FROM moraine_udf_events WHERE length(props) > :n", args={"n": 8})


@query("SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def window_latest(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.read().withColumn("rank", F.row_number().over(w)).where("rank = 1").select("user_id", "event_type", "ts")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE value > 300")
def set_operations(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    e = t.read()
    users = lambda test: e.where(test).select("user_id")
    return users("event_type = 'click'").intersect(users("event_type = 'purchase'")).subtract(users("value > 300"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer")
def semi_and_anti_joins(spark, d):
    orders = by_month(spark, "o_orderdate")
    orders.insert_df(raw(spark, d, "orders"))
    customers = MergeTable(spark, workspace(spark), {"segment": "c_mktsegment"}, ["c_custkey"])
    customers.insert_df(raw(spark, d, "customer"))
    c, o = customers.read(), orders.read().select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("ordered")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("ordered")))


@query("SELECT n_name, count(s_suppkey)::BIGINT AS suppliers, count(c_custkey)::BIGINT AS customers FROM nation FULL JOIN (SELECT * FROM supplier WHERE s_nationkey % 3 <> 0) AS s ON n_nationkey = s_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 = 0) AS c ON n_nationkey = c_nationkey GROUP BY n_name")
def outer_joins(spark, d):
    suppliers = MergeTable(spark, workspace(spark), {"nation": "s_nationkey"})
    suppliers.insert_df(raw(spark, d, "supplier"))
    customers = MergeTable(spark, workspace(spark), {"segment": "c_mktsegment"}, ["c_custkey"])
    customers.insert_df(raw(spark, d, "customer"))
    n, s, c = raw(spark, d, "nation"), suppliers.read().where("s_nationkey % 3 <> 0"), customers.read().where("c_custkey % 50 = 0")
    j = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "full").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.count("c_custkey").alias("customers"))


@query("SELECT p.event_id, max(c.ts) AS last_click FROM events AS p LEFT JOIN events AS c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def as_of_join(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    e = t.read()
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("ts").alias("last_click")), ["user_id"], "ts", "at").select("event_id", "last_click")


@query("SELECT o_orderpriority, p.band, count(*)::BIGINT AS n FROM orders JOIN (SELECT * FROM (VALUES (0, 50000, 'low'), (50000, 150000, 'middle'), (100000, 1000000, 'high')) AS v(low, high, band)) AS p ON o_totalprice >= p.low AND o_totalprice < p.high GROUP BY ALL")
def range_join(spark, d):
    t = by_month(spark, "o_orderdate")
    t.insert_df(raw(spark, d, "orders"))
    bands = spark.createDataFrame([(0.0, 50000.0, "low"), (50000.0, 150000.0, "middle"), (100000.0, 1000000.0, "high")], "low double, high double, band string")
    return joins.within(t.read(), bands, "o_totalprice", "low", "high", width=50000.0).groupBy("o_orderpriority", "band").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 4 AS shard, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP (event_type, user_id % 4) HAVING count(*) > 100")
def rollup_having(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    return t.read().withColumn("shard", F.col("user_id") % 4).rollup("event_type", "shard").agg(F.count("*").alias("n")).where("n > 100")


@query("SELECT event_type, user_id, count(*)::BIGINT AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    t.create_view("moraine_sets")
    return spark.sql("SELECT event_type, user_id, count(*) AS n FROM moraine_sets GROUP BY GROUPING SETS ((event_type), (user_id), ())")


@query("WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n::BIGINT AS n FROM days WHERE n > (SELECT avg(n) FROM days)")
def cte_and_subquery(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    t.create_view("moraine_cte")
    return spark.sql("WITH days AS (SELECT date_format(ts, 'yyyy-MM-dd') AS day, count(*) AS n FROM moraine_cte GROUP BY 1) SELECT day, n FROM days WHERE n > (SELECT avg(n) FROM days)")


@query("SELECT count(DISTINCT user_id)::BIGINT AS hashes, count(*)::BIGINT AS uuids, 36 AS width FROM events")
def hash_and_uuid(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))
    rows = t.read().select(F.xxhash64("user_id").alias("h"), F.uuid().alias("u"))
    return rows.agg(F.count_distinct("h").alias("hashes"), F.count_distinct("u").alias("uuids"), F.max(F.length("u")).alias("width"))


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def grouped_udaf(spark, d):
    t = events_table(spark)
    t.insert_df(raw(spark, d, "events"))

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return t.read().groupBy("event_type").agg(spread("value").alias("spread"))


@query(ALL_EVENTS)
def stream_with_cleanup(spark, d):
    """Micro-batches with timed merges and cleanups; the table ends with few files and all rows."""
    t = events_table(spark)
    folder = workspace(spark)
    e = raw(spark, d, "events")
    e.repartition(4).write.parquet(f"{folder}/in")
    sink = TableSink(t, "events-cleaned", merge_every=2, cleanup_every=2, min_age_ms=0)
    sink.start(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    if any(not m.alive for m in t.snapshot().markers):
        raise AssertionError("a cleanup left dead files")
    return t.read()
