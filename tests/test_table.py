import json
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.functions.expressions import day_of_ms_sql
from moraine.functions.schema import SchemaConflict
from moraine.operators import recipes
from moraine.operators.partitioning import Partitioning
from moraine.operators.queries import rename_view, row_wise
from moraine.operators.table import MergeTable
from moraine.operators.views import table_function
from moraine.sources import outputs
from moraine.sources.log import NoSnapshotError
from moraine.streaming.sink import TableSink

ROWS = [
    {"ts": 1709251199000, "event": "opened", "user_id": "a", "properties": json.dumps({"place": "north", "n": 4})},
    {"ts": 1707004800500, "event": "opened", "user_id": "b", "properties": json.dumps({"place": "north", "n": 5})},
    {"ts": 1709164800000, "event": "sold", "user_id": "a", "properties": json.dumps({"place": "south", "n": 6})},
]
DAY = {"shop": "'main'", "d": day_of_ms_sql("ts")}


def table(spark, tmp_path, **options):
    return MergeTable(spark, str(tmp_path), **{"partitioning": DAY, "sort_order": ["event", "ts"], "codec": "ZSTD"} | options)


def users(t):
    return {r.user_id: r["count"] for r in t.read().groupBy("user_id").count().collect()}


def test_a_year_of_inserts(spark, tmp_path):
    t = table(spark, tmp_path / "data", log_root=str(tmp_path / "log"), prefix="tenant")
    early, late = "shop=main/d=2024-02-04", "shop=main/d=2024-02-29"

    def state():
        s = t.snapshot()
        return len(s.logs), len(s.markers), len(s.alive)

    made = t.insert(ROWS)
    assert sorted(m.partition for m in made) == [early, late] and users(t) == {"a": 2, "b": 1}
    assert t.schema().pairs() == [("ts", "BIGINT"), ("event", "VARCHAR"), ("user_id", "VARCHAR"), ("properties", "VARCHAR")]
    # Removal first, then rows that come late for the removed partition.
    log, _, n = t.remove_partitions(lambda ps: [p for p in ps if p == early])
    assert log and n == 1 and users(t) == {"a": 2} and state() == (2, 2, 1)
    for _ in range(6):
        t.insert(ROWS)
    assert users(t) == {"a": 14, "b": 6} and state() == (8, 14, 13)
    log, _, new = t.rewrite_partition(late, "select * from _rows where event <> 'sold'")
    assert len(new) == 7 and users(t) == {"a": 7, "b": 6}
    m = t.merge(max_file_count=3)
    assert len(m.merged) == 3 and m.partition == late and m.log.rsplit("/", 1)[1].split("_")[1] == "m"
    assert users(t) == {"a": 7, "b": 6} and state()[2] == 11
    gone = t.cleanup(0).deleted_data
    assert len(gone) == len(set(gone)) == 11 and state()[1:] == (11, 11) and users(t) == {"a": 7, "b": 6}
    assert {len(x.merged) for x in t.merge_all(max_file_count=4)} <= {2, 3, 4}
    assert state()[2] == 2 and users(t) == {"a": 7, "b": 6} and t.merge().log is None and t.merge_all() == []
    t.cleanup(0)
    assert state() == (1, 2, 2) and users(t) == {"a": 7, "b": 6}
    assert not list((tmp_path / "data").rglob("_staging/*")) and not list((tmp_path / "log").rglob("*.claim"))


def test_thousands_of_files_merge_to_the_end(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=F.lit("one"), sort_order=[])
    spark.range(2000).repartition(2000).write.parquet(str(tmp_path / "_data" / "one"))
    t.adopt([e.path for e in t.data.list("_data", recursive=True, suffix=".parquet")])
    before = len(t.snapshot().alive)
    done = t.merge_all(max_file_size=1 << 30, max_file_count=500)
    assert before > 1000 and len(done) > 2 and len(t.snapshot().alive) == 1 and t.read().agg(F.sum("id")).first()[0] == 1999 * 1000


def test_adopted_files_must_agree(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=F.lit("one"), sort_order=[])
    spark.range(3).write.parquet(str(tmp_path / "_data" / "a"))
    spark.range(3).selectExpr("cast(id as string) id").write.parquet(str(tmp_path / "_data" / "b"))
    with pytest.raises(SchemaConflict):
        t.adopt([e.path for e in t.data.list("_data", recursive=True, suffix=".parquet")])


def test_days_do_not_follow_the_session(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for k, z in enumerate(("UTC", "America/Los_Angeles", "Pacific/Kiritimati")):
            spark.conf.set("spark.sql.session.timeZone", z)
            t = table(spark, tmp_path / str(k))
            t.insert(ROWS)
            found.append(t.partitions())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == [["shop=main/d=2024-02-04", "shop=main/d=2024-02-29"]] * 3


def test_maintenance_of_two_hosts_does_not_overlap(spark, tmp_path):
    one, two = (table(spark, tmp_path, host=h, partitioning="user_id") for h in ("x", "y"))
    for _ in range(3):
        one.insert(ROWS)
    two.lock.wait_s = 0.3
    with one.lock.hold("maintenance"):
        with pytest.raises(TimeoutError):
            two.merge_all()
    with ThreadPoolExecutor(2) as pool:
        two.lock.wait_s = 60
        list(pool.map(lambda t: t.merge_all(), (one, two)))
    assert one.read().count() == 9


def test_as_of_and_range_joins(spark):
    from moraine.operators import joins

    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 5), (5, "a", None), (6, "a", 7)], "i long, k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 10, "w"), (None, 1, "n")], "k string, at long, v string")
    got = {r.i: (r["at"], r.v) for r in joins.as_of(left, right, ["k"], "t", "at").collect()}
    assert got == {1: (5, "z"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (5, "z")}
    spans = spark.createDataFrame([("p", 0.0, 10.0), ("q", 9.5, 31.0), ("r", 3.0, 3.0)], "name string, low double, high double")
    points = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,), (30.9,), (31.0,), (None,)], "x double")
    assert sorted((r.x, r.name) for r in joins.within(points, spans, "x", "low", "high", 10.0).collect()) == [(0.0, "p"), (9.9, "p"), (9.9, "q"), (10.0, "q"), (30.9, "q")]


def test_empty_table(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.insert([]) == []
    for call in (t.snapshot, t.read, t.schema):
        with pytest.raises(NoSnapshotError):
            call()
    assert t.merge().log is None and t.merge_all() == [] and t.cleanup(0).deleted_data == ()
    t.insert(ROWS)
    t.remove_partitions(lambda ps: ps)
    assert t.read().count() == 0 and t.read().columns == ["ts", "event", "user_id", "properties"]
    assert t.rewrite_partition("shop=main/d=2024-02-04", "select * from _rows")[2] == []


def test_rows_take_all_keys_and_stay_as_they_are(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=F.lit("all"), sort_order=[])
    rows = [{"a": 1, "_partition": "x/y z"}, {"a": 2, "b": "w", "_partition": "p=1"}, {"a": None, "c": None, "_partition": "p=1"}]
    kept = [dict(r) for r in rows]
    made = t.insert(rows)
    assert rows == kept and sorted(m.partition for m in made) == ["p=1", "x/y z"]
    assert t.schema().pairs() == [("a", "BIGINT"), ("b", "VARCHAR")]
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, None), (2, "w"), (None, None)]


def test_partition_values_survive(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=Partitioning({"u": "user", "n": "n"}, {"n": "int"}), sort_order=[])
    values = ["001", "a/b", "x=y", "50%", "sp ace:", None, "é"]
    t.insert([{"user": v, "n": i, "v": i} for i, v in enumerate(values)])
    t2 = MergeTable(spark, str(tmp_path), Partitioning({"uu": "user"}))
    assert t2.read().count() == len(values)
    t3 = MergeTable(spark, str(tmp_path / "other"), {"uu": "user"})
    t3.insert([{"user": v, "v": i} for i, v in enumerate(values)])
    assert sorted(map(str, [r.uu for r in t3.read(partition_columns=True).collect()])) == sorted(map(str, values))


def test_python_partition_function(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=lambda r: f"u={r['user_id']}/d={datetime.fromtimestamp(r['ts'] / 1000, UTC):%Y-%m-%d}")
    t.insert(ROWS)
    assert t.partitions() == ["u=a/d=2024-02-29", "u=b/d=2024-02-04"]


def test_files_are_sorted_coded_and_grouped(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=F.lit("one"), sort_order=["k"], row_group_size=1000)
    [m] = t.insert_df(spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")))
    f = pq.ParquetFile(tmp_path / m.path)
    assert f.metadata.num_row_groups == 5 and f.metadata.row_group(0).column(0).compression == "ZSTD"
    ks = f.read()["k"].to_pylist()
    assert ks == sorted(ks) and m.bytes == (tmp_path / m.path).stat().st_size
    with pytest.raises(ValueError):
        table(spark, tmp_path, codec="lzo")


def test_time_travel_and_evolution(spark, tmp_path):
    t = table(spark, tmp_path, partitioning=F.lit("p"), sort_order=[])
    t.insert_df(spark.createDataFrame([(1,)], "a long"), timestamp=10)
    t.insert_df(spark.createDataFrame([(2, "x")], "a long, b string"), timestamp=20)
    assert [tuple(r) for r in t.read(as_of_ms=20).collect()] == [(1,)]
    assert sorted(map(tuple, t.read().collect())) == [(1, None), (2, "x")]
    t.merge_all()
    assert sorted(map(tuple, t.read().collect())) == [(1, None), (2, "x")]
    with pytest.raises(SchemaConflict):
        t.insert_df(spark.createDataFrame([("x",)], "a string"), check=True)
    assert t.check(spark.createDataFrame([(1.0,)], "c double")).pairs() == [("c", "DOUBLE")]


def test_merge_policy(spark, tmp_path):
    t = table(spark, tmp_path, partitioning="p", sort_order=[])
    for p, n in (("few", 2), ("many", 4)):
        for i in range(n):
            t.insert([{"p": p, "v": i}])
    assert t.merge(asc=True).partition == "few"
    m = t.merge(max_file_count=1)
    assert m.partition == "many" and len(m.merged) == 2
    assert t.merge(max_file_size=1).log is None
    before = len(t.snapshot().logs)
    assert {x.partition for x in t.merge_all()} == {"many"}
    assert len(t.snapshot().logs) == before + 1 and t.read().count() == 6


def test_removal_loses_nothing_else_and_dead_data_stays_dead(spark, tmp_path):
    t = table(spark, tmp_path, partitioning="p", sort_order=[])
    t.insert([{"p": "1", "v": 1}, {"p": "2", "v": 2}])
    t.remove_partitions(lambda ps: ["1"])
    t.insert([{"p": "2", "v": 3}])
    t.merge_all()
    assert sorted(r.v for r in t.read().collect()) == [2, 3]
    t.cleanup(0)
    assert sorted(r.v for r in t.read().collect()) == [2, 3]
    t.insert([{"p": "3", "v": 4}])
    assert t.remove_partitions(lambda ps: ps, max_files=1)[2] == 1


def test_cleanup_waits_for_readers(spark, tmp_path):
    t = table(spark, tmp_path, partitioning="p", sort_order=[])
    for i in range(2):
        t.insert([{"p": "1", "v": i}])
    old = t.read()
    t.merge_all()
    assert t.cleanup(3_600_000).deleted_data == () and old.count() == 2
    assert len(t.cleanup(0).deleted_data) == 2
    assert t.cleanup(0) == type(t.cleanup(0))()


def test_custom_queries(spark, tmp_path):
    t = table(spark, tmp_path, partitioning="user_id", insert_query="select *, 1::BIGINT as cnt from _rows -- _rows", merge_query="select user_id, max(ts) ts, sum(cnt)::BIGINT cnt, any_value(event) event, any_value(properties) properties from source_files group by user_id")
    assert t.get_schema(ROWS)["cnt"] == "BIGINT"
    for _ in range(2):
        t.insert(ROWS)
    t.merge_all()
    assert t.read().count() == 2 and {r.user_id: r.cnt for r in t.read().collect()} == {"a": 4, "b": 2}
    # A query over several rows sees one partition at a time.
    u = table(spark, tmp_path / "u", partitioning="user_id", sort_order=[], insert_query="select user_id, count(*) n from _rows group by user_id union all select 'all', count(*) from _rows")
    u.insert(ROWS)
    assert Counter(map(tuple, u.read().collect())) == Counter([("a", 2), ("all", 2), ("b", 1), ("all", 1)])
    assert rename_view("select '_rows', n_rows from _rows", "_rows", "v") == "select '_rows', n_rows from v"
    assert row_wise(spark.range(3).selectExpr("id + 1")) and not row_wise(spark.range(3).distinct())


def test_rewrite_rejects_new_columns_and_drops_null_rows(spark, tmp_path):
    t = table(spark, tmp_path, partitioning="p", sort_order=[])
    t.insert([{"p": "1", "v": 1}, {"p": "1", "v": None}, {"p": "1", "v": 2}])
    t.insert([{"p": "1", "v": 2}])
    with pytest.raises(ValueError):
        t.rewrite_partition("1", "select *, 1 as new from _rows")
    t.rewrite_partition("1", "select * from _rows where v != 1")
    assert sorted(r.v for r in t.read().collect()) == [2, 2]
    t.rewrite_partition("1", "select distinct * from _rows", whole=True)
    assert t.read().count() == 1


def test_recipes(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, ts long, v string")
    r = recipes.replacing(["k"], "ts")
    assert sorted(map(tuple, r.finish(e).collect())) == [("a", 2, "x"), ("b", 1, "z")]
    r = recipes.aggregating(["k"], {"ts": "sum"}, count="n")
    assert sorted(map(tuple, r.finish(r.insert(e)).collect())) == [("a", 3, 2), ("b", 1, 1)]
    assert recipes.deduplicating(["k"]).finish(e).count() == 2


def test_scans_prune(spark, tmp_path):
    t = table(spark, tmp_path)
    t.insert(ROWS)
    df = t.read(partition_columns=True).where("d = '2024-02-04' AND event = 'opened'").select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and "PushedFilters: [IsNotNull(event)" in plan and "properties" not in plan.split("ReadSchema")[1]
    assert [r.user_id for r in df.collect()] == ["b"]
    assert len(t.read(partitions=lambda p: "2024-02-04" in p).inputFiles()) == 1
    assert len(t.files("shop=main/d=2024-02-10", "shop=main/d=2025")) == 1
    assert t.every_file().count() == 3


def test_stream_delivers_once(spark, tmp_path):
    raw, view = (MergeTable(spark, str(tmp_path / n), "user_id", host="h") for n in ("raw", "view"))
    sink = TableSink([raw, view], "s", merge_every=2, cleanup_every=2, min_age_ms=0)
    df = spark.createDataFrame(ROWS)
    for batch in (0, 0, 1, 1, 2):
        sink(df, batch)
    TableSink([raw, view], "s")(df, 2)
    assert raw.read().count() == view.read().count() == 9


def test_table_function(spark, tmp_path):
    t = table(spark, tmp_path)
    t.insert(ROWS)
    table_function(t, "lifecycle")
    q = spark.sql("SELECT user_id, count(*) AS n FROM lifecycle(first => 'shop=main/d=2024-02-10') GROUP BY 1").collect()
    assert [tuple(r) for r in q] == [("a", 2)]
    assert spark.sql("SELECT * FROM lifecycle()").count() == 3
    assert spark.sql("SELECT * FROM lifecycle(last => :d)", args={"d": "shop=main/d=2024-02-10"}).count() == 1


def test_outputs(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    with pytest.raises(ValueError):
        outputs.to_csv(df.union(df), rows=1)
    assert outputs.to_csv(df) == "a,b\n1,x\n" and "|1  |x  |" in outputs.to_text(df)
    outputs.to_nothing(df)


ops = st.lists(st.one_of(st.tuples(st.just("insert"), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), min_size=1, max_size=4)), st.tuples(st.just("merge")), st.tuples(st.just("merge_all")), st.tuples(st.just("cleanup")), st.tuples(st.just("remove"), st.integers(0, 2)), st.tuples(st.just("rewrite"), st.integers(0, 2), st.integers(0, 9))), min_size=2, max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops=ops)
def test_any_sequence_matches_a_list(spark, tmp_path_factory, ops):
    t = MergeTable(spark, str(tmp_path_factory.mktemp("t")), "concat('p', p)", ["v"])
    model: list[tuple[int, int]] = []
    t.insert([{"p": 0, "v": 0}])
    model.append((0, 0))
    for op, *args in ops:
        if op == "insert":
            t.insert([{"p": p, "v": v} for p, v in args[0]])
            model += args[0]
        elif op == "merge":
            t.merge(max_file_count=2)
        elif op == "merge_all":
            t.merge_all()
        elif op == "cleanup":
            t.cleanup(0)
        elif op == "remove":
            t.remove_partitions(lambda ps, p=f"p{args[0]}": [p])
            model = [x for x in model if x[0] != args[0]]
        else:
            t.rewrite_partition(f"p{args[0]}", f"select * from _rows where v <> {args[1]}")
            model = [x for x in model if x != (args[0], args[1])]
    assert Counter((r.p, r.v) for r in t.read().collect()) == Counter(model)
