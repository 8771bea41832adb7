import random

import pytest

from moraine.functions.schema import SchemaConflict, TableSchema
from moraine.sources.locks import FileLock
from moraine.sources.log import FileMarker, LogStore, LogTombstone, NoSnapshotError, decode, encode, log_info, log_name, partition_of, replay
from moraine.sources.storage import FileStore

S = TableSchema({"ts": "BIGINT", "event": "VARCHAR"})


def test_format_is_stable():
    text, meta = encode(1, 1702822195892, S, [FileMarker("tenant/_data/d=2023-06-07/x.parquet", 1702822195892, 693, 1702822195890)], [LogTombstone("tenant/_log/1702822190000_h.jsonl", 1702822195890)])
    assert text.split("\n") == [
        '{"v": 1, "sch": 1, "f": 3, "t": 1702822195892, "tmb": 2}',
        '{"ts": "BIGINT", "event": "VARCHAR"}',
        '{"p": "tenant/_log/1702822190000_h.jsonl", "t": 1702822195890}',
        '{"p": "tenant/_data/d=2023-06-07/x.parquet", "b": 693, "t": 1702822195892, "tmb": 1702822195890}',
    ]
    log = decode(text)
    assert log.meta == meta and log.schema == S and len(log.files) == len(log.tombstones) == 1
    assert decode(encode(1, 5, S, [])[0]).files == ()


def test_names():
    assert log_info("a/_log/17_m_host.jsonl") == (17, True)
    assert log_info(log_name(17, False, "host")) == (17, False)
    assert partition_of("t/_data/a=1/b=2/x.parquet") == "a=1/b=2"
    assert partition_of("_data/x.parquet") == ""


def test_replay_in_any_order_and_dead_stays_dead():
    logs = [(f"_log/{i}_h.jsonl", decode(encode(1, i, S, files)[0])) for i, files in enumerate([[FileMarker("a", 1, 1), FileMarker("b", 1, 1)], [FileMarker("a", 1, 1, 7)], [FileMarker("a", 1, 1), FileMarker("c", 2, 1)]])]
    want = replay(logs)
    assert {m.path for m in want.alive} == {"b", "c"}
    for _ in range(5):
        random.shuffle(logs)
        assert replay(logs) == want


def test_conflict_between_logs():
    other = TableSchema({"event": "BIGINT"})
    with pytest.raises(SchemaConflict):
        replay([("_log/1_h.jsonl", decode(encode(1, 1, S, [])[0])), ("_log/2_h.jsonl", decode(encode(1, 2, other, [])[0]))])


def test_append_never_overwrites(spark, tmp_path):
    log = LogStore(FileStore(spark, str(tmp_path)), "t", "h")
    with pytest.raises(NoSnapshotError):
        log.snapshot()
    first, _ = log.append(S, [FileMarker("x", 1, 1)], timestamp=100)
    second, meta = log.append(S, [FileMarker("y", 1, 1)], timestamp=100)
    assert first != second and meta.timestamp == 101
    assert {m.path for m in log.snapshot().alive} == {"x", "y"}
    assert {m.path for m in log.snapshot(101).alive} == {"x"}
    with pytest.raises(NoSnapshotError):
        log.snapshot(100)
    with pytest.raises(ValueError):
        LogStore(log.store, "t", "m_x")


def test_many_logs_are_read_by_a_job(spark, tmp_path):
    log = LogStore(FileStore(spark, str(tmp_path)), "", "h")
    for i in range(40):
        log.append(S, [FileMarker(f"f{i}", i, 1)], timestamp=1000 + i)
    again = LogStore(log.store, "", "h")
    assert len(again.snapshot().alive) == 40


def test_logs_are_whole_or_absent(spark, tmp_path):
    log = LogStore(FileStore(spark, str(tmp_path)), "t", "h")
    path, _ = log.append(S, [FileMarker("x", 1, 1)], timestamp=100)
    whole = log.store.read(path)
    for cut in ("", whole.split("\n")[0]):
        with pytest.raises(ValueError):
            decode(cut)
    with pytest.raises(FileExistsError):
        log.store.publish(path, "other")
    assert log.store.read(path) == whole and log.list() == [path]
    log.store.create("t/_log/_new/200_h.jsonl.claim", "")  # of a writer that died
    assert log.append(S, [], timestamp=200)[1].timestamp == 201


def test_a_lock_that_was_taken_over_is_left_alone(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    with FileLock(store, stale_s=0).hold("m"):
        store.delete_many(["_lock/m"])
        store.create("_lock/m", "9999999999.0 somebody")
    assert store.read("_lock/m").endswith("somebody")


def test_lock_excludes(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    with FileLock(store).hold("maintenance"):
        with pytest.raises(TimeoutError):
            with FileLock(store, wait_s=0.3).hold("maintenance"):
                pass
    with FileLock(store, wait_s=0.3).hold("maintenance"):
        pass
