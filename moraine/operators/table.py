"""A table of Parquet files with a log: inserts, snapshots, merges, cleanup, removal and rewriting of partitions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions.schema import TableSchema, spark_type
from moraine.operators import queries
from moraine.operators.partitioning import GIVEN, PART, Partitioning, from_folder
from moraine.operators.queries import Query
from moraine.sources.locks import FileLock
from moraine.sources.log import FileMarker, LogMeta, LogStore, LogTombstone, NoSnapshotError, Snapshot, now_ms, partition_of
from moraine.sources.storage import FileStore

CODECS = ("UNCOMPRESSED", "SNAPPY", "ZSTD", "GZIP")
#: Files whose footers one job reads.
ADOPTED = 1000


@dataclass(frozen=True)
class Merge:
    """What one merge did; log is None if there was nothing to merge."""

    log: str | None = None
    marker: FileMarker | None = None
    partition: str | None = None
    merged: tuple[FileMarker, ...] = ()
    meta: LogMeta | None = None


@dataclass(frozen=True)
class Cleanup:
    cleaned_logs: tuple[str, ...] = ()
    deleted_logs: tuple[str, ...] = ()
    deleted_data: tuple[str, ...] = ()


class MergeTable:
    """A table below `root`/`prefix`.

    partitioning: see Partitioning; sort_order: columns that rows of a file are sorted by; merge_query and insert_query: see
    queries (`source_files` and `_rows` are the views that SQL text names); log_root: another root for the log;
    insert queries apply to one partition's batch at a time, merge queries to the files merged. lock: what keeps the maintenance
    of several processes apart, a lock file by default (locks.NoLock where the store cannot create files exclusively).
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        partitioning: Partitioning | dict | Column | str | Callable[[dict], str],
        sort_order: Iterable[str] = (),
        prefix: str = "",
        host: str = "local",
        merge_query: Query | None = None,
        insert_query: Query | None = None,
        row_group_size: int = 122_880,
        codec: str = "SNAPPY",
        preserve_partition: bool = False,
        log_root: str | None = None,
        lock=None,
        threads: int = 8,
    ):
        if codec.upper() not in CODECS:
            raise ValueError(f"codec must be one of {', '.join(CODECS)}")
        self.spark = spark
        self.partitioning = partitioning if isinstance(partitioning, Partitioning) else Partitioning(partitioning)
        self.sort_order, self.prefix = list(sort_order), prefix.strip("/")
        self.merge_query, self.insert_query = merge_query, insert_query
        self.row_group_size, self.codec, self.preserve_partition, self.threads = row_group_size, codec.upper(), preserve_partition, threads
        self.data = FileStore(spark, root)
        self.log = LogStore(FileStore(spark, log_root) if log_root else self.data, self.prefix, host)
        self.lock = lock or FileLock(self.log.store, self.prefix)

    # Reading

    def snapshot(self, as_of_ms: int | None = None) -> Snapshot:
        """Everything logged so far, or what was logged before as_of_ms. Travel reaches back to the last cleanup."""
        return self.log.snapshot(as_of_ms)

    def schema(self) -> TableSchema:
        return self.snapshot().schema

    def files(self, first: str | None = None, last: str | None = None, as_of_ms: int | None = None) -> list[FileMarker]:
        """Alive files of the partitions from `first` to `last` (both included, compared as strings)."""
        return [m for m in self.snapshot(as_of_ms).alive if (first is None or m.partition >= first) and (last is None or m.partition <= last)]

    def partitions(self, as_of_ms: int | None = None) -> list[str]:
        return sorted({m.partition for m in self.snapshot(as_of_ms).alive})

    def read(self, as_of_ms: int | None = None, partitions: Callable[[str], bool] | None = None, partition_columns: bool = False, file_name: bool = False, files: Iterable[FileMarker] | None = None, schema: TableSchema | None = None) -> DataFrame:
        """The rows of a snapshot.

        partitions: a test of partition strings, applied to the log before Spark sees any file. partition_columns: adds the Hive
        columns, which filters on them prune by. Columns a file lacks are null. An empty snapshot gives no rows.
        """
        if files is None or schema is None:
            snap = self.snapshot(as_of_ms)
            files = snap.alive if files is None else files
            schema = schema or snap.schema
        paths = [self.data.full(m.path) for m in files if partitions is None or partitions(m.partition)]
        struct = schema.struct()
        if not struct.fields:
            return self.spark.createDataFrame([], struct)
        reader = self.spark.read
        if partition_columns and self.partitioning.hive:
            own = set(schema.columns())
            extra = [f for f in self.partitioning.read_schema().fields if f.name not in own]
            struct = T.StructType(struct.fields + extra)
            reader = reader.option("basePath", self.data.full(self._below("_data")))
        else:
            reader = reader.option("recursiveFileLookup", True)
        df = reader.schema(struct).parquet(*paths) if paths else self.spark.createDataFrame([], struct)
        if file_name and paths:
            df = df.withColumn("filename", F.col("_metadata.file_path"))
        return df

    def create_view(self, name: str, **options) -> DataFrame:
        """A temporary view of a snapshot, for SQL."""
        df = self.read(**options)
        df.createOrReplaceTempView(name)
        return df

    def every_file(self) -> DataFrame:
        """All Parquet files below the table, dead ones too: for diagnosis only."""
        return self.spark.read.schema(self.schema().struct()).option("recursiveFileLookup", True).parquet(self.data.full(self._below("_data")))

    # Inserting

    def rows(self, rows: list[dict]) -> DataFrame:
        """A DataFrame of dictionaries with the union of their keys; the dictionaries stay as they are."""
        keys = list(dict.fromkeys(k for r in rows for k in r))
        table = pa.table({k: pa.array([r.get(k) for r in rows]) for k in keys})
        return self.spark.createDataFrame(table)

    def get_schema(self, rows: list[dict] | DataFrame) -> TableSchema:
        """The schema that inserting rows would log; runs no job."""
        df = self.rows(rows) if isinstance(rows, list) else rows
        return TableSchema.of(queries.apply(self.insert_query, self._without_given(df), "_rows").schema)

    def check(self, rows: list[dict] | DataFrame) -> TableSchema:
        """get_schema(rows), after comparing it with the table's: raises SchemaConflict before anything is written."""
        new = self.get_schema(rows)
        try:
            TableSchema(dict(self.schema().pairs())).add(new)
        except NoSnapshotError:
            pass
        return new

    def insert(self, rows: list[dict], **options) -> list[FileMarker]:
        return self.insert_df(self.rows(rows), **options) if rows else []

    def insert_df(self, df: DataFrame, timestamp: int | None = None, host: str | None = None, check: bool = False) -> list[FileMarker]:
        """Writes one file for each partition (more only where a partition's batch exceeds the size that Spark splits at) and logs them at once."""
        if check:
            self.check(df)
        markers, schema = self._write_batch(df)
        if markers:
            self.log.append(schema, markers, timestamp=timestamp, host=host)
        return markers

    def insert_csv(self, path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> list[FileMarker]:
        return self.insert_df(transform(self.spark.read.options(**{"header": True} | options).csv(path)))

    def insert_json(self, path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, schema: T.StructType | str | None = None) -> list[FileMarker]:
        """Objects or arrays of objects, a line each."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return self.insert_df(transform(reader.json(path)))

    def adopt(self, paths: Iterable[str], timestamp: int | None = None) -> list[FileMarker]:
        """Logs Parquet files that lie below the table's `_data` already. Their schema comes from their footers."""
        paths, now = list(paths), timestamp or now_ms()
        if not paths:
            return []
        schema = TableSchema()
        for at in range(0, len(paths), ADOPTED):
            schema.add(self._footers(paths[at : at + ADOPTED]))
        markers = [FileMarker(p, now, n) for p, n in zip(paths, self.data.sizes(paths), strict=True)]
        self.log.append(schema, markers, timestamp=timestamp)
        return markers

    def _footers(self, paths: list[str]) -> TableSchema:
        """The schema of files, their footers read by one job; one by one only to name the column if they do not agree."""
        reader = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True)
        try:
            return TableSchema.of(reader.parquet(*map(self.data.full, paths)).schema)
        except Exception:  # noqa: BLE001  whatever the reader calls it
            if len(paths) == 1:
                raise
            schema = TableSchema()
            for p in paths:
                schema.add(self._footers([p]))
            return schema

    # Maintenance

    def merge(self, max_file_size: int = 10_000_000, max_file_count: int = 10, asc: bool = False) -> Merge:
        """Merges small files of one partition: the one with the most alive files (asc: the fewest) that has any to merge."""
        with self.lock.hold("maintenance"):
            done = self._merge(max_file_size, max_file_count, asc, limit=1)
        return done[0] if done else Merge()

    def merge_all(self, max_file_size: int = 10_000_000, max_file_count: int = 10, asc: bool = False) -> list[Merge]:
        """Merges until nothing is left: each round reads the state once, merges all files of all partitions at the same time, in as many groups as they make, and puts one log."""
        out: list[Merge] = []
        with self.lock.hold("maintenance"):
            while done := self._merge(max_file_size, max_file_count, asc, limit=None):
                out += done
        return out

    def cleanup(self, min_age_ms: int = 60_000) -> Cleanup:
        """Deletes files that have been dead, and logs that have been superseded, for min_age_ms, and folds logs of merges into one.

        The new log is put before anything is deleted; until then readers see the old ones, and both say the same.
        """
        with self.lock.hold("maintenance"):
            try:
                snap = self.snapshot()
            except NoSnapshotError:
                return Cleanup()
            before = now_ms() - min_age_ms
            loaded = dict(self.log.load(snap.logs))
            superseded = {t.path for t in snap.tombstones if t.created_ms <= before and t.path in loaded}
            merged = {n for n in snap.logs if n.rsplit("/", 1)[-1].split("_")[1] == "m"}
            gone = superseded | merged
            expired = {m.path for m in snap.markers if not m.alive and m.tombstone <= before}
            if not superseded and not expired and len(merged) < 2:
                return Cleanup()
            if gone:
                kept_elsewhere = {f.path for n, log in loaded.items() if n not in gone for f in log.files}
                listed = {f.path for n in gone for f in loaded[n].files}
                # Dead files that a surviving log still lists keep their mark.
                carried = [m for m in snap.markers if m.path in listed and (m.path not in expired or m.path in kept_elsewhere)]
                open_ = [t for t in snap.tombstones if t.path in loaded and t.path not in gone]
                self.log.append(snap.schema, carried, open_, merged=True)
            data = sorted(expired)
            self.data.delete_many(data)
            self.log.store.delete_many(sorted(gone))
            self.log.forget(gone)
            return Cleanup(tuple(sorted(merged)), tuple(sorted(superseded)), tuple(data))

    def remove_partitions(self, which: Callable[[list[str]], list[str]], max_files: int = 1000) -> tuple[str | None, LogMeta | None, int]:
        """Marks the files of partitions dead, in the log alone. which: gets the alive partitions, returns those to remove. Stops after the partition that reaches max_files."""
        with self.lock.hold("maintenance"):
            snap = self.snapshot()
            of: defaultdict[str, list[FileMarker]] = defaultdict(list)
            for m in snap.alive:
                of[m.partition].append(m)
            chosen: list[FileMarker] = []
            for p in which(sorted(of)):
                chosen += of.get(p, [])
                if len(chosen) >= max_files:
                    break
            if not chosen:
                return None, None, 0
            log, meta = self._replace(snap, chosen, [])
            return log, meta, len(chosen)

    def rewrite_partition(self, partition: str, query: Query, whole: bool = False) -> tuple[str | None, LogMeta | None, list[str]]:
        """Puts each alive file of a partition through a query over `_rows` (whole: all of them together), and marks the old ones dead."""
        with self.lock.hold("maintenance"):
            snap = self.snapshot()
            old = [m for m in snap.alive if m.partition == partition]
            if not old:
                return None, None, []

            def one(files: list[FileMarker]) -> FileMarker | None:
                df = queries.apply(query, self.read(files=files, schema=snap.schema), "_rows")
                return self._write_one(self._known(df, snap.schema), partition)

            with ThreadPoolExecutor(self.threads) as pool:
                new = [m for m in pool.map(one, [old] if whole else [[m] for m in old]) if m]
            log, meta = self._replace(snap, old, new)
            return log, meta, [m.path for m in new]

    # Inside

    def _below(self, path: str) -> str:
        return "/".join(x for x in (self.prefix, path) if x)

    def _without_given(self, df: DataFrame) -> DataFrame:
        return df if self.preserve_partition else df.drop(GIVEN)

    def _known(self, df: DataFrame, schema: TableSchema) -> DataFrame:
        """df if its columns are the table's; a file's types must not part from the log's."""
        for c, t in TableSchema.of(df.schema).pairs():
            if c not in schema:
                raise ValueError(f"the query makes a column {c!r} that the table does not have")
            if schema[c] != t:
                df = df.withColumn(c, F.col(f"`{c}`").cast(spark_type(schema[c])))
        return df

    def _write_batch(self, df: DataFrame) -> tuple[list[FileMarker], TableSchema]:
        routed = df.withColumn(PART, self.partitioning.column(df))
        routed = self._without_given(routed)
        if self.insert_query is None:
            return self._write(routed)
        out = queries.apply(self.insert_query, routed, "_rows")
        if PART in out.columns and queries.row_wise(out):
            return self._write(out)
        # A query that looks at several rows sees one partition's batch at a time. The input is read once, and put by partition
        # into a staging folder that each of these queries finds its own rows in.
        void = [f.name for f in routed.schema.fields if isinstance(f.dataType, T.NullType)]
        columns = [c for c in routed.columns if c != PART]
        kept = routed.drop(*void)
        struct = T.StructType([f for f in kept.schema.fields if f.name != PART])
        staging = self._below(f"_staging/{uuid4().hex}")

        def one(folder: str) -> tuple[list[FileMarker], TableSchema]:
            own = self.spark.read.schema(struct).parquet(self.data.full(folder)).withColumns({c: F.lit(None) for c in void}).select(*[F.col(f"`{c}`") for c in columns])
            return self._write(queries.apply(self.insert_query, own, "_rows").withColumn(PART, F.lit(from_folder(folder[len(staging) + 1 :]))))

        markers, schema = [], TableSchema()
        try:
            # A partition's rows may lack all columns but those of its name.
            some = kept if struct.fields else kept.withColumn("_", F.lit(1))
            some.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(self.data.full(staging))
            folders = sorted({e.path.rsplit("/", 1)[0] for e in self.data.list(staging, recursive=True, suffix=".parquet")})
            with ThreadPoolExecutor(self.threads) as pool:
                for m, s in pool.map(one, folders):
                    markers += m
                    schema.add(s)
        finally:
            self.data.delete_tree(staging)
        return markers, schema

    def _write(self, df: DataFrame) -> tuple[list[FileMarker], TableSchema]:
        """Writes df, which has PART, below a staging folder and moves the files to their partitions; nothing reads them before they are logged."""
        void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
        df = df.drop(*void)
        schema = TableSchema.of(df.drop(PART).schema)
        # A batch of one partition that outgrows a task is split by size; all else lands in one file for each partition.
        dealt = df.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *[F.col(f"`{c}`") for c in self.sort_order])
        staging = self._below(f"_staging/{uuid4().hex}")
        try:
            writer = dealt.write.partitionBy(PART).option("compression", self.codec.lower()).option("parquet.block.row.count.limit", self.row_group_size)
            writer.parquet(self.data.full(staging))
            moves, now, markers = [], now_ms(), []
            for e in self.data.list(staging, recursive=True, suffix=".parquet"):
                part = from_folder(e.path[len(staging) + 1 :].rsplit("/", 1)[0])
                to = self._below(f"_data/{part}/{uuid4()}.parquet")
                moves.append((e.path, to))
                markers.append(FileMarker(to, now, e.size))
            self.data.rename_many(moves)
        finally:
            self.data.delete_tree(staging)
        return markers, schema

    def _write_one(self, df: DataFrame, partition: str) -> FileMarker | None:
        """df as one file of a partition."""
        df = df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)])
        have = [F.col(f"`{c}`") for c in self.sort_order if c in df.columns]
        one = df.coalesce(1)
        one = one.sortWithinPartitions(*have) if have else one
        staging = self._below(f"_staging/{uuid4().hex}")
        try:
            one.write.option("compression", self.codec.lower()).option("parquet.block.row.count.limit", self.row_group_size).parquet(self.data.full(staging))
            found = self.data.list(staging, suffix=".parquet")
            if not found:
                return None
            to = self._below(f"_data/{partition}/{uuid4()}.parquet")
            self.data.rename_many([(found[0].path, to)])
            return FileMarker(to, now_ms(), found[0].size)
        finally:
            self.data.delete_tree(staging)

    def _choose(self, snap: Snapshot, max_file_size: int, max_file_count: int, asc: bool) -> list[tuple[str, list[FileMarker]]]:
        """Partitions in order, and of each the groups of files to merge: from the smallest on until they are large or many enough."""
        of: defaultdict[str, list[FileMarker]] = defaultdict(list)
        for m in snap.alive:
            of[m.partition].append(m)
        out = []
        for part, files in sorted(of.items(), key=lambda x: (len(x[1]) if asc else -len(x[1]), x[0])):
            chosen, total = [], 0
            for m in sorted(files, key=lambda m: (m.bytes, m.path)):
                chosen.append(m)
                total += m.bytes
                if total >= max_file_size or len(chosen) >= max(2, max_file_count):
                    if len(chosen) < 2:  # all that follow are as large
                        break
                    out.append((part, chosen))
                    chosen, total = [], 0
            if len(chosen) > 1:
                out.append((part, chosen))
        return out

    def _merge(self, max_file_size: int, max_file_count: int, asc: bool, limit: int | None) -> list[Merge]:
        try:
            snap = self.snapshot()
        except NoSnapshotError:
            return []
        chosen = self._choose(snap, max_file_size, max_file_count, asc)[:limit]
        if not chosen:
            return []

        def one(item: tuple[str, list[FileMarker]]) -> FileMarker | None:
            # The partition's columns come from the path; only a query of the user's may see them.
            files = self.read(files=item[1], schema=snap.schema, partition_columns=self.merge_query is not None)
            return self._write_one(self._known(queries.apply(self.merge_query, files, "source_files").select("*") if self.merge_query else files, self._with_partition(snap.schema)).drop(*self._path_columns(snap.schema)), item[0])

        with ThreadPoolExecutor(self.threads) as pool:
            new = list(pool.map(one, chosen))
        old = [m for _, files in chosen for m in files]
        log, meta = self._replace(snap, old, [m for m in new if m])
        return [Merge(log, m, part, tuple(files), meta) for m, (part, files) in zip(new, chosen, strict=True)]

    def _path_columns(self, schema: TableSchema) -> list[str]:
        return [f.name for f in self.partitioning.read_schema().fields if f.name not in schema]

    def _with_partition(self, schema: TableSchema) -> TableSchema:
        extra = self._path_columns(schema)
        return TableSchema(dict(schema.pairs()) | dict(TableSchema.of(T.StructType([f for f in self.partitioning.read_schema().fields if f.name in extra])).pairs()))

    def _replace(self, snap: Snapshot, old: list[FileMarker], new: list[FileMarker]) -> tuple[str, LogMeta]:
        """Puts a log that marks `old` dead, adds `new`, and carries all else that the logs it supersedes list."""
        now = now_ms()
        logs = {m.log for m in old}
        loaded = self.log.load(sorted(logs))
        listed = {f.path for _, log in loaded for f in log.files}
        dead = {m.path for m in old}
        carried = [replace(m, tombstone=now) if m.path in dead else m for m in snap.markers if m.path in listed or m.path in dead]
        own = {t.path: t for _, log in loaded for t in log.tombstones}
        tombs = [*own.values(), *(LogTombstone(n, now) for n in sorted(logs) if n not in own)]
        return self.log.append(snap.schema, [*carried, *new], tombs, merged=True, timestamp=max(now, *(m.created_ms for m in new)) if new else now)


__all__ = ["CODECS", "Cleanup", "Merge", "MergeTable", "partition_of"]
