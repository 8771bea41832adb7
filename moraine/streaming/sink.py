"""Structured Streaming into tables."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from moraine.operators.table import MergeTable


class TableSink:
    """A `foreachBatch` function that inserts each micro-batch into one or more tables, and maintains them now and then.

    A batch that a restarted query delivers again is recognised by its log and left out. Several tables make a materialised
    view: the raw rows go to one, the same rows (through its insert query) to an aggregating one.
    """

    def __init__(self, tables: MergeTable | Sequence[MergeTable], name: str, merge_every: int = 10, cleanup_every: int = 50, min_age_ms: int = 60_000, max_file_size: int = 10_000_000, max_file_count: int = 10):
        self.tables = [tables] if isinstance(tables, MergeTable) else list(tables)
        self.id = uuid5(NAMESPACE_URL, name).hex[:12]
        self.merge_every, self.cleanup_every, self.min_age_ms = merge_every, cleanup_every, min_age_ms
        self.max_file_size, self.max_file_count = max_file_size, max_file_count

    def host(self, table: MergeTable, batch_id: int) -> str:
        return f"{table.log.host}-{self.id}-{batch_id}"

    def done(self, table: MergeTable) -> int:
        """The last batch that a table has; logs of batches are superseded by merges, so the number is kept beside the log as well."""
        path = f"{table.log.folder.rsplit('_log', 1)[0]}_stream/{self.id}"
        last = max((int(e.path.rsplit("/", 1)[-1]) for e in table.log.store.list(path)), default=-1)
        mark = f"-{self.id}-"
        return max([last, *(int(n.rsplit(mark, 1)[1].removesuffix(".jsonl")) for n in table.log.list() if mark in n)])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for t in self.tables:
                if self.done(t) < batch_id:
                    t.insert_df(batch, host=self.host(t, batch_id))
                    folder = f"{t.log.folder.rsplit('_log', 1)[0]}_stream/{self.id}"
                    old = [e.path for e in t.log.store.list(folder)]
                    try:
                        t.log.store.create(f"{folder}/{batch_id}", "")
                    except FileExistsError:
                        pass
                    t.log.store.delete_many(old)
        finally:
            batch.unpersist()
        for t in self.tables:
            if self.merge_every and batch_id % self.merge_every == self.merge_every - 1:
                t.merge_all(self.max_file_size, self.max_file_count)
            if self.cleanup_every and batch_id % self.cleanup_every == self.cleanup_every - 1:
                t.cleanup(self.min_age_ms)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the query; trigger as for DataStreamWriter.trigger, every three seconds by default."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "3 seconds"}).start()
