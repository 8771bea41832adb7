"""Exclusive locks for maintenance: merges and cleanups of one table must not overlap across hosts."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from uuid import uuid4

from moraine.sources.storage import FileStore


class NoLock:
    """For tables with a single maintainer, on stores without exclusive creation."""

    def hold(self, name: str):
        return nullcontext()


class FileLock:
    """A lock file next to the log, made by exclusive creation (needs a store where that is atomic, such as HDFS or a local disk).

    The file holds a token of its own. A lock older than `stale_s` may be taken over; its first holder then leaves the file alone.
    """

    def __init__(self, store: FileStore, prefix: str = "", wait_s: float = 30, stale_s: float = 3600):
        self.store, self.prefix, self.wait_s, self.stale_s = store, prefix, wait_s, stale_s

    @contextmanager
    def hold(self, name: str) -> Iterator[None]:
        path = "/".join(x for x in (self.prefix, "_lock", name) if x)
        until, token = time.time() + self.wait_s, uuid4().hex
        while True:
            try:
                self.store.create(path, f"{time.time()} {token}")
                break
            except FileExistsError:
                try:
                    if time.time() - float(self.store.read(path).split()[0]) > self.stale_s:
                        self.store.delete_many([path])
                        continue
                except Exception:  # noqa: BLE001  the holder may just have let go
                    pass
                if time.time() > until:
                    raise TimeoutError(f"{path} is held") from None
                time.sleep(0.1)
        try:
            yield
        finally:
            if self.store.exists(path) and self.store.read(path).endswith(token):
                self.store.delete_many([path])
