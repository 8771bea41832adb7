"""Files under one root, wherever Hadoop's file systems reach."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Files read one by one by the driver; more are read by a Spark job. Requests under way at once.
FEW, THREADS = 24, 16


@dataclass(frozen=True)
class Entry:
    path: str
    size: int


class FileStore:
    """Paths are relative to the root and use `/`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        base = self._Path(root)
        self.fs = base.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(base).toString().rstrip("/")

    def full(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _path(self, path: str):
        return self._Path(self.full(path))

    def relative(self, uri: str) -> str:
        return uri.split(self.root.split(":", 1)[-1].lstrip("/"), 1)[-1].lstrip("/") if not uri.startswith(self.root) else uri[len(self.root) + 1 :]

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def sizes(self, paths: list[str]) -> list[int]:
        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(self.size, paths))

    def list(self, path: str, recursive: bool = False, suffix: str = "") -> list[Entry]:
        """Files below path; none if it does not exist."""
        p = self._path(path)
        if not self.fs.exists(p):
            return []
        found, it = [], self.fs.listFiles(p, recursive)
        skip = len(self.root) + 1
        while it.hasNext():
            s = it.next()
            name = s.getPath().toString()
            if name.endswith(suffix):
                found.append(Entry(name[skip:], s.getLen()))
        return found

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_many(self, paths: list[str]) -> dict[str, str]:
        if len(paths) <= FEW:
            with ThreadPoolExecutor(THREADS) as pool:
                return dict(zip(paths, pool.map(self.read, paths), strict=True))
        rows = self.spark.read.text([self.full(p) for p in paths], wholetext=True).select("value", "_metadata.file_path").collect()
        names = {p.rsplit("/", 1)[-1]: p for p in paths}
        return {names[r.file_path.rsplit("/", 1)[-1]]: r.value for r in rows}

    def create(self, path: str, text: str) -> None:
        """Writes a new file; FileExistsError if it is there already."""
        try:
            out = self.fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise FileExistsError(path) from None
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, path: str, text: str) -> None:
        """As create(), but readers never see the file before it is whole: it is written under another name and then moved.

        The name is claimed by exclusive creation meanwhile. A writer that dies leaves its claim, and the name is not used.
        """
        folder, _, name = path.rpartition("/")
        claim, draft = (f"{folder}/_new/{name}.{x}" for x in ("claim", uuid4().hex))
        self.create(claim, "")
        try:
            if self.exists(path):
                raise FileExistsError(path)
            self.create(draft, text)
            self.rename_many([(draft, path)])
        finally:
            self.delete_many([claim])

    def rename_many(self, pairs: list[tuple[str, str]]) -> None:
        for d in {b.rsplit("/", 1)[0] for _, b in pairs}:
            self.fs.mkdirs(self._path(d))

        def one(pair: tuple[str, str]) -> None:
            if not self.fs.rename(self._path(pair[0]), self._path(pair[1])):
                raise OSError(f"could not move {pair[0]} to {pair[1]}")

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(one, pairs))

    def delete_many(self, paths: list[str]) -> None:
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda p: self.fs.delete(self._path(p), False), paths))

    def delete_tree(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
