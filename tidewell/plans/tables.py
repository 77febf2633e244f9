"""A folder of Parquet tables with versions, on any file system that Spark reads.

The file `current` says which folders hold each table. A commit writes what is new to a folder of its own and then
replaces `current`, so that a run that fails changes nothing; earlier folders stay as backups. A table may be dealt to
buckets by a key: a commit then replaces the buckets that it names, or adds rows to them, and leaves the others alone.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Busy(RuntimeError):
    """Another writer holds the folder."""


#: Seconds after which a writer's lock counts as left behind; buckets of a table dealt by key; folders that a bucket may
#: gather before its next commit writes it whole.
STALE, BUCKETS, MOST_PARTS = 600, 64, 50


class Folder:
    """Small files of a folder, through the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def read(self, name: str) -> str | None:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.open(self.at(name))
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> bool:
        """False if the file must be new and isn't."""
        from py4j.protocol import Py4JJavaError

        self.fs.mkdirs(self.root)
        if new and self.fs.getScheme() == "file":  # the local file system of Hadoop looks before it creates
            if not self.jvm.java.io.File(self.fs.makeQualified(self.at(name)).toUri()).createNewFile():
                return False
            new = False
        try:
            stream = self.fs.create(self.at(name), not new)
        except Py4JJavaError as e:
            if new and "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Written beside its place, then renamed over it in one step."""
        held = f".{name}-{uuid.uuid4().hex}"
        self.write(held, text)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        overwrite = self.gateway.new_array(kind, 1)
        overwrite[0] = kind.OVERWRITE
        self.context.rename(self.at(held), self.at(name), overwrite)

    def age(self, name: str) -> float | None:
        """Seconds since a file was touched, None if it isn't there."""
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000 if self.fs.exists(self.at(name)) else None

    def touch(self, name: str) -> None:
        self.fs.setTimes(self.at(name), int(time.time() * 1000), -1)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def move(self, name: str, to: str) -> bool:
        return self.fs.rename(self.at(name), self.at(to))

    def names(self, name: str = "") -> list[str]:
        place = self.at(name) if name else self.root
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []


class Lock:
    """One writer at a time. The lock names its owner, is touched while it is held, and is only removed by its owner."""

    def __init__(self, folder: Folder):
        self.folder, self.token, self.ended = folder, uuid.uuid4().hex, threading.Event()

    def __enter__(self) -> Lock:
        if (self.folder.age(".writer") or 0) > STALE:
            self.folder.move(".writer", f".writer-stale-{self.token}")
        if not self.folder.write(".writer", self.token, new=True):
            raise Busy(self.folder.root.toString())
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def _keep(self) -> None:
        while not self.ended.wait(STALE / 4):
            if self.held():
                self.folder.touch(".writer")

    def held(self) -> bool:
        return self.folder.read(".writer") == self.token

    def __exit__(self, *error) -> None:
        self.ended.set()
        if self.held():
            self.folder.delete(".writer")


def single_writer(method):
    """A read-modify-write of the tables, by one driver at a time."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        if self.lock is not None:  # a step of a longer one
            return method(self, *args, **kwargs)
        with Lock(self.files) as self.lock:
            try:
                return method(self, *args, **kwargs)
            finally:
                lock, self.lock = self.lock, None
                lock.ended.set()

    return run


class VersionedTables:
    #: Tables that are dealt to buckets, by the column that says to which.
    keys: dict[str, str] = {}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets, self.lock = spark, folder.rstrip("/"), buckets, None
        self.files = Folder(spark, self.folder)

    def state(self) -> dict:
        return json.loads(self.files.read("current") or "{}")

    def version(self) -> str | None:
        return self.state().get("version")

    def exists(self, name: str) -> bool:
        return name in self.state().get("tables", {})

    def bucket(self, name: str, state: dict | None = None) -> Column:
        """Bucket of a row of a table."""
        n = (state or self.state()).get("tables", {}).get(name, {}).get("buckets") or self.buckets
        return F.pmod(F.xxhash64(self.keys[name]), F.lit(n))

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or the rows of some of its buckets."""
        held = self.state()["tables"][name]
        parts = held["parts"] if buckets is None else {str(b): held["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.folder}/{p}" for ps in parts.values() for p in ps]
        schema = held["schema"]
        from pyspark.sql import types as T

        kind = T.StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def table_or(self, name: str, schema) -> DataFrame:
        return self.table(name) if self.exists(name) else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], only: dict[str, Iterable[int]] | None = None, added: Iterable[str] = (), **notes) -> str:
        """Put tables in force and leave others as they are. only: buckets whose rows the frame holds, where it isn't the
        whole table; added: tables whose frame holds further rows. notes: further entries of the state."""
        state, version = self.state(), f"v{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        held = state.get("tables", {})
        for name, df in tables.items():
            path, old = f"{version}/{name}", held.get(name) if name in (only or {}) or name in added else None
            if name in self.keys:
                of = self.bucket(name, state if old else {"tables": {}})
                df.withColumn("bucket_", of).hint("rebalance", F.col("bucket_")).write.partitionBy("bucket_").parquet(f"{self.folder}/{path}")
                new = {n.split("=")[1]: [f"{path}/{n}"] for n in self.files.names(path) if n.startswith("bucket_=")}
            else:
                df.write.parquet(f"{self.folder}/{path}")
                new = {"": [path]}
            parts = dict(old["parts"]) if old else {}
            for k in (str(b) for b in (only or {}).get(name, ())):
                parts.pop(k, None)
            for k, ps in new.items():
                parts[k] = [*parts.get(k, ()), *ps] if name in added else ps
            held[name] = {"parts": parts, "schema": json.loads(df.schema.json()), "buckets": (old or {}).get("buckets") or (self.buckets if name in self.keys else None)}
        if self.lock is not None and not self.lock.held():
            raise Busy(f"{self.folder}: the lock was taken by another writer")
        self.files.replace("current", json.dumps({**state, **notes, "version": version, "format": 3, "tables": held}))
        return version

    def crowded(self, name: str) -> bool:
        """Whether a bucket of a table that is added to has gathered too many folders."""
        return any(len(ps) > MOST_PARTS for ps in self.state().get("tables", {}).get(name, {}).get("parts", {}).values())

    def versions(self) -> list[str]:
        """Oldest first; folders that `current` doesn't name any more are backups."""
        return sorted((n for n in self.files.names() if n.startswith("v")), key=lambda n: int(n[1:].split("-")[0]))
