"""Claims on a shared file system: files that only one of several callers makes, and leases that outlive no owner."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small state files, through the file system that its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path())) if self.exists() else []

    def read(self, name: str) -> dict | None:
        """A JSON file; None if it isn't there or isn't whole."""
        try:
            if not self.exists(name):
                return None
            stream = self.fs.open(self.path(name))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except ValueError:
            return None

    def write(self, name: str, value: dict) -> None:
        """Replace a JSON file: readers find the old one or the new one."""
        spare = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(self.fs.create(self.path(spare), True), value)
        self.fs.delete(self.path(name), False)
        self.fs.rename(self.path(spare), self.path(name))

    def rewrite(self, name: str, value: dict) -> None:
        """Write over a JSON file, which is never gone meanwhile, but may be read half written."""
        self._put(self.fs.create(self.path(name), True), value)

    def create(self, name: str, value: dict) -> bool:
        """Make a JSON file that isn't there; False if it is. Of callers at once one succeeds.

        Hadoop's local file system looks first and makes then, so files on a
        local disk are made by the operating system; others by the file system,
        which must make files exclusively, as HDFS does.
        """
        where = self.path(name)
        self.fs.mkdirs(where.getParent())
        if self.fs.getUri().getScheme() == "file":
            try:
                out = os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(out, "w", encoding="utf-8") as f:
                json.dump(value, f, sort_keys=True)
            return True
        try:
            self._put(self.fs.create(where, False), value)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    @staticmethod
    def _put(stream, value: dict) -> None:
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()


class LeaseLost(RuntimeError):
    """Another run has taken over."""


class Lease:
    """The right of one run to write below a folder, for `seconds` at a time.

    Each owner makes the next numbered claim, exclusively. A claim holds until
    the time it says; a thread renews it as long as the run is alive. When that
    has passed, or the run has given it up, the next claim may be made. A run
    that has been overtaken finds a later claim and stops: check() says so right
    before something is committed. Clocks of drivers should agree within some
    seconds. Claims before the last are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 60.0):
        self.state, self.seconds, self.token = Folder(spark, folder), seconds, uuid.uuid4().hex
        self.number = 0
        self._ended, self._lock = threading.Event(), threading.Lock()

    def _last(self) -> int:
        return max((int(n) for n in self.state.names() if n.isdigit()), default=0)

    def __enter__(self) -> Lease:
        last = self._last()
        if last:
            claim = self.state.read(f"{last:012d}")
            # one that isn't whole is being written, or its owner died as it wrote
            until = claim["until"] if claim else self.state.fs.getFileStatus(self.state.path(f"{last:012d}")).getModificationTime() / 1000 + self.seconds
            if until > time.time():
                raise RuntimeError(f"another run holds {self.state.root} for {until - time.time():.0f} seconds")
        if not self.state.create(f"{last + 1:012d}", self._claim()):
            raise RuntimeError(f"another run has just taken {self.state.root}")
        self.number = last + 1
        for n in self.state.names():
            if n.isdigit() and int(n) < self.number:
                self.state.delete(n)
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def _claim(self, seconds: float | None = None) -> dict:
        return {"owner": self.token, "until": time.time() + (self.seconds if seconds is None else seconds)}

    def _keep(self) -> None:
        while not self._ended.wait(self.seconds / 4):
            try:
                self.check()
            except LeaseLost:
                return

    def check(self) -> None:
        """Renew the claim; LeaseLost if there is a later one."""
        with self._lock:
            if self._last() > self.number:
                raise LeaseLost(f"another run has taken {self.state.root}")
            if self._ended.is_set():  # it was given up while this waited
                return
            self.state.rewrite(f"{self.number:012d}", self._claim())
            if self._last() > self.number:
                raise LeaseLost(f"another run has taken {self.state.root}")

    def __exit__(self, *_) -> None:
        self._ended.set()
        with self._lock:
            if self._last() == self.number:
                self.state.rewrite(f"{self.number:012d}", self._claim(0))
