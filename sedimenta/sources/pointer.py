"""A small JSON value with versions, each created once and never overwritten, on any Hadoop file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Versions kept beside the current one, for readers that have just looked it up.
KEPT = 20


class Conflict(RuntimeError):
    """Someone else wrote a version in between, on whose value the change doesn't rest."""


class Pointer:
    """path.1, path.2 ...: the highest number is in force. A version is written aside and renamed; the rename fails if the number is taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        hadoop = self.jvm.org.apache.hadoop
        self.path = hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(conf)
        self.context = hadoop.fs.FileContext.getFileContext(self.path.toUri(), conf)

    def _at(self, version: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}.{version}")

    def _versions(self) -> list[int]:
        name = self.path.getName() + "."
        parent = self.path.getParent()
        if not self.fs.exists(parent):
            return []
        ends = [s.getPath().getName()[len(name) :] for s in self.fs.listStatus(parent) if s.getPath().getName().startswith(name)]
        return sorted(int(e) for e in ends if e.isdigit())

    def current(self) -> tuple[int, dict | None]:
        """The version in force and its value; 0 and None before the first."""
        found = self._versions()
        if not found:
            return 0, None
        stream = self.fs.open(self._at(found[-1]))
        try:
            return found[-1], json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def read(self) -> dict | None:
        return self.current()[1]

    def swap(self, value: dict, after: int) -> None:
        """All of value or nothing becomes the version that follows after; Conflict if there is one already."""
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode("utf-8")))
        stream.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        try:
            self.context.rename(fresh, self._at(after + 1), none)
        except Py4JJavaError as e:
            self.fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {after + 1} of {self.path.toString()} was written by someone else") from None
            raise
        for old in self._versions()[: -KEPT - 1]:
            self.fs.delete(self._at(old), False)

    def change(self, by: Callable[[dict | None], dict], tries: int = 50) -> dict:
        """by() of the value in force becomes the next version; it is called anew where someone else was faster, and may raise Conflict."""
        for _ in range(tries):
            version, value = self.current()
            value = by(value)
            try:
                self.swap(value, version)
                return value
            except Conflict:
                continue
        raise Conflict(f"{self.path.toString()} is written too often")
