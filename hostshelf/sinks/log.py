"""Numbered entries of a stored table: each is created whole, once, by one writer.

An entry is written to a hidden file of its own and then given its name by an
operation that fails if the name is taken: a hard link on a local file system, a
rename without overwrite elsewhere (atomic on HDFS). So of two writers that
meet one is told so, no reader sees half an entry, and a writer that dies leaves
nothing but a hidden file that `tidy` removes. On object stores whose rename is
a copy, run one writer per table.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class EntryLog:
    """Entries `<name>=<n>.json` in one folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder, name

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self) -> list:
        fs, folder = self._fs(), self._path("")
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def _entry(self, n: int) -> str:
        return f"{self.name}={n}.json"

    def numbers(self) -> list[int]:
        """Numbers of the entries, oldest first."""
        names = [s.getPath().getName() for s in self._files()]
        return sorted(int(x[len(self.name) + 1:-5]) for x in names if x.startswith(f"{self.name}=") and x.endswith(".json"))

    def read(self, n: int) -> dict | None:
        """The entry, or None if it has been tidied away."""
        try:
            stream = self._fs().open(self._path(self._entry(n)))
        except Py4JJavaError as exc:
            if "FileNotFoundException" in str(exc.java_exception):
                return None
            raise
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict] | None:
        while numbers := self.numbers():
            if (entry := self.read(numbers[-1])) is not None:
                return numbers[-1], entry
        return None

    def put(self, n: int, entry: dict) -> bool:
        """Create entry `n`; False if there is one."""
        hidden, target, fs = self._path(f".{uuid.uuid4().hex}.tmp"), self._path(self._entry(n)), self._fs()
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            return self._name_once(fs, hidden, target)
        finally:
            fs.delete(hidden, False)

    def _name_once(self, fs, hidden, target) -> bool:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(hidden, target, plain)
        except Py4JJavaError:
            if fs.exists(target):
                return False
            raise
        return True

    def tidy(self, keep: int, min_age_seconds: float) -> None:
        """Remove old entries, and hidden files that writers have left.

        The newest `keep` stay, and so does every entry that was the newest one
        within `min_age_seconds`: a reader may still be at work with it.
        """
        limit = (time.time() - min_age_seconds) * 1000
        files = {s.getPath().getName(): s for s in self._files()}
        numbers = self.numbers()
        followers = dict(zip(numbers, numbers[1:]))
        for n in numbers[:-max(1, keep)]:
            entry, after = files.get(self._entry(n)), files.get(self._entry(followers[n]))
            if entry is not None and after is not None and after.getModificationTime() <= limit:
                self._fs().delete(entry.getPath(), False)
        for name, s in files.items():
            if name.endswith(".tmp") and s.getModificationTime() <= limit:
                self._fs().delete(s.getPath(), False)
