"""Commits: what a run wrote becomes visible by one file, or not at all.

A run writes to folders of its own and then creates commit number n + 1 below root/_commits, which names
those folders and whatever must hold together with them (offsets, marks). Creating that file is the one step that
counts: before it nothing is visible, so a run that dies leaves the last commit as it was and is simply
run again; and of two runs that started from the same commit only one gets the number, the other fails with
FileExistsError and is invisible. Commit files are small and are the driver's; data is read by the folders they name.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        path, fs = self._path("_commits")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        path, fs = self._path(f"_commits/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict:
        """The last commit; one of number 0 if there is none."""
        found = self.numbers()
        return self.read(found[-1]) if found else {"number": 0}

    def folder(self, kind: str) -> str:
        """A new name, below root, for a folder of data."""
        return f"{kind}/{uuid.uuid4().hex}"

    def commit(self, number: int, entry: dict) -> dict:
        """Creates commit `number` whole, or raises FileExistsError if there is one."""
        entry = {"number": number, **entry}
        final, fs = self._path(f"_commits/{number:012d}.json")
        draft, _ = self._path(f"_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(f"{self.root} has a commit {number} of another run") from e
            raise
        return entry

    def sweep(self, kinds: list[str], named: set[str]) -> int:
        """Deletes the folders of these kinds that are not named, as runs that died leave them; not to be called while another run writes."""
        n = 0
        for kind in kinds:
            path, fs = self._path(kind)
            for x in fs.listStatus(path) if fs.exists(path) else []:
                if f"{kind}/{x.getPath().getName()}" not in named:
                    fs.delete(x.getPath(), True)
                    n += 1
        return n
