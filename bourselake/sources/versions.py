"""Versions of a table's folder: small JSON states, the newest of which says what files belong to the table.

A writer puts new files beside the old ones and then adds one state; that step makes them visible, all or none. A writer that stops before it
leaves the former version as it was. Of two writers that began from one version the second fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has added this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> dict[int, str]:
        fs, p = self._fs(f"{self.path}/_versions")
        found = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
        return {int(m[1]): f.toString() for f in found if (m := re.fullmatch(r"(\d{12})\.json", f.getName()))}

    def _read(self, path: str) -> dict | None:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:  # a writer stopped within it
            return None
        finally:
            stream.close()

    def latest(self) -> dict:
        """The newest whole state, with the newest number as "version" (of a state that was broken off, if that is newer); number 0 where there is none."""
        names = self._names()
        newest = max(names, default=0)
        for number in sorted(names, reverse=True):
            state = self._read(names[number])
            if state is not None:
                return {**state, "version": newest}
        return {"version": newest}

    def commit(self, state: dict) -> int:
        """Adds the state as the version behind state["version"]; Conflict where that is there already."""
        number = state["version"] + 1
        fs, p = self._fs(f"{self.path}/_versions/{number:012d}.json")
        if number in self._names():
            raise Conflict(f"version {number} of {self.path} is there already")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {number} of {self.path} is there already") from e
        try:
            out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        finally:
            out.close()
        return number

    def folder(self, kind: str) -> str:
        """A new place below the table for files of a version to come."""
        return f"{kind}/{uuid.uuid4().hex}"

    def drop(self, folders: list[str]) -> None:
        """Deletes folders below the table that no version to be read names."""
        for name in folders:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)

    def forget(self, keep: int = 1) -> None:
        """Deletes all states but the newest so many."""
        names = self._names()
        for number in sorted(names)[: max(0, len(names) - keep)]:
            fs, p = self._fs(names[number])
            fs.delete(p, False)
