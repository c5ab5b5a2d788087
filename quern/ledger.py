"""Numbered manifests in a folder of any Hadoop file system: a commit creates the next number or fails."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Ledger:
    """Versions of one JSON value below ``path``; readers keep to the version they opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def version(self) -> int:
        fs, p = self._at(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int) -> Any:
        fs, p = self._at(f"{self.path}/_manifests/{version:012d}.json")
        for wait in (0.01, 0.05, 0.2, 1.0, None):
            stream = fs.open(p)
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                # Created by another writer, whose few bytes are on their way.
                if wait is None:
                    raise
            finally:
                stream.close()
            time.sleep(wait)
        return None

    def commit(self, version: int, value: Any) -> None:
        fs, p = self._at(f"{self.path}/_manifests/{version:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as error:
            if fs.exists(p):
                raise Conflict(f"{self.path} has a version {version} already") from error
            raise
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def change(self, plan: Callable[[Any], Any], tries: int = 6) -> Any:
        """Plan on the latest value (None at first) and commit what comes out; plan again after a conflict. A plan of None changes nothing."""
        for n in range(tries):
            at = self.version()
            value = plan(self.read(at) if at else None)
            if value is None:
                return None
            try:
                self.commit(at + 1, value)
                return value
            except Conflict:
                if n == tries - 1:
                    raise
                time.sleep(min(0.05 * 2**n, 2.0) * (0.5 + random.random()))
        return None
