"""An archive of three append-only tables on any Hadoop file system, with optimistic commits.

Every table is a set of immutable parquet folders and a numbered manifest that names the live
ones. A commit stages a folder, then creates the next manifest; creation fails if another
writer was first, and the commit is planned again on what is there now. Readers see the
manifest they opened: a snapshot.

Keys: sessions (id), messages (session_id, id), parts (session_id, message_id, id). A stored
key is never overwritten by ``append_absent``. Equal keys within one batch are reduced to one.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.ledger import Conflict, Ledger
from quern.session import cut

KEYS = {"sessions": ["id"], "messages": ["session_id", "id"], "parts": ["session_id", "message_id", "id"]}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _ledger(self, table: str) -> Ledger:
        return Ledger(self.spark, f"{self.path}/{table}")

    def _manifest(self, table: str, version: int) -> list[str]:
        return self._ledger(table).read(version)["folders"]

    def _commit(self, table: str, version: int, folders: list[str]) -> None:
        self._ledger(table).commit(version, {"folders": folders})

    def version(self, table: str) -> int:
        return self._ledger(table).version()

    # reads

    def table(self, name: str, predicate: Column | None = None, columns: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """One snapshot of a table, filtered and projected at the scan; None while nothing was written."""
        at = self.version(name) if version is None else version
        if not at:
            return None
        df = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{name}/{f}" for f in self._manifest(name, at)])
        df = df if predicate is None else df.where(predicate)
        return df if columns is None else df.select(*columns)

    def counts(self) -> dict[str, int]:
        return {t: (df.count() if (df := self.table(t)) is not None else 0) for t in KEYS}

    # writes

    def _attempt(self, table: str, plan: Callable[[int], tuple[list[str], int] | None], tries: int = 6) -> int:
        """Plan on the current version and commit the next; plan again after a conflict, with bounded, jittered waits."""
        for n in range(tries):
            at = self.version(table)
            planned = plan(at)
            if planned is None:
                return 0
            folders, changed = planned
            try:
                self._commit(table, at + 1, folders)
            except Conflict:
                if n == tries - 1:
                    raise
                time.sleep(min(0.05 * 2**n, 2.0) * (0.5 + random.random()))
                continue
            return changed
        return 0

    def _stage(self, table: str, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}/{folder}")
        return folder

    def append(self, table: str, rows: DataFrame) -> int:
        """Append as is; the caller vouches that the keys are new."""
        folder = self._stage(table, rows)
        n = self.spark.read.parquet(f"{self.path}/{table}/{folder}").count()
        return self._attempt(table, lambda at: ((self._manifest(table, at) if at else []) + [folder], n))

    def append_absent(self, table: str, rows: DataFrame) -> int:
        """Append rows whose key is not stored; returns how many. Running it again adds nothing."""
        key = KEYS[table]
        body = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        once = cut(rows.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.min_by(body, F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns])).alias("row")).select("row.*"), "batch")

        def plan(at: int) -> tuple[list[str], int] | None:
            stored = self.table(table, columns=key, version=at) if at else None
            new = once if stored is None else once.join(stored, key, "left_anti")
            folder = self._stage(table, new)
            n = self.spark.read.parquet(f"{self.path}/{table}/{folder}").count()
            return ((self._manifest(table, at) if at else []) + [folder], n) if n else None

        return self._attempt(table, plan)

    def update_matched(self, table: str, updates: DataFrame) -> int:
        """Replace the non-key columns of ``updates`` in stored rows with the same key; unmatched updates are dropped."""
        key = KEYS[table]
        changed = [c for c in updates.columns if c not in key]
        u = cut(updates.dropDuplicates(key).select(*key, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("hit")), "updates")

        def plan(at: int) -> tuple[list[str], int] | None:
            if not at:
                return None
            old = self.table(table, version=at)
            j = old.join(u, key, "left")
            folder = self._stage(table, j.select(*[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns]))
            return [folder], old.join(u, key, "left_semi").count()

        return self._attempt(table, plan)

    def compact(self, table: str, partitions: int | None = None) -> None:
        """Rewrite a table as one sorted folder, clustered by session."""
        key = KEYS[table]

        def plan(at: int) -> tuple[list[str], int] | None:
            if not at or len(self._manifest(table, at)) < 2:
                return None
            df = self.table(table, version=at)
            spread = df.repartitionByRange(partitions, *key) if partitions else df.repartitionByRange(*key)
            return [self._stage(table, spread.sortWithinPartitions(*key))], 0

        self._attempt(table, plan)
