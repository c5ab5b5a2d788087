"""Archives as plain folders, artifacts, clean-up of old versions, and what is odd about a store."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.ledger import Ledger
from quern.operators import derive
from quern.session import drop_path, fresh_path
from quern.store import KEYS, Store

#: Ceiling of one artifact in bytes.
ARTIFACT = 100 * 1024 * 1024
#: Columns that older archives lack, and their types; added on reading.
ADDED = {"sessions": {"hostname": "string", "file_id": "bigint"}, "messages": {"hostname": "string", "file_id": "bigint", "search_text": "string"}, "parts": {"tool_name": "string", "call_id": "string", "is_failure": "boolean"}}
RETENTION = 3600.0


def export_archive(store: Store, path: str) -> dict[str, int]:
    """A clean copy of the three tables (one folder each, no old versions, no indexes) and a manifest; rows per table."""
    counts: dict[str, int] = {}
    for name in KEYS:
        df = store.table(name)
        if df is not None:
            df.write.parquet(f"{path}/{name}")
            counts[name] = store.spark.read.parquet(f"{path}/{name}").count()
    Ledger(store.spark, path).commit(1, {"tables": counts, "format": 1})
    return counts


def backfill(name: str, df: DataFrame) -> DataFrame:
    """A table of an older archive with the columns it lacks: parts read theirs out of ``body`` where they have one, others get NULL."""
    lacking = {c: t for c, t in ADDED[name].items() if c not in df.columns}
    for column, kind in lacking.items():
        from_body = name == "parts" and "body" in df.columns
        body = F.try_parse_json(F.col("body").cast("string")) if from_body and dict(df.dtypes)["body"] == "string" else F.col("body") if from_body else None
        df = df.withColumn(column, F.try_variant_get(body, f"$.{column}", kind) if from_body else F.lit(None).cast(kind))
    return derive.tool_identity(df) if name == "parts" and lacking else df


def import_archive(spark: SparkSession, path: str, store: Store) -> dict[str, int]:
    """Append what an archive holds and the store does not; old archives are upgraded on the way. Running it again adds nothing."""
    ledger = Ledger(spark, path)
    tables = ledger.read(ledger.version())["tables"]
    return {name: store.append_absent(name, backfill(name, spark.read.parquet(f"{path}/{name}"))) for name in KEYS if name in tables}


class Artifacts:
    """Results kept under an id of their own in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, ceiling: int = ARTIFACT):
        self.spark, self.path, self.ceiling = spark, (path or fresh_path(spark, "exports")).rstrip("/"), ceiling

    def _size(self, path: str) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        if self._size(f"{self.path}/{name}") > self.ceiling:
            drop_path(self.spark, f"{self.path}/{name}")
            raise ValueError(f"the result is larger than {self.ceiling} bytes: export less, or to a folder of your own")
        return name

    def read(self, name: str) -> DataFrame:
        if not name.isalnum():
            raise ValueError("an artifact is named by its id")
        return self.spark.read.parquet(f"{self.path}/{name}")


def _folders(store: Store, name: str) -> list[tuple[str, float]]:
    jvm = store.spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{store.path}/{name}")
    fs = where.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(where) if s.getPath().getName().startswith("data-")] if fs.exists(where) else []


def clean_up(store: Store, retention: float = RETENTION) -> int:
    """Delete folders that the live version does not name and that are older than ``retention`` seconds; returns how many."""
    gone = 0
    for name in KEYS:
        at = store.version(name)
        live = set(store._manifest(name, at)) if at else set()
        for folder, changed in _folders(store, name):
            if folder not in live and changed < time.time() - retention:
                drop_path(store.spark, f"{store.path}/{name}/{folder}")
                gone += 1
    return gone


def diagnose(store: Store, model: str | None = None, many: int = 64) -> DataFrame:
    """(table, finding, detail) of what should be looked at: many small commits, folders nothing names, an older layout, vectors of another model."""
    found: list[tuple[str, str, str]] = []
    for name in KEYS:
        at = store.version(name)
        live = store._manifest(name, at) if at else []
        if len(live) > many:
            found.append((name, "many_commits", f"{len(live)} folders are live: compact"))
        orphans = len({f for f, _ in _folders(store, name)} - set(live))
        if orphans:
            found.append((name, "orphan_folders", f"{orphans} folders belong to no live version: clean up"))
        df = store.table(name)
        lacking = [c for c in ADDED[name] if df is not None and c not in df.columns]
        if lacking:
            found.append((name, "older_layout", f"lacks {', '.join(lacking)}"))
        if model and df is not None and "embedding_model" in df.columns and not df.where(F.col("embedding_model") != model).isEmpty():
            found.append((name, "model_swap", f"vectors of another model than {model}"))
    return store.spark.createDataFrame(found, "`table` string, finding string, detail string")


def endpoint(text: str) -> str:
    """What a copy's end names: an ``archive`` folder, a ``stream`` of lines (export only), or a ``store``."""
    low = text.strip().lower()
    return "stream" if low == "-" or low.endswith(".jsonl") else "archive" if low.endswith(".archive") else "store"


def skip_reasons(heads: DataFrame, known: list[str], superseded: DataFrame | None = None) -> DataFrame:
    """(session_id, reason) of listed sources that need no import: ``unsupported`` (client not known), ``empty`` (no time), ``superseded`` (a
    later listing of the same session exists) or ``fresh``; NULL where it must be imported.

    ``heads``: session_id, client, source_us, stored_us; ``superseded``: ids replaced by others.
    """
    rows = heads if superseded is None else heads.join(superseded.select("session_id", F.lit(True).alias("old")).distinct(), "session_id", "left")
    old = F.lit(False) if superseded is None else F.coalesce("old", F.lit(False))
    reason = F.when(~F.col("client").isin(known), "unsupported").when(F.col("source_us").isNull(), "empty").when(old, "superseded").when(F.col("source_us") <= F.col("stored_us"), "fresh")
    return rows.select("session_id", reason.alias("reason"))
