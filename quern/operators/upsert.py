"""Messages delivered more than once: idempotent upsert into hash-bucketed, sorted runs.

``KeyedStore`` keeps one survivor per identifier. An upsert first collapses its batch with
a map-side combine (so a message delivered a million times is one row before any shuffle),
then appends one run: files bucketed by the hash of the key and sorted by it within each
bucket. Compaction walks two sorted runs of a bucket side by side (a merge join of ordered scans, no
exchange and no sort before it), so equal keys collapse to one, and replaces them by a single run.
Upserting the same batch again, in any order, changes no survivor: it is the minimum of a total order.

Defined results
* Two ids are the same after trimming white space and lowering the case; session ids are
  compared as they are. The survivor is the row with the smallest (delivered_at, delivery_id);
  a NULL time or number sorts after every value.
* A row without session or message id has no identity and is never surplus; one without a delivery number is not reported.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import id_key
from quern.ledger import Ledger
from quern.session import drop_path, fresh_path

KEY = ["session_id", "message_key"]


def delivery_rank() -> Column:
    """What decides between two copies of a message; the smallest survives."""
    return F.struct(F.col("delivered_at").isNull().alias("no_time"), "delivered_at", F.col("delivery_id").isNull().alias("no_number"), "delivery_id")


def identified(messages: DataFrame) -> DataFrame:
    """Rows that have an identity, with ``message_key`` added."""
    return messages.withColumn("message_key", id_key("id")).where("session_id is not null and message_key is not null")


class KeyedStore:
    """Survivors (session_id, message_key, best[, payload]) in bucketed, sorted runs below one folder.

    ``best`` is the survivor's rank, ``payload`` holds chosen columns of the survivor. The manifest in the folder
    names the runs, so any session can open the store by its path; ``buckets`` and ``payload`` are
    fixed by its first upsert. Two writers cannot lose each other's runs (``Ledger``).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, payload: list[str] | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "store")).rstrip("/")
        self.ledger = Ledger(spark, self.path)
        self._first = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "payload": payload or [], "runs": [], "schema": ""}

    @property
    def state(self) -> dict:
        at = self.ledger.version()
        return self.ledger.read(at) if at else self._first

    @property
    def runs(self) -> int:
        return len(self.state["runs"])

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, str]:
        """One run: a file a bucket, sorted by key. The catalog entry that Spark needs for it is dropped at once."""
        run, name = f"run-{uuid.uuid4().hex}", f"quern_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.path}/{run}").saveAsTable(name)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(name).schema)
        self.spark.sql(f"DROP TABLE {name}")
        return run, schema

    def _open(self, run: str, state: dict) -> DataFrame:
        name, key = f"quern_{uuid.uuid4().hex}", ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE {name} ({state['schema']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {state['buckets']} BUCKETS LOCATION '{self.path}/{run}'")
        # A run has one file a bucket, so the files' order is the scan's: no sort before they are merged.
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        df = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return df

    def upsert(self, messages: DataFrame) -> KeyedStore:
        """Append one run; within the batch equal keys are already one row. Upserting a batch again changes no survivor."""
        state = self.state
        kept = [F.min_by(c, "best").alias(c) for c in state["payload"]]
        rows = identified(messages).select(*KEY, delivery_rank().alias("best"), *state["payload"])
        collapsed = rows.groupBy(*KEY).agg(F.min("best").alias("best"), *kept)
        # The exchange of the aggregate is that of the buckets where there are as many: a bucket is in one task and becomes one file.
        if state["buckets"] != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            collapsed = collapsed.repartition(state["buckets"], *KEY)
        run, schema = self._write(collapsed, state["buckets"])
        self.ledger.change(lambda old: {**(old or self._first), "runs": [*(old or self._first)["runs"], run], "schema": schema})
        return self

    def _merge(self, a: DataFrame, b: DataFrame, payload: list[str]) -> DataFrame:
        """Two sorted runs walked side by side: equal keys collapse to the smaller rank."""
        row = F.struct("best", *payload)
        left, right = a.select(*KEY, row.alias("a")), b.select(*KEY, row.alias("b"))
        return left.join(right, KEY, "full_outer").select(*KEY, F.least("a", "b").alias("row")).select(*KEY, "row.*")

    def read(self) -> DataFrame:
        """Current survivors. The runs of a bucket are merged without an exchange; of more than two, all but the newest pair are compacted first."""
        state = self.state
        if not state["runs"]:
            raise ValueError("nothing has been written to the store")
        if len(state["runs"]) > 2:
            self.compact(2)
            state = self.state
        runs = [self._open(r, state) for r in state["runs"]]
        return runs[0] if len(runs) == 1 else self._merge(*runs, state["payload"])

    def compact(self, most: int = 1) -> KeyedStore:
        """Merge the oldest runs two by two until at most ``most`` are left; a merged run takes the place of its two."""
        while len((state := self.state)["runs"]) > most:
            one, two = state["runs"][:2]
            merged, _ = self._write(self._merge(self._open(one, state), self._open(two, state), state["payload"]), state["buckets"])

            def swap(now: dict, one: str = one, two: str = two, merged: str = merged) -> dict | None:
                # Another compaction may have taken the pair: then its result stands.
                return {**now, "runs": [merged, *[r for r in now["runs"] if r not in (one, two)]]} if one in now["runs"] and two in now["runs"] else None

            won = self.ledger.change(swap)
            for run in (one, two) if won else (merged,):
                drop_path(self.spark, f"{self.path}/{run}")
        return self


def upsert_in_batches(messages: DataFrame, store: KeyedStore, batches: int = 2) -> KeyedStore:
    """Upsert the rows in ``batches`` runs, the rows of one ``batch_id`` in one of them, and compact."""
    turn = F.pmod(F.xxhash64(F.coalesce("batch_id", F.lit(""))), F.lit(batches))
    for i in range(batches):
        store.upsert(messages.where(turn == i))
    return store.compact()


def surplus(messages: DataFrame, store: KeyedStore | None = None) -> DataFrame:
    """(delivery_id) of all rows of a message but the survivor; rows without a delivery number cannot be named.

    Survivors are removed by their unique delivery number, a key without any skew however hot a message is.
    """
    store = store or upsert_in_batches(messages, KeyedStore(messages.sparkSession))
    kept = store.read().select(F.col("best.delivery_id").alias("delivery_id")).where("delivery_id is not null")
    return identified(messages).select("delivery_id").where("delivery_id is not null").join(kept, "delivery_id", "left_anti")


def survivors(messages: DataFrame, payload: list[str]) -> DataFrame:
    """(session_id, message_key, delivery_id, delivered_at, payload) of one row per message, by the same store."""
    store = upsert_in_batches(messages, KeyedStore(messages.sparkSession, payload=payload))
    return store.read().select(*KEY, "best.delivery_id", "best.delivered_at", *payload)


def deduplicate(messages: DataFrame) -> DataFrame:
    """All columns of exactly one row per message, plus ``message_key``.

    A ranked window rather than an aggregate of whole rows: columns that nobody asks for are
    pruned from the scan, and the limit on the rank is applied before the shuffle, so a message
    with very many copies sends one row a task.
    """
    w = Window.partitionBy(*KEY).orderBy(F.col("delivered_at").asc_nulls_last(), F.col("delivery_id").asc_nulls_last())
    return identified(messages).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
