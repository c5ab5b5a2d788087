"""Store to store: which sessions to append or merge, copying only what is missing, and verifying by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut
from quern.store import KEYS, Store


def delta(source: DataFrame, target: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, source_rows, target_rows, plan): ``append`` where the target has none, ``merge`` where it has fewer, else ``none``."""
    s = source.groupBy(F.col(key).alias("session_id")).agg(F.count("*").alias("source_rows"))
    t = target.groupBy(F.col(key).alias("session_id")).agg(F.count("*").alias("target_rows"))
    j = s.join(t, "session_id", "left").fillna(0, ["target_rows"])
    return j.withColumn("plan", F.when(F.col("target_rows") == 0, "append").when(F.col("source_rows") > F.col("target_rows"), "merge").otherwise("none"))


def missing(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the source whose key the target lacks."""
    return source.join(target.select(*key), key, "left_anti")


def verify(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """One row (missing, duplicates, synced)."""
    zero = F.lit(0).cast("bigint")
    gone = missing(source.select(*key), target, key).distinct().select(F.lit(1).cast("bigint").alias("missing"), zero.alias("duplicates"))
    twice = target.groupBy(*key).agg((F.count("*") - 1).alias("duplicates")).select(zero.alias("missing"), "duplicates")
    sums = gone.unionByName(twice).agg(F.coalesce(F.sum("missing"), zero).alias("missing"), F.coalesce(F.sum("duplicates"), zero).alias("duplicates"))
    return sums.withColumn("synced", (F.col("missing") == 0) & (F.col("duplicates") == 0))


def copy(source: Store, target: Store) -> dict[str, int]:
    """Copy what the target lacks; sessions last, so that a broken copy is seen as unfinished. An empty source is an error."""
    if source.table("sessions") is None:
        raise ValueError("the source store is empty")
    moved = {}
    for name in ("parts", "messages", "sessions"):
        rows = source.table(name)
        if rows is None:
            moved[name] = 0
            continue
        there = target.table(name)
        if there is None or name == "sessions":
            moved[name] = target.append_absent(name, rows)
            continue
        plan = cut(delta(rows, there).where("plan <> 'none'").select("session_id"), "plan")
        moved[name] = target.append_absent(name, rows.join(plan, "session_id", "left_semi"))
    return moved


def verify_stores(source: Store, target: Store) -> DataFrame:
    """(table, missing, duplicates, synced) for the three tables."""
    out = None
    for name, key in KEYS.items():
        s, t = source.table(name), target.table(name)
        if s is None:
            continue
        t = s.limit(0) if t is None else t
        one = verify(s, t, key).withColumn("table", F.lit(name)).select("table", "missing", "duplicates", "synced")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the source store is empty")
    return out
