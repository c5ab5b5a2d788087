"""Validation of ordered event streams and their idempotent ingest.

An event is a row (batch_id, seq, kind, payload): kind is session, message or part, payload its
JSON. Within a batch the order matters: a message belongs to the session last accepted, a part
to the message last accepted. The state is carried by windows over ``seq`` in each batch:

* a session event opens a substream; a rejected one leaves no session open, so what follows it
  is ``message_before_session``;
* an accepted message becomes the current one; a dropped message changes nothing, so its parts
  meet ``part_message_mismatch``;
* duplicates are found by rank within the substream.

Each dropped event drops only itself and carries one stable reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.json_getters import as_variant, get_string
from quern.functions.text import blank
from quern.session import cut
from quern.store import KEYS, Store

MAX_EVENTS = 1000

# Stable reasons, fixed values of the wire protocol.
REASONS = (
    "duplicate_message_id",
    "duplicate_part_key",
    "message_before_session",
    "message_session_mismatch",
    "part_before_message",
    "part_message_mismatch",
    "empty_source_agent",
    "parent_message_without_session",
    "uncategorized",
)


def validate(events: DataFrame) -> DataFrame:
    """Events with ``reason``, NULL where the event is accepted, plus the ids read from the payload.

    A payload that is not JSON, an unknown kind or a missing id is ``uncategorized``.
    """
    v = F.col("v")
    e = events.withColumn("v", as_variant("payload"))
    e = e.select("batch_id", "seq", "kind", "payload", get_string(v, "id").alias("id"), get_string(v, "session_id").alias("sid"), get_string(v, "message_id").alias("mid"), get_string(v, "source_agent").alias("agent"), get_string(v, "parent_session_id").alias("up"), get_string(v, "parent_message_id").alias("upm"))
    session, message, part = (F.col("kind") == k for k in ("session", "message", "part"))
    unread = F.col("id").isNull() | ~F.coalesce(F.col("kind").isin("session", "message", "part"), F.lit(False))
    bad_session = F.when(session & unread, "uncategorized").when(session & blank("agent"), "empty_source_agent").when(session & F.col("upm").isNotNull() & blank("up"), "parent_message_without_session")
    order = Window.partitionBy("batch_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("bad", bad_session)
    # '' stands for: no session open, because the last one was rejected.
    e = e.withColumn("open", F.last(F.when(session, F.when(F.col("bad").isNull(), F.col("id")).otherwise("")), ignorenulls=True).over(so_far))
    e = e.withColumn("substream", F.sum(session.cast("int")).over(so_far))
    e = e.withColumn("bad", F.coalesce("bad", F.when(unread, "uncategorized").when(message & (F.coalesce("open", F.lit("")) == ""), "message_before_session").when(message & ~F.col("sid").eqNullSafe(F.col("open")), "message_session_mismatch")))
    good_message = message & F.col("bad").isNull()
    among = Window.partitionBy("batch_id", "substream", F.when(good_message, F.col("id"))).orderBy("seq")
    e = e.withColumn("bad", F.when(good_message & (F.row_number().over(among) > 1), "duplicate_message_id").otherwise(F.col("bad")))
    current = Window.partitionBy("batch_id", "substream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("now", F.last(F.when(message & F.col("bad").isNull(), F.col("id")), ignorenulls=True).over(current))
    e = e.withColumn("bad", F.coalesce("bad", F.when(part & F.col("now").isNull(), "part_before_message").when(part & ~(F.col("sid").eqNullSafe(F.col("open")) & F.col("mid").eqNullSafe(F.col("now"))), "part_message_mismatch")))
    good_part = part & F.col("bad").isNull()
    twins = Window.partitionBy("batch_id", "substream", F.when(good_part, F.struct("mid", "id"))).orderBy("seq")
    e = e.withColumn("bad", F.when(good_part & (F.row_number().over(twins) > 1), "duplicate_part_key").otherwise(F.col("bad")))
    return e.select("batch_id", "seq", "kind", "payload", "id", "sid", "mid", F.col("bad").alias("reason"))


def _rows(valid: DataFrame) -> dict[str, DataFrame]:
    v = F.col("v")
    s = lambda *k: get_string(v, *k)
    e = valid.where("reason is null").withColumn("v", as_variant("payload"))
    sessions = e.where("kind = 'session'").select("seq", "id", s("parent_session_id").alias("parent_session_id"), s("parent_message_id").alias("parent_message_id"), F.trim(s("source_agent")).alias("source_agent"), s("created_at").alias("created_at"), s("project").alias("project"), s("options").alias("options"))
    messages = e.where("kind = 'message'").select("seq", F.col("sid").alias("session_id"), "id", s("timestamp").alias("timestamp"), s("role").alias("role"), F.when(F.lower(s("role")) == "system", s("content")).alias("content"), s("options").alias("options"))
    parts = e.where("kind = 'part'").select("seq", F.col("sid").alias("session_id"), F.col("mid").alias("message_id"), "id", s("ordinal").try_cast("int").alias("ordinal"), s("type").alias("type"), F.coalesce(s("provenance"), F.lit("conversational")).alias("provenance"), s("name").alias("tool_name"), s("call_id").alias("call_id"), s("is_failure").try_cast("boolean").alias("is_failure"), s("text").alias("text"), s("params").alias("params"), s("result").alias("result"), s("media_type").alias("media_type"), s("file_name").alias("file_name"), s("options").alias("options"))
    first = lambda df, key: df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), "seq").alias("r")).select(*key, "r.*").drop("seq")
    return {"sessions": first(sessions, KEYS["sessions"]), "messages": first(messages, KEYS["messages"]), "parts": first(parts, KEYS["parts"])}


def ingest(store: Store, events: DataFrame) -> DataFrame:
    """Write accepted events; per event (batch_id, seq, kind, id, outcome, reason) with outcome inserted, matched or error.

    Stored labels win: messages get the source_agent and project of the stored session where
    there is one. Sessions are written last, so a crash in between is healed by a rerun.
    """
    valid = cut(validate(events), "events")
    rows = _rows(valid)
    stored = store.table("sessions", columns=["id", "source_agent", "project"])
    labels = rows["sessions"].select(F.col("id").alias("session_id"), "source_agent", "project")
    if stored is not None:
        known = stored.select(F.col("id").alias("session_id"), F.col("source_agent").alias("old_agent"), F.col("project").alias("old_project"))
        labels = labels.join(known, "session_id", "full").select("session_id", F.coalesce("old_agent", "source_agent").alias("source_agent"), F.coalesce("old_project", "project").alias("project"))
    rows["messages"] = rows["messages"].join(labels, "session_id", "left")
    ids = {"sessions": ["id"], "messages": ["sid", "id"], "parts": ["sid", "mid", "id"]}
    before = {}
    for name, key in KEYS.items():
        there = store.table(name, columns=key)
        before[name] = None if there is None else cut(there.distinct(), "before")
    for name in ("parts", "messages", "sessions"):
        store.append_absent(name, rows[name])
    out = valid.where("reason is not null").select("batch_id", "seq", "kind", "id", F.lit("error").alias("outcome"), "reason")
    for name, key in KEYS.items():
        mine = valid.where((F.col("reason").isNull()) & (F.col("kind") == name[:-1]))
        again = F.row_number().over(Window.partitionBy(*ids[name]).orderBy("batch_id", "seq")) > 1
        mine = mine.withColumn("again", again)
        if before[name] is not None:
            old = before[name].toDF(*ids[name]).withColumn("old", F.lit(True))
            mine = mine.join(old, ids[name], "left")
        else:
            mine = mine.withColumn("old", F.lit(None).cast("boolean"))
        out = out.unionByName(mine.select("batch_id", "seq", "kind", "id", F.when(F.col("again") | F.coalesce("old", F.lit(False)), "matched").otherwise("inserted").alias("outcome"), F.lit(None).cast("string").alias("reason")))
    return out


def check_batch(events: list[dict]) -> None:
    """Limits of one wire batch."""
    if not events:
        raise ValueError("validation_failed: the batch is empty")
    if len(events) > MAX_EVENTS:
        raise ValueError(f"validation_failed: a batch holds at most {MAX_EVENTS} events")


def export_events(sessions: DataFrame, messages: DataFrame, parts: DataFrame, time: str = "timestamp") -> DataFrame:
    """One JSON event a row in archive order: sessions by id, messages by time and id, parts by ordinal.

    The order is a range partitioning on the sort key, so an export of any size is written by
    many tasks and read back in file order.
    """
    body = lambda df, kind: F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(f"`{c}`") for c in df.columns]))
    low = F.lit(None).cast("string")
    times = messages.groupBy(F.col("session_id").alias("s"), F.col("id").alias("m")).agg(F.min(F.col(time).cast("string")).alias("t"))
    s = sessions.select(F.col("id").alias("s"), F.lit(0).alias("rank"), low.alias("t"), low.alias("m"), F.lit(-1).alias("o"), low.alias("p"), body(sessions, "session").alias("value"))
    m = messages.select(F.col("session_id").alias("s"), F.lit(1).alias("rank"), F.col(time).cast("string").alias("t"), F.col("id").alias("m"), F.lit(-1).alias("o"), low.alias("p"), body(messages, "message").alias("value"))
    p = parts.select(F.col("session_id").alias("s"), F.col("message_id").alias("m"), F.col("ordinal").alias("o"), F.col("id").alias("p"), body(parts, "part").alias("value")).join(times, ["s", "m"], "left").select("s", F.lit(1).alias("rank"), "t", "m", "o", "p", "value")
    return s.unionByName(m).unionByName(p).orderBy("s", "rank", "t", "m", "o", "p").select("value")
