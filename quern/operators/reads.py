"""Point reads, pages of sessions, context of messages, and the aggregates over the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE, BUDGET = 1000, 200_000


class NotFound(LookupError):
    """No such session, message or anchor."""


def in_order(messages: DataFrame, time: str = "timestamp") -> DataFrame:
    """Messages with ``position``, 1..n within their session by time and id.

    A window by session: rows stream through it sorted, nothing is gathered.
    """
    return messages.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(time, "message_id")))


def page(rows: DataFrame, limit: int = 50, budget: int = BUDGET, size: Column | None = None, tail: bool = False, key: list[str] = ("session_id",)) -> DataFrame:
    """First (or last) rows of every group up to ``limit`` and a byte budget; at least one, never part of one.

    ``rows`` carry ``position``.
    """
    limit = max(1, min(limit, MAX_PAGE))
    order = F.desc("position") if tail else F.col("position")
    w = Window.partitionBy(*key).orderBy(order)
    used = F.sum(F.octet_length("search_text") if size is None else size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("used", used).where((F.col("rn") <= limit) & ((F.col("rn") == 1) | (F.col("used") <= budget))).drop("rn", "used")


def session_page(messages: DataFrame, session_id: str, anchor: str | None = None, where: str = "after", limit: int = 50, budget: int = BUDGET, time: str = "timestamp") -> dict:
    """One page of a session's conversation, around an anchor message or from its start or end.

    ``where``: ``start`` or ``end`` (no anchor), ``at``, ``after`` or ``before`` (with one).
    """
    rows = in_order(messages.where((F.col("session_id") == session_id) & F.col("search_text").isNotNull()), time)
    total = rows.count()
    if not total:
        raise NotFound(f"no session {session_id}")
    at = None
    if anchor is not None:
        found = rows.where(F.col("message_id") == anchor).select("position").first()
        if found is None:
            raise NotFound(f"no message {anchor} in session {session_id}")
        at = found[0]
        rows = rows.where({"at": F.col("position") >= at, "after": F.col("position") > at, "before": F.col("position") < at}[where])
    got = page(rows, limit, budget, tail=where in ("end", "before")).orderBy("position").collect()
    first, last = (got[0]["position"], got[-1]["position"]) if got else (at or 0, at or 0)
    return {"messages": got, "before_remaining": max(first - 1, 0), "after_remaining": total - last}


def page_of_message(messages: DataFrame, message_id: str, **options) -> dict:
    """The page of the message's own session that begins at it. A session id in its place is told apart from an unknown id."""
    found = messages.where(F.col("message_id") == message_id).select("session_id").distinct().orderBy("session_id").limit(2).collect()
    if not found:
        if not messages.where(F.col("session_id") == message_id).isEmpty():
            raise NotFound(f"{message_id} is a session, not a message: read it as a session, or name one of its messages")
        raise NotFound(f"no message {message_id}")
    if len(found) > 1:
        raise NotFound(f"{message_id} is in several sessions ({found[0][0]}, {found[1][0]}, ..): name the session too")
    return {"session_id": found[0][0], **session_page(messages, found[0][0], message_id, "at", **options)}


def whole_session(messages: DataFrame, parts: DataFrame, session_id: str, time: str = "timestamp") -> DataFrame:
    """Every row of one session, a row a part (one with NULLs for a message without any), in the order of reading."""
    m = messages.where(F.col("session_id") == session_id)
    p = parts.where(F.col("session_id") == session_id).drop("session_id").withColumnsRenamed({"id": "part_id", "options": "part_options"})
    return m.join(p.distinct(), "message_id", "left").orderBy(F.col(time).asc_nulls_last(), "message_id", "ordinal", "part_id")


def pending(texts: DataFrame, key: str, model: str, stale: bool = False) -> DataFrame:
    """Rows still to be embedded: those with text and no vector, and with ``stale`` also those of another model."""
    missing = F.col("vector").isNull()
    return texts.where(F.col("search_text").isNotNull() & (missing | (F.col("embedding_model") != model) if stale else missing)).select(key, "search_text")


def embedding_state(texts: DataFrame, model: str) -> dict:
    """Whether any vector is stored, one model that was used, and whether that differs from ``model``."""
    one = texts.where("vector is not null").select("embedding_model").limit(1).collect()
    return {"has_embeddings": bool(one), "model": one[0][0] if one else None, "swapped": bool(one) and one[0][0] != model}


def message_context(messages: DataFrame, targets: DataFrame, before: int = 3, after: int = 3, time: str = "timestamp") -> DataFrame:
    """(target, message_id, offset): the conversational neighbours of each target (session_id, message_id)."""
    rows = in_order(messages.where("search_text is not null"), time).select("session_id", "message_id", "position")
    t = rows.join(targets.select("session_id", "message_id").distinct(), ["session_id", "message_id"])
    near = t.select("session_id", F.col("message_id").alias("target"), F.explode(F.sequence(F.col("position") - before, F.col("position") + after)).alias("position"), F.col("position").alias("at"))
    return near.join(rows, ["session_id", "position"]).select("session_id", "target", "message_id", (F.col("position") - F.col("at")).cast("bigint").alias("offset"))


def parts_of(parts: DataFrame, messages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    rows = parts.join(messages.select("session_id", "message_id").distinct(), ["session_id", "message_id"], "left_semi")
    return (rows.where(F.col("type").isin(kinds)) if kinds else rows).orderBy("session_id", "message_id", "ordinal", "id")


def session_counts(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, messages, parts) of every session, 0 where there are none."""
    ids = sessions.select(F.col("id").alias("session_id")).where("session_id is not null").distinct()
    m = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    p = parts.groupBy("session_id").agg(F.count("*").alias("parts"))
    return ids.join(m, "session_id", "left").join(p, "session_id", "left").fillna(0, ["messages", "parts"])


def last_message(sessions: DataFrame, messages: DataFrame, time: str = "timestamp") -> DataFrame:
    """(session_id, last_message_id) by time and id, only for sessions that have a row."""
    last = messages.groupBy("session_id").agg(F.max_by("message_id", F.struct(time, "message_id")).alias("last_message_id"))
    return last.join(sessions.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")


def watermark(messages: DataFrame, time: str = "timestamp") -> DataFrame:
    return messages.groupBy("session_id").agg(F.max(time).alias("watermark"))


def freshness(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """(session_id, status) of sources (session_id, source_us) against stored watermarks (session_id, stored_us).

    ``fresh`` if the source is not newer than what is stored, ``empty`` where nothing was read
    (NULL source that is listed as such), ``stale`` otherwise; a NULL stored mark is always stale.
    """
    j = sources.join(stored, "session_id", "left")
    return j.select("session_id", "source_us", "stored_us", F.when(F.col("source_us").isNull(), "empty").when(F.col("source_us") <= F.col("stored_us"), "fresh").otherwise("stale").alias("status"))


def agents(sessions: DataFrame, subagents: bool = True) -> DataFrame:
    rows = sessions.select("source_agent").where("source_agent is not null").distinct()
    return rows if subagents else rows.where(~F.col("source_agent").contains("/"))


def host_activity(messages: DataFrame, host: Column, time: str = "timestamp") -> DataFrame:
    """(host, sessions, last): sessions and newest time per ingesting host; NULL hosts form a group."""
    return messages.groupBy(host.alias("host")).agg(F.count_distinct("session_id").alias("sessions"), F.max(time).alias("last"))


def usage(rows: DataFrame, group: list[str], request: str, amount: str) -> DataFrame:
    """Total of ``amount`` when a request is reported by several messages: the largest per request, then the sum."""
    per = rows.where(F.col(request).isNotNull()).groupBy(*group, request).agg(F.max(amount).alias("n"))
    return per.groupBy(*group).agg(F.count("*").alias("requests"), F.sum("n").alias("total"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row (rows, keys, duplicates). Keys are counted after a map-side combine."""
    per = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
