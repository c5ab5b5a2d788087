"""The search pipeline: pool, score, keep the best sessions, boost, group, order, cut snippets.

Every step is a DataFrame operation on the pool, whose size is fixed by the request (at most
a few thousand rows), so the pipeline above the retrieval costs the same on any corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import bm25, vectors
from quern.operators.derive import is_subagent, part_label, session_root, tool_identity
from quern.operators.text_index import TextIndex

MAX_LIMIT, SNIPPET, LEAST_POOL = 200, 600, 50


class SearchError(ValueError):
    """A request that cannot be answered as stated."""


@dataclass(frozen=True)
class Request:
    query: str = ""
    limit: int = 10
    mode: str = "fts"  # or "vector"
    sort_by: str = "relevance"  # or "recency"
    exclude_subagents: bool = True
    vector: tuple[float, ...] | None = None

    def checked(self) -> Request:
        if self.mode not in ("fts", "vector") or self.sort_by not in ("relevance", "recency"):
            raise SearchError("mode is fts or vector, sort_by is relevance or recency")
        if self.mode == "fts" and not self.query.strip():
            raise SearchError("the query is empty")
        if self.mode == "vector" and self.vector is None:
            raise SearchError("a vector search needs a query vector")
        if self.limit < 1:
            raise SearchError("limit must be at least 1")
        return Request(self.query.strip(), min(self.limit, MAX_LIMIT), self.mode, self.sort_by, self.exclude_subagents, self.vector)

    def pool(self) -> int:
        size = max(self.limit * 5, LEAST_POOL) * (2 if self.mode == "vector" else 1)
        return size * 3 // 2 if self.exclude_subagents else size


def retrieve(scoped: DataFrame, request: Request, index: TextIndex | None = None) -> DataFrame:
    """(session_id, message_id, base) of the pool, from rows that already passed the filter.

    Words are folded and stemmed. With an ``index`` only the postings of the query's words are read; without one the texts are.
    """
    if request.mode == "fts":
        key = ["session_id", "message_id"]
        scored = bm25.scores(scoped, key, "search_text", request.query, stemming=True) if index is None else index.scores(request.query).join(scoped.select(*key), key, "left_semi")
        pool = bm25.top(scored, ["session_id", "message_id"], request.pool())
        best = F.max("score").over(Window.partitionBy())
        return pool.withColumn("base", F.when(best > 0, F.col("score") / best).otherwise(0.0)).drop("score")
    q = F.array(*[F.lit(float(x)) for x in request.vector or ()])
    near = scoped.where("vector is not null").select("session_id", "message_id", vectors.cosine(F.col("vector"), q).alias("base")).where("base is not null")
    return near.orderBy(F.desc("base"), "session_id", "message_id").limit(request.pool())


def keep_roots(pool: DataFrame, limit: int) -> DataFrame:
    """Every hit of the first ``limit`` distinct session roots by best score."""
    rows = pool.withColumn("root", session_root("session_id"))
    order = Window.partitionBy("root").orderBy(F.desc("base"), "session_id", "message_id")
    best = rows.withColumn("r", F.row_number().over(order)).where("r = 1").orderBy(F.desc("base"), "session_id", "message_id").limit(limit).select("root")
    return rows.join(F.broadcast(best), "root", "left_semi")


def search(messages: DataFrame, request: Request, scope: Column | None = None, now: Column | None = None, index: TextIndex | None = None) -> DataFrame:
    """Ranked sessions with their hits.

    ``messages``: session_id, message_id, source_agent, project, timestamp, search_text[, vector].
    Result: root, project, source_agent, matched, rank, session_messages, hits (newest first).
    """
    request = request.checked()
    now = F.current_timestamp() if now is None else now
    scoped = messages if scope is None else messages.where(scope)
    if request.exclude_subagents:
        scoped_pool = retrieve(scoped, request, index).where(~F.col("session_id").contains("/"))
    else:
        scoped_pool = retrieve(scoped, request, index)
    kept = keep_roots(scoped_pool, request.limit)
    facts = messages.select("session_id", "message_id", "source_agent", "project", "timestamp")
    hits = facts.join(F.broadcast(kept), ["session_id", "message_id"])
    if request.exclude_subagents:
        hits = hits.where(~is_subagent("source_agent"))
    if request.sort_by == "recency":
        order = F.unix_seconds("timestamp").cast("double")
    elif request.mode == "vector":
        order = F.col("base") + vectors.recency(F.col("timestamp"), now)
    else:
        order = F.col("base")
    ordered = hits.withColumn("ord", order)
    first = F.struct(-F.col("ord"), F.col("session_id"), F.col("message_id"))
    hit = F.struct((-F.unix_micros("timestamp")).alias("newest"), F.col("message_id"), F.col("session_id"), F.col("base"))
    groups = ordered.groupBy("root").agg(F.min_by("project", first).alias("project"), F.min_by("source_agent", first).alias("source_agent"), F.count("*").alias("matched"), F.max("ord").alias("rank"), F.sort_array(F.collect_list(hit)).alias("hits"))
    sizes = messages.groupBy(F.col("session_id").alias("root")).agg(F.count("*").alias("session_messages"))
    sized = sizes.join(F.broadcast(groups.select("root")), "root", "left_semi")
    return groups.join(sized, "root", "left").fillna(0, ["session_messages"]).orderBy(F.desc("rank"), "root").limit(request.limit)


def with_part_summaries(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Hits (session_id, message_id, ..) with ``summaries``: the labels of their message's tool and file parts, in order."""
    labels = part_label(tool_identity(parts)).where("label is not null").join(F.broadcast(hits.select("session_id", "message_id").distinct()), ["session_id", "message_id"], "left_semi")
    own = labels.groupBy("session_id", "message_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("ordinal", "id", "label"))), lambda x: x["label"]).alias("summaries"))
    return hits.join(own, ["session_id", "message_id"], "left")


TRANSCRIPT = 10_000


def transcript(groups: list[dict], texts: dict[tuple[str, str], str], budget: int = TRANSCRIPT) -> str:
    """Found sessions as text within a budget of characters, shared evenly over the sessions that remain.

    ``groups`` are the rows of ``search`` as dictionaries. Of each session the newest hit always shows; others
    follow while its share lasts.
    """
    out: list[str] = []
    left = budget
    for i, g in enumerate(groups):
        share, used = max(left, 0) // (len(groups) - i), 0
        lines = [f"# {g['root']} ({g['project'] or 'no project'}, {g['matched']} hits, best {max(h['base'] for h in g['hits']):.3f})"]
        for n, h in enumerate(g["hits"]):
            line = f"[{h['message_id']}] {texts.get((h['session_id'], h['message_id']), '')}"
            if n and used + len(line) > share:
                lines.append(f"({len(g['hits']) - n} more)")
                break
            lines.append(line)
            used += len(line)
        left -= used
        out.append("\n".join(lines))
    return "\n\n".join(out)


def arm(mode: str, enabled: bool, embedded: bool) -> str:
    """The arm that answers: a vector search is refused where embeddings are off, and answered by words where none is stored yet."""
    if mode == "vector" and not enabled:
        raise SearchError("embeddings are disabled; search by words with mode fts")
    return "fts" if mode == "vector" and not embedded else mode


def searchable(messages: DataFrame, scope: Column | None = None) -> DataFrame:
    """One row: how many messages of the scope have searchable text."""
    rows = messages if scope is None else messages.where(scope)
    return rows.where("search_text is not null").agg(F.count("*").alias("searchable"))


def snippet_of(text: str, query: str, size: int = SNIPPET) -> str:
    """The text, or a window of ``size`` characters around the earliest informative word of the query."""
    if text is None or len(text) <= size:
        return text
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    telling = [w for w in words if len(w) >= 4] or words
    low = text.lower()
    found = [i for i in (low.find(w) for w in telling) if i >= 0]
    middle = min(found) if found else 0
    start = max(0, min(middle - size // 2, len(text) - size))
    before, after = start, len(text) - start - size
    return (f"[{before} chars before] " if before else "") + text[start : start + size] + (f" [+{after} more chars]" if after else "")


def snippets(rows: DataFrame, text: str, query: str) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, query))

    return rows.withColumn("snippet", cut(text))
