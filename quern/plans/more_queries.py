"""More queries over the archive: the SQL surface statement by statement, the store, search, archives; each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import archive_io, bm25, derive, reads, search
from quern.operators.text_index import TextIndex, index_of
from quern.plans.archive_queries import _CUTOFF, _WS, _bm25_sql, M, ORACLES, QUERIES, T, W, messages_of, ntz, query, surface, texts_of
from quern.session import cut, fresh_path, table
from quern.store import Store


def _label(sf: str) -> str:
    return hashlib.sha256(sf.encode()).hexdigest()[:16]


def documents_index(spark: SparkSession, sf: str, stemming: bool = False) -> TextIndex:
    return index_of(table(spark, sf, "documents"), ["doc_id"], "text", f"documents-{_label(sf)}", stemming)


def messages_index(spark: SparkSession, sf: str, stemming: bool = False) -> TextIndex:
    return index_of(texts_of(spark, sf), ["session_id", "message_id"], "search_text", f"messages-{_label(sf)}", stemming)


# The SQL surface


@query("SELECT id, result ->> '$[0].text' AS text, result ->> '$[0].type' AS kind FROM parts WHERE type = 'tool_result' AND json_valid(result) AND json_type(result) = 'ARRAY'")
def sql_key_paths(spark, sf):
    return surface(spark, sf).frame("SELECT id, json_get_string(result, 0, 'text') AS text, json_get_string(result, 0, 'type') AS kind FROM parts WHERE type = 'tool_result' AND starts_with(result, '[')")


@query("SELECT \"source_agent\" AS agent, 'it''s copied from messages' AS note, count(*) AS n FROM sessions GROUP BY \"source_agent\"")
def sql_quoted_names(spark, sf):
    return surface(spark, sf).frame(ORACLES["sql_quoted_names"])


@query(W + M + " SELECT session_id, message_id, strftime(seen_at, '%Y-%m-%dT%H:%M:%S') AS seen, strftime(seen_at, 'day %j of %Y') AS day FROM m")
def sql_to_char(spark, sf):
    return surface(spark, sf).frame("SELECT session_id, message_id, to_char(seen_at, '%Y-%m-%dT%H:%M:%S') AS seen, to_char(seen_at, 'day %j of %Y') AS day FROM messages")


@query("SELECT ordinal, round(log10(ordinal + 10), 9) AS l, round(ln(ordinal + 1) / ln(2), 9) AS k, count(*) AS n FROM parts WHERE ordinal >= 0 GROUP BY ordinal")
def sql_log(spark, sf):
    return surface(spark, sf).frame("SELECT ordinal, round(log(ordinal + 10), 9) AS l, round(log(2, ordinal + 1), 9) AS k, n FROM (SELECT ordinal, count(*) AS n FROM parts WHERE ordinal >= 0 GROUP BY ordinal) c")


@query(W + M + " SELECT s.project, count(*) AS n, count(DISTINCT m.session_id) AS sessions FROM (SELECT DISTINCT id, project FROM sessions) s , m WHERE s.id = m.session_id AND m.role = 'user' GROUP BY s.project")
def sql_comma_join(spark, sf):
    return surface(spark, sf).frame("SELECT s.project, count(*) AS n, count(DISTINCT messages.session_id) AS sessions FROM (SELECT DISTINCT session_id, project FROM sessions) s , messages WHERE s.session_id = messages.session_id AND messages.role = 'user' GROUP BY s.project")


@query(W + M + """, busy AS (SELECT session_id, count(*) AS n FROM m GROUP BY session_id HAVING count(*) > 10), calm AS (SELECT session_id, count(*) AS n FROM m GROUP BY session_id HAVING count(*) <= 2)
SELECT 'busy' AS kind, session_id, n FROM busy UNION ALL SELECT 'calm', session_id, n FROM calm""")
def sql_cte_union_having(spark, sf):
    return surface(spark, sf).frame("""WITH busy AS (SELECT session_id, count(*) AS n FROM messages GROUP BY session_id HAVING count(*) > 10), calm AS (SELECT session_id, count(*) AS n FROM messages GROUP BY session_id HAVING count(*) <= 2)
SELECT 'busy' AS kind, session_id, n FROM busy UNION ALL SELECT 'calm', session_id, n FROM calm""")


@query(W + M + """ SELECT session_id, message_id, role FROM (SELECT session_id, message_id, role, row_number() OVER (PARTITION BY session_id ORDER BY seen_at DESC, message_id) AS rn FROM m) WHERE rn = 1
AND EXISTS (SELECT 1 FROM parts p WHERE p.session_id = session_id AND p.type = 'tool_call')""")
def sql_windows_and_exists(spark, sf):
    return surface(spark, sf).frame("""SELECT session_id, message_id, role FROM (SELECT session_id, message_id, role, row_number() OVER (PARTITION BY session_id ORDER BY seen_at DESC, message_id) AS rn FROM messages) w WHERE rn = 1
AND EXISTS (SELECT 1 FROM parts p WHERE p.type = 'tool_call')""")


@query("SELECT type, count(*) AS n FROM parts GROUP BY type ORDER BY n DESC, type LIMIT 3")
def sql_json_rows(spark, sf):
    """JSON mode: rows within a limit and a budget of bytes."""
    got = surface(spark, sf).rows("SELECT type, count(*) AS n FROM parts GROUP BY type ORDER BY n DESC, type", limit=3)
    return spark.createDataFrame([(r["type"], r["n"]) for r in got["rows"]], "type string, n bigint")


@query("SELECT session_id, type, count(*) AS n FROM parts GROUP BY ALL")
def sql_export_parquet(spark, sf):
    return spark.read.parquet(surface(spark, sf).export("SELECT session_id, type, count(*) AS n FROM parts GROUP BY session_id, type"))


@query("SELECT id AS session_id, count(*) AS n FROM sessions GROUP BY id")
def sql_export_ndjson(spark, sf):
    return spark.read.schema("session_id string, n bigint").json(surface(spark, sf).export("SELECT session_id, count(*) AS n FROM sessions GROUP BY session_id", "ndjson"))


@query(W + T + _bm25_sql("session_id, message_id", "search_text", "t", "duplicate import") + " SELECT session_id, message_id, round(score, 6) AS score FROM s WHERE score > 0")
def sql_fts(spark, sf):
    index = messages_index(spark, sf)
    return surface(spark, sf, index.scores).frame("SELECT session_id, message_id, round(_score, 6) AS score FROM fts('messages', 'duplicate import') WHERE _score > 0")


# Search over stored postings

_DOC = "WITH z AS (SELECT 1)" + _bm25_sql("doc_id", "text", "documents", "threat model firewall")


@query(_DOC + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    return bm25.top(documents_index(spark, sf).scores("threat model firewall"), ["doc_id"], 20).select("doc_id", F.round("score", 6).alias("score"))


@query(_DOC + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_scan_topk(spark, sf):
    """The same from the texts themselves, without an index."""
    return bm25.top(bm25.scores(table(spark, sf, "documents"), ["doc_id"], "text", "threat model firewall"), ["doc_id"], 20).select("doc_id", F.round("score", 6).alias("score"))


@query(_DOC + " SELECT doc_id, round(score, 6) AS score FROM s WHERE matched = 3")
def bm25_all_terms(spark, sf):
    return documents_index(spark, sf).scores("threat model firewall", operator="and").select("doc_id", F.round("score", 6).alias("score"))


@query(_DOC + " SELECT doc_id FROM s WHERE matched = 3 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'botnet'))")
def bm25_boolean(spark, sf):
    return bm25.combine(documents_index(spark, sf).scores, ["doc_id"], must=["threat", "model", "firewall"], must_not=["botnet"]).select("doc_id")


@query(W + T + _bm25_sql("session_id, message_id", "search_text", "t", "duplicate import") + """,
p AS (SELECT *, split_part(session_id, '/', 1) AS root FROM s ORDER BY round(score, 9) DESC, session_id, message_id LIMIT 50), x AS (SELECT max(score) AS best FROM p)
SELECT root, count(*) AS matched, round(max(score / best), 6) AS rank FROM p, x GROUP BY root""")
def bm25_grouped_sessions(spark, sf):
    pool = messages_index(spark, sf).scores("duplicate import").orderBy(F.desc(F.round("score", 9)), "session_id", "message_id").limit(50)
    pool = cut(pool, "pool")  # fifty rows, read twice
    best = F.broadcast(pool.agg(F.max("score").alias("best")))
    base = pool.join(best).withColumn("base", F.col("score") / F.col("best"))
    return base.groupBy(derive.session_root("session_id").alias("root")).agg(F.count("*").alias("matched"), F.round(F.max("base"), 6).alias("rank"))


# Words whose stems the queries below ask for, in the forms that share the stem.
_STEMS = {"vulner": "vulnerable vulnerability vulnerabilities vulnerably", "firewal": "firewall firewalls firewalled firewalling", "duplic": "duplicate duplicates duplicated duplicating duplication", "import": "import imports imported importing importer importance important"}
_FOLDED = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(w) for w in words.split())}) THEN '{stem}'" for stem, words in _STEMS.items()) + " ELSE x END"


def _stemmed_sql(key: str, text: str, src: str, terms: str) -> str:
    return _bm25_sql(key, text, src, terms).replace("lambda x: x <> '') AS words", f"lambda x: x <> '').list_transform(lambda x: {_FOLDED}) AS words", 1)


@query("WITH z AS (SELECT 1)" + _stemmed_sql("doc_id", "text", "documents", "vulner firewal") + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_stemmed(spark, sf):
    return bm25.top(documents_index(spark, sf, stemming=True).scores("vulnerabilities firewalls"), ["doc_id"], 20).select("doc_id", F.round("score", 6).alias("score"))


@query(W + T + _stemmed_sql("session_id, message_id", "search_text", "t", "duplic import") + """,
p AS (SELECT session_id, message_id, score FROM s ORDER BY score DESC, session_id, message_id LIMIT 75), b AS (SELECT p.*, score / max(score) OVER () AS base, split_part(session_id, '/', 1) AS root FROM p),
k AS (SELECT * FROM b WHERE NOT contains(session_id, '/')), r AS (SELECT root FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY base DESC, session_id, message_id) AS rn FROM k) WHERE rn = 1 ORDER BY base DESC, session_id, message_id LIMIT 10),
h AS (SELECT k.*, m.project, m.source_agent FROM k JOIN r USING (root) JOIN m USING (session_id, message_id) WHERE NOT contains(m.source_agent, '/'))
SELECT root, arg_min(project, (-base, session_id, message_id)) AS project, arg_min(source_agent, (-base, session_id, message_id)) AS source_agent, count(*) AS matched, round(max(base), 6) AS rank,
coalesce(any_value(z.n), 0) AS session_messages, CAST(count(*) AS INTEGER) AS hits FROM h LEFT JOIN (SELECT session_id AS root, count(*) AS n FROM m GROUP BY 1) z USING (root) GROUP BY root ORDER BY max(base) DESC, root LIMIT 10""".replace("h AS (SELECT k.*", "hh AS (SELECT k.*").replace("FROM h LEFT", "FROM hh LEFT"))
def search_sessions(spark, sf):
    m = texts_of(spark, sf).drop("timestamp").withColumnRenamed("seen_at", "timestamp")
    found = search.search(m, search.Request("duplicate imports", 10), now=F.lit("2026-01-01 00:00:00").cast("timestamp"), index=messages_index(spark, sf, stemming=True))
    return found.select("root", "project", "source_agent", "matched", F.round("rank", 6).alias("rank"), "session_messages", F.size("hits").alias("hits"))


@query("WITH z AS (SELECT 1)" + _bm25_sql("doc_id", "text", "documents", "threat model") + """, k AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 10),
a AS (SELECT doc_id, text, length(text) AS n, [x FOR x IN [strpos(lower(text), 'threat') - 1, strpos(lower(text), 'model') - 1] IF x >= 0] AS spots FROM documents JOIN k USING (doc_id)),
c AS (SELECT *, greatest(0, least(coalesce(list_min(spots), 0) - 300, n - 600)) AS start FROM a)
SELECT doc_id, CASE WHEN n <= 600 THEN text ELSE (CASE WHEN start > 0 THEN '[' || start || ' chars before] ' ELSE '' END) || substr(text, start + 1, 600) || (CASE WHEN n - start - 600 > 0 THEN ' [+' || (n - start - 600) || ' more chars]' ELSE '' END) END AS snippet FROM c""")
def search_snippets(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    hits = bm25.top(documents_index(spark, sf).scores("threat model"), ["doc_id"], 10).join(d, "doc_id")
    return search.snippets(hits, "text", "threat model").select("doc_id", "snippet")


@query(W + M + f""", h AS (SELECT session_id, message_id FROM m WHERE delivery_id % 50 = 0),
l AS (SELECT DISTINCT session_id, message_id, ordinal, id, CASE WHEN type = 'file' THEN coalesce(file_name, media_type) WHEN type = 'tool_result' AND is_failure THEN coalesce(tool_name, 'tool') || ' (failed)' WHEN type IN ('tool_call', 'tool_result') THEN tool_name END AS label
  FROM (SELECT * REPLACE (lower(trim(message_id, {_WS})) AS message_id) FROM parts))
SELECT h.session_id, h.message_id, s.labels FROM h LEFT JOIN (SELECT session_id, message_id, string_agg(label, ', ' ORDER BY ordinal NULLS FIRST, id, label) AS labels FROM l WHERE label IS NOT NULL GROUP BY ALL) s USING (session_id, message_id)""")
def hits_with_part_summaries(spark, sf):
    hits = messages_of(spark, sf).where("delivery_id % 50 = 0").select("session_id", "message_id")
    parts = table(spark, sf, "parts").withColumn("message_id", derive.id_key("message_id"))
    return search.with_part_summaries(hits, parts).select("session_id", "message_id", F.array_join("summaries", ", ").alias("labels"))


# Reads


@query(W + M + """, b AS (SELECT session_id FROM m GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)
SELECT m.message_id, p.id AS part_id, CAST(p.ordinal AS BIGINT) AS ordinal, p.type FROM m JOIN b USING (session_id) LEFT JOIN (SELECT DISTINCT * REPLACE (lower(trim(message_id, """ + _WS + """)) AS message_id) FROM parts) p ON p.session_id = m.session_id AND p.message_id = m.message_id""")
def whole_session(spark, sf):
    m = messages_of(spark, sf)
    largest = m.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()[0]
    parts = table(spark, sf, "parts").withColumn("message_id", derive.id_key("message_id"))
    narrow = parts.select("session_id", "message_id", "id", "ordinal", "type", "options", "text", "params", "result", "tool_name", "call_id")
    return reads.whole_session(m.select("session_id", "message_id", "seen_at"), narrow, largest, "seen_at").select("message_id", "part_id", F.col("ordinal").cast("bigint").alias("ordinal"), "type")


@query(W + T + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen_at, message_id) AS position FROM t WHERE search_text IS NOT NULL),
b AS (SELECT session_id FROM o GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1) SELECT message_id, position FROM o JOIN b USING (session_id) WHERE position BETWEEN 3 AND 12""")
def page_of_a_message(spark, sf):
    """The page of a session that begins at its third message, asked for by the message."""
    rows = cut(texts_of(spark, sf).where("search_text is not null").select("session_id", "message_id", "seen_at", "search_text"), "texts")
    largest = rows.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()[0]
    third = reads.in_order(rows.where(F.col("session_id") == largest), "seen_at").where("position = 3").first()["message_id"]
    page = reads.session_page(rows, largest, third, "at", limit=10, budget=10**9, time="seen_at")
    return spark.createDataFrame([(r["message_id"], r["position"]) for r in page["messages"]], "message_id string, position bigint")


@query(W + M + " SELECT session_id, message_id, strftime(seen_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS seen FROM m")
def timestamps_as_text(spark, sf):
    return messages_of(spark, sf).select("session_id", "message_id", derive.rfc3339("seen_at").alias("seen"))


@query("""SELECT session_id, message_id, id, CASE WHEN type IN ('text', 'reasoning') THEN text END AS text, CASE WHEN type IN ('tool_call', 'tool_result') THEN tool_name END AS tool_name, CASE WHEN type IN ('tool_call', 'tool_result') THEN call_id END AS call_id,
CASE WHEN type = 'tool_result' THEN is_failure END AS is_failure, CASE WHEN type = 'tool_call' THEN params END AS params, CASE WHEN type = 'tool_result' THEN result END AS result, CASE WHEN type = 'file' THEN file_name END AS file_name FROM parts""")
def part_bodies(spark, sf):
    """Parts written into one body each and read back."""
    return derive.part_from_body(derive.part_body(table(spark, sf, "parts"))).select("session_id", "message_id", "id", "text", "tool_name", "call_id", "is_failure", "params", "result", "file_name")


# The store


def _keyed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf, t) for t in ("sessions", "messages", "parts")}


@query("""SELECT 'sessions' AS "table", count(DISTINCT id) AS n FROM sessions UNION ALL SELECT 'messages', count(*) FROM (SELECT DISTINCT session_id, id FROM messages WHERE session_id IS NOT NULL AND id IS NOT NULL)
UNION ALL SELECT 'parts', count(*) FROM (SELECT DISTINCT session_id, message_id, id FROM parts WHERE session_id IS NOT NULL AND message_id IS NOT NULL AND id IS NOT NULL)""")
def store_counts(spark, sf):
    """Rows per table after the same rows were appended twice."""
    store = Store(spark, fresh_path(spark, "counts"))
    for _ in range(2):
        for name, df in _keyed(spark, sf).items():
            store.append_absent(name, df)
    return spark.createDataFrame(list(store.counts().items()), "`table` string, n bigint")


@query(W + M + f" SELECT session_id, message_id FROM m WHERE seen_at < TIMESTAMP '{_CUTOFF}'")
def store_snapshot(spark, sf):
    """The version before a later append is read as it was."""
    m = messages_of(spark, sf).select("session_id", F.col("message_id").alias("id"), "seen_at")
    store = Store(spark, fresh_path(spark, "snapshot"))
    early = F.col("seen_at") < F.lit(_CUTOFF).cast("timestamp")
    store.append("messages", m.where(early))
    first = store.version("messages")
    store.append("messages", m.where(~early))
    return store.table("messages", version=first).select("session_id", F.col("id").alias("message_id"))


@query(W + M + " SELECT session_id, message_id, CASE WHEN role = 'user' THEN 'changed' ELSE project END AS project FROM m")
def store_update_matched(spark, sf):
    """Rows with a stored key get new values; an update without a match is dropped."""
    m = messages_of(spark, sf).select("session_id", F.col("message_id").alias("id"), "project", "role")
    store = Store(spark, fresh_path(spark, "update"))
    store.append("messages", m)
    updates = m.where("role = 'user'").select("session_id", "id", F.lit("changed").alias("project"))
    nowhere = spark.createDataFrame([("nowhere", "x", "changed")], "session_id string, id string, project string")
    store.update_matched("messages", updates.unionByName(nowhere))
    return store.table("messages").select("session_id", F.col("id").alias("message_id"), "project")


@query("SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL")
def archive_round_trip(spark, sf):
    """Exported as a folder, imported twice into an empty store."""
    a, b = Store(spark, fresh_path(spark, "a")), Store(spark, fresh_path(spark, "b"))
    for name, df in _keyed(spark, sf).items():
        a.append_absent(name, df)
    path = fresh_path(spark, "archive")
    archive_io.export_archive(a, path)
    for _ in range(2):
        archive_io.import_archive(spark, path, b)
    return b.table("sessions").select("id")


@query("""WITH h AS (SELECT session_id, max(CASE WHEN source_ts > 0 THEN CASE WHEN source_ts < 100000000000 THEN source_ts * 1000000 WHEN source_ts < 100000000000000 THEN source_ts * 1000 WHEN source_ts < 100000000000000000 THEN source_ts ELSE source_ts // 1000 END END) AS source_us FROM head_entries GROUP BY 1),
s AS (SELECT session_id, max(epoch_us(delivered_at)) AS stored_us FROM messages GROUP BY 1), a AS (SELECT id AS session_id, min(source_agent) AS client FROM sessions GROUP BY 1)
SELECT session_id, CASE WHEN client IS NULL OR client NOT IN ('claude-code', 'codex-cli', 'hermes', 'opencode') THEN 'unsupported' WHEN source_us IS NULL THEN 'empty' WHEN source_us <= stored_us THEN 'fresh' END AS reason FROM h LEFT JOIN s USING (session_id) LEFT JOIN a USING (session_id)""")
def skip_reasons(spark, sf):
    from quern.operators.instants import epoch_us

    heads = table(spark, sf, "head_entries").groupBy("session_id").agg(F.max(epoch_us(F.col("source_ts"))).alias("source_us"))
    stored = table(spark, sf, "messages").groupBy("session_id").agg(F.max(F.unix_micros("delivered_at")).alias("stored_us"))
    clients = table(spark, sf, "sessions").groupBy(F.col("id").alias("session_id")).agg(F.min("source_agent").alias("client"))
    rows = heads.join(stored, "session_id", "left").join(clients, "session_id", "left").withColumn("client", F.coalesce("client", F.lit("")))
    return archive_io.skip_reasons(rows, ["claude-code", "codex-cli", "hermes", "opencode"])


__all__ = ["ORACLES", "QUERIES", "ntz"]
