"""Queries over the archive, one a operator, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fulltext, json_getters
from quern.operators import copying, derive, hierarchy, ingest, instants, reads, upsert, vectors
from quern.plans.sql_surface import SqlSurface
from quern.session import cut, fresh_path, table
from quern.store import Store
from quern.streaming.ingest import windowed_activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ntz(col: str):
    return F.col(col).cast("timestamp_ntz")


def messages_of(spark: SparkSession, sf: str) -> DataFrame:
    """One row per message with ``message_id`` in comparison form, canonical role and ``seen_at`` (its earliest delivery)."""
    m = upsert.deduplicate(table(spark, sf, "messages"))
    return m.drop("id").withColumnsRenamed({"message_key": "message_id", "delivered_at": "seen_at"}).withColumn("role", derive.canonical_role("role"))


def texts_of(spark: SparkSession, sf: str) -> DataFrame:
    """``messages_of`` with ``search_text`` (NULL for system and tool messages)."""
    m = messages_of(spark, sf)
    keyed = m.select("session_id", F.col("message_id").alias("message_key"), "role")
    text = derive.search_text(keyed, table(spark, sf, "parts")).withColumnRenamed("message_key", "message_id")
    return m.join(text, ["session_id", "message_id"], "left")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ROLE = f"CASE WHEN lower(trim(role, {_WS})) IN ('system','developer') THEN 'system' WHEN lower(trim(role, {_WS})) IN ('user','human') THEN 'user' WHEN lower(trim(role, {_WS})) IN ('assistant','ai','model') THEN 'assistant' WHEN lower(trim(role, {_WS})) IN ('tool','function','toolresult') THEN 'tool' END"
M = f"""m AS (SELECT * EXCLUDE (id, rn, role), {_ROLE} AS role, CAST(delivered_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS seen_at FROM (
  SELECT *, lower(trim(id, {_WS})) AS message_id, row_number() OVER (PARTITION BY session_id, lower(trim(id, {_WS})) ORDER BY delivered_at, delivery_id) AS rn
  FROM messages WHERE session_id IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)"""
T = (
    M
    + f""", chunk AS (SELECT DISTINCT session_id, lower(trim(message_id, {_WS})) AS message_id, id, ordinal, pos, chunk FROM (
  SELECT session_id, message_id, id, ordinal, 0 AS pos, text AS chunk FROM parts WHERE provenance = 'conversational' AND type = 'text'
  UNION ALL SELECT session_id, message_id, id, ordinal, 0, file_name FROM parts WHERE provenance = 'conversational' AND type = 'file'
  UNION ALL SELECT session_id, message_id, id, ordinal, 1, media_type FROM parts WHERE provenance = 'conversational' AND type = 'file') WHERE trim(chunk, {_WS}) <> ''),
txt AS (SELECT session_id, message_id, string_agg(chunk, chr(10) ORDER BY ordinal, id, pos) AS search_text FROM chunk GROUP BY ALL),
t AS (SELECT m.*, CASE WHEN m.role IN ('user', 'assistant') THEN txt.search_text END AS search_text FROM m LEFT JOIN txt USING (session_id, message_id))"""
)
W = "WITH "


# Activity, derivations and aggregates


@query(W + M + " SELECT role, count(*) AS n, count(DISTINCT session_id) AS sessions FROM m GROUP BY role")
def role_activity(spark, sf):
    return messages_of(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query(W + T + " SELECT session_id, message_id, search_text FROM t WHERE role IN ('user', 'assistant')")
def search_text(spark, sf):
    return texts_of(spark, sf).where("role in ('user', 'assistant')").select("session_id", "message_id", "search_text")


@query(W + T + " SELECT project, count(*) AS searchable FROM t WHERE search_text IS NOT NULL AND contains(project, 'lantern') GROUP BY project")
def searchable_in_scope(spark, sf):
    return texts_of(spark, sf).where(derive.scope(project="lantern")).where("search_text is not null").groupBy("project").agg(F.count("*").alias("searchable"))


@query(W + M + " SELECT s.session_id, coalesce(a.n, 0) AS messages, coalesce(b.n, 0) AS parts FROM (SELECT DISTINCT id AS session_id FROM sessions) s LEFT JOIN (SELECT session_id, count(*) AS n FROM m GROUP BY 1) a USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM parts GROUP BY 1) b USING (session_id)")
def session_counts(spark, sf):
    return reads.session_counts(table(spark, sf, "sessions"), messages_of(spark, sf), table(spark, sf, "parts"))


@query(W + M + " SELECT session_id, arg_max(message_id, (seen_at, message_id)) AS last_message_id FROM m WHERE session_id IN (SELECT id FROM sessions) GROUP BY session_id")
def session_last_message(spark, sf):
    return reads.last_message(table(spark, sf, "sessions"), messages_of(spark, sf), "seen_at")


@query(W + M + " SELECT session_id, max(seen_at) AS watermark FROM m GROUP BY session_id")
def session_watermark(spark, sf):
    return reads.watermark(messages_of(spark, sf), "seen_at").withColumn("watermark", ntz("watermark"))


@query("SELECT DISTINCT source_agent FROM sessions WHERE source_agent IS NOT NULL AND NOT contains(source_agent, '/')")
def source_agents(spark, sf):
    return reads.agents(table(spark, sf, "sessions"), subagents=False)


@query(W + M + """ SELECT CASE WHEN json_valid(options) THEN nullif(regexp_extract(options, '"ingest":[{]"host":[{]"hostname":"([^"]*)"', 1), '') END AS host, count(DISTINCT session_id) AS sessions, max(seen_at) AS last FROM m GROUP BY 1""")
def ingest_host_activity(spark, sf):
    stamp = F.regexp_extract("options", r'"ingest":[{]"host":[{]"hostname":"([^"]*)"', 1)
    host = F.when(json_getters.as_variant("options").isNotNull() & (stamp != ""), stamp)
    return reads.host_activity(messages_of(spark, sf), host, "seen_at").withColumn("last", ntz("last"))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM messages GROUP BY session_id, id)")
def pk_duplicates(spark, sf):
    return reads.duplicate_keys(table(spark, sf, "messages"), ["session_id", "id"])


@query(W + M + """, u AS (SELECT source_agent, coalesce(options ->> '$.provider.request', options ->> '$.request_id') AS request, TRY_CAST(options ->> '$.usage.completion' AS BIGINT) AS tokens FROM m WHERE json_valid(options))
SELECT source_agent, count(*) AS requests, CAST(sum(n) AS BIGINT) AS total FROM (SELECT source_agent, request, max(tokens) AS n FROM u WHERE request IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def usage_dedup_max_then_sum(spark, sf):
    v = F.col("v")
    m = messages_of(spark, sf).withColumn("v", json_getters.as_variant("options"))
    rows = m.select("source_agent", F.coalesce(json_getters.get_string(v, "provider", "request"), json_getters.get_string(v, "request_id")).alias("request"), json_getters.get_int(v, "usage", "completion").alias("tokens"))
    return reads.usage(rows, ["source_agent"], "request", "tokens")


@query("SELECT count(*) FILTER (WHERE e.vec_id IS NOT NULL) AS embedded, count(*) FILTER (WHERE e.vec_id IS NULL) AS pending FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.text IS NOT NULL")
def embedding_progress(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    d = table(spark, sf, "documents").where("text is not null").join(e, "doc_id", "left")
    return d.agg(F.count("has").alias("embedded"), F.count_if(F.col("has").isNull()).alias("pending"))


@query("""SELECT session_id, message_id, id, type, CASE WHEN type IN ('tool_call', 'tool_result') THEN tool_name END AS tool_name, CASE WHEN type IN ('tool_call', 'tool_result', 'tool_approval_request') THEN call_id END AS call_id, CASE WHEN type = 'tool_result' THEN is_failure END AS is_failure,
CASE WHEN type = 'file' THEN coalesce(file_name, media_type) WHEN type = 'tool_result' AND is_failure THEN coalesce(tool_name, 'tool') || ' (failed)' WHEN type IN ('tool_call', 'tool_result') THEN tool_name END AS label FROM parts""")
def part_summaries(spark, sf):
    return derive.part_label(derive.tool_identity(table(spark, sf, "parts"))).select("session_id", "message_id", "id", "type", "tool_name", "call_id", "is_failure", "label")


@query("""SELECT session_id, message_id, printf('%s:%04d', message_id, ordinal) AS part_id, CASE WHEN regexp_matches(ltrim(text), '^(<task-notification>|<command-name>|<command-message>|<command-args>|<local-command-caveat>|<local-command-stdout>|\\[Request interrupted by user)') THEN 'injected' ELSE 'conversational' END AS judged FROM parts WHERE type = 'text' AND ordinal IS NOT NULL""")
def user_provenance(spark, sf):
    p = table(spark, sf, "parts").where("type = 'text' and ordinal is not null")
    return p.select("session_id", "message_id", derive.part_id("message_id", "ordinal").alias("part_id"), derive.user_provenance("text").alias("judged"))


@query(W + M + " SELECT split_part(session_id, '/', 1) AS root, count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE contains(source_agent, '/')) AS by_subagents FROM m GROUP BY 1")
def session_roots(spark, sf):
    m = messages_of(spark, sf)
    return m.groupBy(derive.session_root("session_id").alias("root")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.count_if(derive.is_subagent("source_agent")).alias("by_subagents"))


@query(W + M + " SELECT session_id, message_id FROM m WHERE NOT contains(session_id, '/') AND NOT contains(source_agent, '/')")
def subagent_filter(spark, sf):
    return messages_of(spark, sf).where(~F.col("session_id").contains("/") & ~derive.is_subagent("source_agent")).select("session_id", "message_id")


@query(W + M + """ SELECT session_id, message_id FROM m WHERE contains(project, 'api') AND regexp_matches(source_agent, '^claude-code(/|$)') AND role <> 'system' AND content IS NULL
AND (role = 'user' OR role = 'assistant') AND seen_at >= TIMESTAMP '2024-06-01 00:00:00' AND seen_at <= TIMESTAMP '2025-06-30 23:59:59' AND NOT (hostname = 'heronpad')""")
def predicate_scope(spark, sf):
    P = derive.P
    scope = P.all_of(derive.scope(project="api", source_agent="claude-code", from_date="2024-06-01", to_date="2025-06-30", timestamp="seen_at"), P.ne("role", "system"), P.is_null("content"), P.any_of(P.eq("role", "user"), P.eq("role", "assistant"), None), P.not_(P.eq("hostname", "heronpad")))
    return messages_of(spark, sf).where(scope).select("session_id", "message_id")


@query("""SELECT h.session_id, h.source_us, s.stored_us, CASE WHEN h.source_us IS NULL THEN 'empty' WHEN h.source_us <= s.stored_us THEN 'fresh' ELSE 'stale' END AS status FROM (
SELECT session_id, max(CASE WHEN source_ts > 0 THEN CASE WHEN source_ts < 100000000000 THEN source_ts * 1000000 WHEN source_ts < 100000000000000 THEN source_ts * 1000 WHEN source_ts < 100000000000000000 THEN source_ts ELSE source_ts // 1000 END END) AS source_us FROM head_entries GROUP BY 1) h
LEFT JOIN (SELECT session_id, max(epoch_us(delivered_at)) AS stored_us FROM messages GROUP BY 1) s USING (session_id)""")
def freshness_gate(spark, sf):
    heads = table(spark, sf, "head_entries").groupBy("session_id").agg(F.max(instants.epoch_us(F.col("source_ts"))).alias("source_us"))
    stored = table(spark, sf, "messages").groupBy("session_id").agg(F.max(F.unix_micros("delivered_at")).alias("stored_us"))
    return reads.freshness(heads, stored)


# Reads: pages, context, lineage


@query(W + T + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen_at, message_id) AS position FROM t WHERE search_text IS NOT NULL),
b AS (SELECT *, sum(octet_length(encode(search_text))) OVER (PARTITION BY session_id ORDER BY position) AS used FROM o)
SELECT session_id, message_id, position FROM b WHERE position <= 20 AND (position = 1 OR used <= 2000)""")
def turn_page_forward(spark, sf):
    rows = reads.in_order(texts_of(spark, sf).where("search_text is not null"), "seen_at")
    return reads.page(rows, 20, 2000).select("session_id", "message_id", F.col("position").cast("bigint").alias("position"))


@query(W + T + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen_at, message_id) AS position FROM t WHERE search_text IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS rn, sum(octet_length(encode(search_text))) OVER (PARTITION BY session_id ORDER BY position DESC) AS used FROM o)
SELECT session_id, message_id, position FROM b WHERE rn <= 10 AND (rn = 1 OR used <= 1000)""")
def turn_page_tail(spark, sf):
    rows = reads.in_order(texts_of(spark, sf).where("search_text is not null"), "seen_at")
    return reads.page(rows, 10, 1000, tail=True).select("session_id", "message_id", F.col("position").cast("bigint").alias("position"))


@query(W + T + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen_at, message_id) AS position FROM t WHERE search_text IS NOT NULL)
SELECT a.session_id, a.message_id AS target, b.message_id, CAST(b.position - a.position AS BIGINT) AS "offset" FROM o a JOIN o b ON a.session_id = b.session_id AND b.position BETWEEN a.position - 3 AND a.position + 3 WHERE a.delivery_id % 50 = 0""")
def message_context_window(spark, sf):
    m = cut(texts_of(spark, sf).select("session_id", "message_id", "search_text", "seen_at", "delivery_id"), "texts")
    return reads.message_context(m, m.where("delivery_id % 50 = 0"), time="seen_at")


@query("""SELECT p.id AS session_id, count(DISTINCT c.id) AS children, min(c.id) AS first_child FROM sessions p JOIN sessions c ON c.parent_session_id = p.id GROUP BY 1""")
def lineage_children(spark, sf):
    s = table(spark, sf, "sessions")
    c = s.select(F.col("parent_session_id").alias("session_id"), F.col("id").alias("child")).where("session_id is not null and child is not null").distinct()
    return c.join(s.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("children"), F.min("child").alias("first_child"))


@query("""WITH e AS (SELECT id, min(CASE WHEN trim(parent_session_id) <> '' THEN parent_session_id END) AS parent FROM sessions WHERE id IS NOT NULL GROUP BY id), k AS (SELECT e.parent AS id, count(*) AS n FROM e JOIN e p ON e.parent = p.id GROUP BY 1)
SELECT e.id AS session_id, CASE WHEN k.n IS NULL THEN 'alone' WHEN EXISTS (SELECT 1 FROM e c JOIN k g ON g.id = c.id WHERE c.parent = e.id) THEN 'too_deep' ELSE 'restorable' END AS state FROM e LEFT JOIN k USING (id)""")
def restore_lineage(spark, sf):
    e = cut(hierarchy.links(table(spark, sf, "sessions"), "id", "parent_session_id"), "links")
    k = e.where("parent is not null").join(e.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    deep = e.join(k, "id", "left_semi").where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("deep", F.lit(True))
    j = e.join(k, "id", "left").join(deep, "id", "left")
    return j.select(F.col("id").alias("session_id"), F.when(F.col("n").isNull(), "alone").when(F.col("deep"), "too_deep").otherwise("restorable").alias("state"))


# Retrieval

_BM25 = """, d AS (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM {src} WHERE {text} IS NOT NULL),
l AS (SELECT *, len(words) AS length FROM d WHERE len(words) > 0), g AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
h AS (SELECT {key}, length, q.term, len(list_filter(words, lambda x: x = q.term)) AS tf FROM l, (SELECT unnest([{terms}]) AS term) q),
f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1),
s AS (SELECT {key}, count(*) AS matched, sum(ln(1 + (g.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / g.mean))) AS score FROM h JOIN f USING (term), g WHERE tf > 0 GROUP BY {key})"""


def _bm25_sql(key: str, text: str, src: str, words: str) -> str:
    return _BM25.format(key=key, text=text, src=src, terms=", ".join(f"'{w}'" for w in sorted(set(words.split()))))




@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), ['threat', 'model', 'The'])")
def contains_all_tokens(spark, sf):
    return table(spark, sf, "documents").where(fulltext.contains_tokens("text", "threat model, The")).select("doc_id")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector(spark: SparkSession, sf: str, number: int) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == number).select("embedding").first()[0]]


@query(f"SELECT e.vec_id, round(1 - {_COS}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY round(1 - {_COS}, 9), e.vec_id LIMIT 15")
def vector_topk(spark, sf):
    return vectors.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf, 7), 15).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH p AS (SELECT e.vec_id, {_COS} AS base FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY round({_COS}, 9) DESC, e.vec_id LIMIT 50)
SELECT vec_id, round(base + 0.02 * exp(-greatest(vec_id / 10.0, 0) / 30.0), 6) AS rank FROM p""")
def vector_recency_rank(spark, sf):
    near = vectors.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf, 7), 50)
    now = F.timestamp_micros(F.lit(1_750_000_000_000_000))
    seen_at = F.timestamp_micros((F.lit(1_750_000_000_000_000) - F.col("vec_id") * 8_640_000_000).cast("bigint"))
    return near.select("vec_id", F.round(1 - F.col("distance") + vectors.recency(seen_at, now), 6).alias("rank"))


@query(f"""SELECT query, key, rank FROM (SELECT q.vec_id AS query, e.vec_id AS key, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - {_COS}, 5), e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5""")
def vector_neighbours(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    near = vectors.nearest_many(e, "vec_id", "embedding", queries, 8)
    w = Window.partitionBy("query").orderBy(F.round("distance", 5), "key")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query", "key", "rank")


@query("SELECT true AS good_enough")
def vector_index_recall(spark, sf):
    e = table(spark, sf, "embeddings")
    index = vectors.InvertedFile(e, "vec_id", "embedding", lists=16)
    index.filed = cut(index.filed, "filed")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    exact = vectors.nearest_many(e, "vec_id", "embedding", queries, 10)
    return vectors.recall(exact, index.nearest_many(queries, 10, probes=13)).select((F.col("recall") >= 0.9).alias("good_enough"))


# JSON


@query("SELECT event_id, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS s, TRY_CAST(props ->> '$.k' AS BIGINT) AS i, TRY_CAST(props ->> '$.k' AS DOUBLE) AS f, json_extract(props, '$.k')::VARCHAR AS j FROM events")
def json_getters_on_events(spark, sf):
    v = F.col("v")
    e = table(spark, sf, "events").withColumn("v", json_getters.as_variant("props"))
    return e.select("event_id", json_getters.get_string(v, "k").alias("s"), json_getters.get_int(v, "k").alias("i"), json_getters.get_float(v, "k").alias("f"), json_getters.extract(v, "$.k").alias("j"))


@query("SELECT delivery_id, options ->> '$.model' AS model, TRY_CAST(options ->> '$.is_stream' AS BOOLEAN) AS streams, json_array_length(options, '$.feature_flags')::INTEGER AS flags, coalesce(list_contains(TRY_CAST(json_extract(options, '$.feature_flags') AS VARCHAR[]), 'par-tools'), false) AS parallel FROM messages WHERE json_valid(options) AND json_type(options, '$.feature_flags') = 'ARRAY'")
def json_arrays(spark, sf):
    v = F.col("v")
    m = table(spark, sf, "messages").withColumn("v", json_getters.as_variant("options"))
    rows = m.select("delivery_id", json_getters.get_string(v, "model").alias("model"), json_getters.get_bool(v, "is_stream").alias("streams"), json_getters.array_length(v, "feature_flags").alias("flags"), F.coalesce(json_getters.array_contains(v, "feature_flags", "par-tools"), F.lit(False)).alias("parallel"))
    return rows.where("flags is not null")


# The SQL surface


def surface(spark: SparkSession, sf: str, scores: Callable | None = None) -> SqlSurface:
    return SqlSurface(spark, scores=scores, tables={"messages": texts_of(spark, sf), "sessions": table(spark, sf, "sessions"), "parts": table(spark, sf, "parts")})


@query("SELECT r.tool_name, count(*) AS results, count(*) FILTER (WHERE r.is_failure) AS failures, count(c.call_id) AS answered FROM parts r LEFT JOIN (SELECT DISTINCT session_id, call_id FROM parts WHERE type = 'tool_call') c ON r.session_id = c.session_id AND r.call_id = c.call_id WHERE r.type = 'tool_result' GROUP BY 1")
def sql_tool_join(spark, sf):
    return surface(spark, sf).frame(ORACLES["sql_tool_join"])


@query("SELECT table_name, CAST(n AS BIGINT) AS columns FROM (VALUES ('sessions', 9), ('parts', 15), ('information_schema_columns', 3)) x(table_name, n) WHERE table_name <> 'information_schema_columns'")
def sql_information_schema(spark, sf):
    return surface(spark, sf).frame("SELECT table_name, count(*) AS columns FROM information_schema.columns WHERE table_name IN ('sessions', 'parts') GROUP BY table_name")


@query(W + T + " SELECT session_id, message_id FROM t WHERE list_has_all(regexp_split_to_array(search_text, '[^\\p{L}\\p{N}]+'), ['duplicate', 'import'])")
def sql_contains_tokens(spark, sf):
    return surface(spark, sf).frame("SELECT session_id, message_id FROM messages WHERE contains_tokens(search_text, 'duplicate import')")


@query("SELECT id, params ->> '$.command' AS command, TRY_CAST(params ->> '$.n' AS BIGINT) AS n FROM parts WHERE type = 'tool_call'")
def sql_json_getters(spark, sf):
    return surface(spark, sf).frame("SELECT id, json_get_string(params, 'command') AS command, json_get_int(params, 'n') AS n FROM parts WHERE type = 'tool_call'")


# What a SELECT can do: joins, grouping, windows, sets, functions


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def nation_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT min(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_min_join(spark, sf):
    o = table(spark, sf, "orders")
    low = o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("o_totalprice"))
    return o.join(low, ["o_custkey", "o_totalprice"], "left_semi").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("has_orders"))
    return yes.unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000 GROUP BY 1")
def left_outer_residual_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    j = c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 150000), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def lateral_top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return table(spark, sf, "customer").select("c_custkey").join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT event_type, user_id % 3 AS g, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 3), ())")
def grouping_sets_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("g", F.col("user_id") % 3)
    return e.rollup("event_type", "g").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube(spark, sf):
    return table(spark, sf, "events").withColumn("g", F.col("user_id") % 3).cube("event_type", "g").agg(F.count("*").alias("n"))


@query("""SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, lag(event_id) OVER w AS before, lead(event_id) OVER w AS behind, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS near,
first_value(event_id) OVER w AS first, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_rank_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        "event_id", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("bigint").alias("rk"), F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("behind"),
        F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("near"), F.first("event_id").over(w).alias("first"), F.ntile(4).over(w).cast("bigint").alias("quarter"),
    )


@query("""SELECT 'intersect' AS op, * FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', * FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', * FROM (SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region)""")
def set_ops(spark, sf):
    t = lambda n, c: table(spark, sf, n).select(F.col(c).alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")), "intersect").unionByName(tag(t("nation", "n_nationkey").subtract(t("supplier", "s_nationkey")), "except")).unionByName(tag(t("nation", "n_regionkey").union(t("region", "r_regionkey")).distinct(), "union"))


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def recursive_cte(spark, sf):
    return spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 25")
def keyset_page(spark, sf):
    seen_at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return e.where((F.col("ts") < seen_at) | ((F.col("ts") == seen_at) & (F.col("event_id") < 500))).orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01 00:00:00') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_time_bucket(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy(F.timestamp_micros(micros - F.pmod(micros - F.lit(1704067200000000), F.lit(21600000000))).cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf):
    return windowed_activity(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, round(stddev(value), 6) AS sd, median(value) AS mid, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high, any_value(event_type) AS kind, count(*) FILTER (WHERE value > 10) AS big, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS tails FROM events GROUP BY 1""")
def aggregates(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.stddev("value"), 6).alias("sd"), F.median("value").alias("mid"), F.countDistinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"), F.any_value("event_type").alias("kind"), F.count_if(F.col("value") > 10).alias("big"),
        F.array_join(F.sort_array(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("tails"),
    )


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1")
def approx_distinct_users(spark, sf):
    near = F.abs(F.approx_count_distinct("user_id") - F.countDistinct("user_id")) <= F.greatest(F.countDistinct("user_id") * 0.15, F.lit(2))
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"), near.alias("near"))


@query("SELECT o_orderpriority, true AS near FROM orders GROUP BY 1")
def approx_percentile_near(spark, sf):
    exact, approx = F.percentile("o_totalprice", 0.9), F.percentile_approx("o_totalprice", 0.9, 1000)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg((F.abs(exact - approx) <= exact * 0.02).alias("near"))


@query("""SELECT n_nationkey, length(n_name) AS len, lower(n_name) AS lo, substr(n_name, 2, 3) AS sub, position('A' IN n_name)::INTEGER AS pos, split_part(n_name, 'I', 1) AS part, concat_ws('-', n_name, n_nationkey) AS joined, n_name ILIKE '%an%' AS likes, starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en, regexp_matches(n_name, '^[A-M]') AS rx, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS rep FROM nation""")
def string_functions(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", F.length(n).cast("bigint").alias("len"), F.lower(n).alias("lo"), F.substring(n, 2, 3).alias("sub"), F.instr(n, "A").alias("pos"), F.split_part(n, F.lit("I"), F.lit(1)).alias("part"), F.concat_ws("-", n, F.col("n_nationkey").cast("string")).alias("joined"), n.ilike("%an%").alias("likes"), n.startswith("A").alias("st"), n.endswith("A").alias("en"), n.rlike("^[A-M]").alias("rx"), F.regexp_replace(n, "[AEIOU]", "_").alias("rep"))


@query("""SELECT s_suppkey, round(s_acctbal, 1) AS r, floor(s_acctbal)::BIGINT AS fl, ceil(s_acctbal)::BIGINT AS ce, abs(s_acctbal) AS ab, sign(s_acctbal)::INTEGER AS sg, round(ln(abs(s_acctbal) + 1), 6) AS l, round(log10(abs(s_acctbal) + 1), 6) AS l10, round(sqrt(abs(s_acctbal)), 6) AS sq, greatest(s_acctbal, 0) AS gr, CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'some' ELSE 'none' END AS class, nullif(s_nationkey, 3) AS nn, coalesce(nullif(s_nationkey, 3), -1) AS co FROM supplier""")
def math_and_conditional(spark, sf):
    a = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.round(a, 1).alias("r"), F.floor(a).alias("fl"), F.ceil(a).alias("ce"), F.abs(a).alias("ab"), F.sign(a).cast("int").alias("sg"), F.round(F.log(F.abs(a) + 1), 6).alias("l"), F.round(F.log10(F.abs(a) + 1), 6).alias("l10"), F.round(F.sqrt(F.abs(a)), 6).alias("sq"), F.greatest(a, F.lit(0.0)).alias("gr"),
        F.when(a > 5000, "high").when(a > 0, "some").otherwise("none").alias("class"), F.nullif("s_nationkey", F.lit(3)).alias("nn"), F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("co"),
    )


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, extract(YEAR FROM o_orderdate)::INTEGER AS y, extract(DOW FROM o_orderdate)::INTEGER AS dow, o_orderdate + INTERVAL '7 days' AS later, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders")
def date_functions(spark, sf):
    o = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", F.date_trunc("month", o).cast("timestamp_ntz").alias("month"), F.year(o).alias("y"), (F.dayofweek(o) - 1).alias("dow"), (o + F.expr("INTERVAL '7' DAY")).alias("later"), F.date_format(o, "yyyy-MM-dd").alias("text"))


# Copy, verify, ingest, export

_CUTOFF = "2024-11-01 00:00:00"


@query(W + M + f", s AS (SELECT session_id, count(*) AS source_rows FROM m GROUP BY 1), d AS (SELECT session_id, count(*) AS target_rows FROM m WHERE seen_at < TIMESTAMP '{_CUTOFF}' GROUP BY 1) SELECT session_id, source_rows, coalesce(target_rows, 0) AS target_rows, CASE WHEN target_rows IS NULL THEN 'append' WHEN source_rows > target_rows THEN 'merge' ELSE 'none' END AS plan FROM s LEFT JOIN d USING (session_id)")
def delta_plan_buckets(spark, sf):
    m = messages_of(spark, sf)
    return copying.delta(m, m.where(F.col("seen_at") < F.lit(_CUTOFF).cast("timestamp")))


@query(W + M + f" SELECT count(*) FILTER (WHERE seen_at >= TIMESTAMP '{_CUTOFF}') AS missing, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (WHERE seen_at >= TIMESTAMP '{_CUTOFF}') = 0 AS synced FROM m")
def pk_verify_missing_dup(spark, sf):
    m = cut(messages_of(spark, sf).select("session_id", "message_id", "seen_at"), "keys")
    return copying.verify(m, m.where(F.col("seen_at") < F.lit(_CUTOFF).cast("timestamp")), ["session_id", "message_id"])


@query(W + M + f" SELECT session_id, message_id FROM m WHERE seen_at >= TIMESTAMP '{_CUTOFF}'")
def dedup_anti_append(spark, sf):
    m = messages_of(spark, sf).select("session_id", "message_id", "seen_at")
    return copying.missing(m, m.where(F.col("seen_at") < F.lit(_CUTOFF).cast("timestamp")), ["session_id", "message_id"]).select("session_id", "message_id")


@query('SELECT * FROM (VALUES (\'messages\', 0::BIGINT, 0::BIGINT, true), (\'parts\', 0, 0, true), (\'sessions\', 0, 0, true)) x("table", missing, duplicates, synced)')
def store_copy_verify(spark, sf):
    a, b = Store(spark, fresh_path(spark, "a")), Store(spark, fresh_path(spark, "b"))
    s, m, p = (table(spark, sf, t) for t in ("sessions", "messages", "parts"))
    a.append_absent("sessions", s)
    a.append_absent("messages", m)
    a.append_absent("parts", p)
    copying.copy(a, b)
    copying.copy(a, b)
    return copying.verify_stores(a, b)


def archive_events(spark: SparkSession, sf: str) -> DataFrame:
    """The archive as an ordered stream of events, one batch a session."""
    s, m, p = (table(spark, sf, t) for t in ("sessions", "messages", "parts"))
    body = lambda df, cols: F.to_json(F.struct(*cols))
    low = F.lit("")
    rows = s.select(F.col("id").alias("batch_id"), F.lit(0).alias("k"), low.alias("m"), F.lit(-1).alias("o"), F.lit("session").alias("kind"), body(s, ["id", "parent_session_id", "parent_message_id", "source_agent", "created_at", "project", "options"]).alias("payload"))
    rows = rows.unionByName(m.select(F.col("session_id").alias("batch_id"), F.lit(1).alias("k"), F.col("id").alias("m"), F.lit(-1).alias("o"), F.lit("message").alias("kind"), body(m, ["session_id", "id", "timestamp", "role", "content", "options"]).alias("payload")))
    rows = rows.unionByName(p.select(F.col("session_id").alias("batch_id"), F.lit(1).alias("k"), F.col("message_id").alias("m"), F.coalesce("ordinal", F.lit(0)).alias("o"), F.lit("part").alias("kind"), body(p, ["session_id", "message_id", "id", "ordinal", "type", "provenance", F.col("tool_name").alias("name"), "call_id", "is_failure", "text", "params", "result", "media_type", "file_name"]).alias("payload")))
    order = Window.partitionBy("batch_id").orderBy("k", "m", "o", "kind", "payload")
    return rows.withColumn("seq", F.row_number().over(order).cast("bigint")).select("batch_id", "seq", "kind", "payload")


@query()
def ingest_outcomes(spark, sf):
    done = ingest.ingest(Store(spark, fresh_path(spark, "ingest")), archive_events(spark, sf))
    return done.groupBy("kind", "outcome", "reason").agg(F.count("*").alias("n"))


@query()
def event_export(spark, sf):
    m = messages_of(spark, sf).withColumnRenamed("message_id", "id")
    return ingest.export_events(table(spark, sf, "sessions"), m, table(spark, sf, "parts"), "seen_at")
