"""Readers of the remaining client formats, over the same line source as ``adapters``.

Each reader reduces its records to *turns* (session, message id, time, role) and *blocks*
(message id, ordinal, kind, text, tool name, call id, input, output, failure); ``_canonical``
turns these into the three tables. Records that are no turn become system messages that keep
the raw record. A store hosting many sessions in one SQLite file is read table by table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.json_getters import as_variant, get_json, get_string
from quern.operators.derive import capped, part_id, user_provenance
from quern.sources import adapters
from quern.sources.adapters import _first, lines, sqlite_rows

V = F.col("v")
NONE = F.lit(None).cast("string")


def _s(*keys: str | int) -> Column:
    return get_string(V, *keys)


def _i(*keys: str | int) -> Column:
    return get_string(F.col("item"), *keys)


def _rows(spark: SparkSession, path: str, suffixes: str = ".jsonl") -> DataFrame:
    return lines(spark, path, suffixes).withColumn("v", as_variant("value")).where("v is not null")


def _items(*path: str) -> Column:
    return F.try_variant_get(V, "$" + "".join(f"['{p}']" for p in path), "array<variant>")


def _kind_to_type(kind: Column) -> Column:
    return (
        F.when(kind.isin("thinking", "reasoning", "agent_thought_chunk"), "reasoning").when(kind.isin("toolCall", "tool_use", "tool_call"), "tool_call").when(kind.isin("toolResult", "tool_result"), "tool_result").when(kind.isin("image", "file", "image_url", "document"), "file").otherwise("text")
    )


def _canonical(sessions: DataFrame, turns: DataFrame, blocks: DataFrame, agent: str) -> dict[str, DataFrame]:
    """``sessions``: id, project, created_at[, parent_session_id, source_agent]; ``turns``: session_id, id, timestamp, role[, raw];
    ``blocks``: session_id, message_id, role, ordinal, kind, text, tool_name, call_id, input, output, failed[, media_type]."""
    has = lambda df, c: F.col(c) if c in df.columns else NONE
    s = sessions.select("id", has(sessions, "parent_session_id").alias("parent_session_id"), NONE.alias("parent_message_id"), F.coalesce(has(sessions, "source_agent"), F.lit(agent)).alias("source_agent"), "created_at", "project").dropDuplicates(["id"])
    labels = s.select(F.col("id").alias("session_id"), "source_agent", "project")
    once = turns.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "id").orderBy("timestamp"))).where("again = 1")
    m = once.join(labels, "session_id", "left").select("session_id", "id", "timestamp", "role", "source_agent", "project", F.when(F.col("role") == "system", has(turns, "label")).alias("content"), has(turns, "raw").alias("options"))
    t = _kind_to_type(F.col("kind"))
    provenance = F.when((t == "tool_result") | (F.col("role") == "system"), "injected").when(F.col("role") == "user", user_provenance("text")).otherwise("conversational")
    tool, result = t.isin("tool_call", "tool_result"), t == "tool_result"
    p = blocks.select(
        "session_id", "message_id", part_id("message_id", "ordinal").alias("id"), F.col("ordinal").cast("int").alias("ordinal"), t.alias("type"), provenance.alias("provenance"), F.when(tool, F.col("tool_name")).alias("tool_name"), F.when(tool, F.col("call_id")).alias("call_id"), F.when(result, F.coalesce("failed", F.lit(False))).alias("is_failure"),
        F.when(t.isin("text", "reasoning"), capped("text")).alias("text"), F.when(t == "tool_call", F.col("input")).alias("params"), F.when(result, F.col("output")).alias("result"), F.when(t == "file", has(blocks, "media_type")).alias("media_type"),
    )
    return {"sessions": s, "messages": m, "parts": p}


def _iso(col: Column) -> Column:
    """Epoch milliseconds or text, as text."""
    return F.when(col.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(col.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(col)


def pi_coding_agent(spark: SparkSession, path: str, agent: str = "pi-coding-agent") -> dict[str, DataFrame]:
    """v3 files ({"type": "session"} first) and v4 files ({"kind": "header"} first); only records with a message are turns."""
    rows = _rows(spark, path).where(~F.coalesce(_s("type") == "title", F.lit(False)))
    head = F.coalesce(_s("type") == "session", F.lit(False)) | F.coalesce(_s("kind") == "header", F.lit(False))
    facts = rows.groupBy("file").agg(_first(F.when(head, _s("id"))).alias("session_id"), _first(F.when(head, _s("cwd"))).alias("cwd"), _first(F.when(head, F.coalesce(_s("timestamp"), _s("createdAt")))).alias("created_at"), _first(F.when(head, _s("parentSession"))).alias("parent"))
    facts = facts.where("session_id is not null").withColumn("project", F.coalesce("cwd", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)))
    sessions = facts.select(F.col("session_id").alias("id"), "project", _iso(F.col("created_at")).alias("created_at"))
    body = rows.where(~head).join(facts.select("file", "session_id"), "file")
    turn = (_s("type") == "message") & _s("message", "role").isNotNull()
    role = F.when(~F.coalesce(turn, F.lit(False)), "system").when(_s("message", "role") == "toolResult", "tool").when(_s("message", "role").isin("user", "assistant"), _s("message", "role")).otherwise("system")
    body = body.withColumn("id", F.coalesce(_s("id"), F.concat_ws(":", "session_id", "line"))).withColumn("role", role)
    turns = body.select("session_id", "id", _iso(_s("timestamp")).alias("timestamp"), "role", F.when(F.col("role") == "system", F.coalesce(_s("customType"), _s("type"), _s("kind"))).alias("label"), F.when(F.col("role") == "system", F.col("value")).alias("raw"))
    said = body.where("role <> 'system'")
    items = F.coalesce(_items("message", "content"), F.array(F.try_parse_json(F.to_json(F.struct(F.lit("text").alias("type"), _s("message", "content").alias("text"))))))
    block = said.where("role <> 'tool'").select("session_id", F.col("id").alias("message_id"), "role", F.posexplode(items).alias("ordinal", "item"))
    blocks = block.select("session_id", "message_id", "role", "ordinal", _i("type").alias("kind"), F.coalesce(_i("text"), _i("thinking")).alias("text"), _i("name").alias("tool_name"), _i("id").alias("call_id"), F.to_json(get_json(F.col("item"), "arguments")).alias("input"), NONE.alias("output"), F.lit(None).cast("boolean").alias("failed"), _i("mimeType").alias("media_type"))
    results = said.where("role = 'tool'").select("session_id", F.col("id").alias("message_id"), "role", F.lit(0).alias("ordinal"), F.lit("toolResult").alias("kind"), NONE.alias("text"), _s("message", "toolName").alias("tool_name"), _s("message", "toolCallId").alias("call_id"), NONE.alias("input"), F.to_json(get_json(V, "message", "content")).alias("output"), _s("message", "isError").try_cast("boolean").alias("failed"), NONE.alias("media_type"))
    return _canonical(sessions, turns, blocks.unionByName(results), agent)


def oh_my_pi(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """pi v3 files whose first line may be a title slot; ``parentSession`` is no lineage here."""
    return pi_coding_agent(spark, path, "oh-my-pi")


def openclaw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The file layout, plain or in zstd archives: pi v3 records in source order."""
    return pi_coding_agent(spark, path, "openclaw")


def grok_build(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``updates.jsonl`` of a session folder with its ``summary.json``; message ids by line, children from the parents' ``meta.json``."""
    rows = _rows(spark, path).where(F.col("file").endswith("/updates.jsonl"))
    update = lambda *k: _s("params", "update", *k)
    rows = rows.withColumn("session_id", F.coalesce(_s("params", "sessionId"), F.regexp_extract("file", r"/([^/]+)/updates\.jsonl$", 1))).withColumn("kind", update("sessionUpdate")).withColumn("ms", F.coalesce(_s("params", "_meta", "agentTimestampMs"), F.concat(_s("timestamp"), F.lit("000"))))
    info = _rows(spark, path, "summary.json").select(_s("info", "id").alias("session_id"), _s("info", "cwd").alias("cwd"), _s("created_at").alias("created")).where("session_id is not null").dropDuplicates(["session_id"])
    kin = _rows(spark, path, "meta.json").where(F.col("file").contains("/subagents/")).select(F.regexp_extract("file", r"/subagents/([^/]+)/meta\.json$", 1).alias("session_id"), F.regexp_extract("file", r"/([^/]+)/subagents/", 1).alias("parent")).dropDuplicates(["session_id"])
    facts = rows.groupBy("session_id").agg(F.min("ms").alias("first")).join(info, "session_id", "left").join(kin, "session_id", "left")
    sessions = facts.select(F.col("session_id").alias("id"), F.col("parent").alias("parent_session_id"), F.when(F.col("parent").isNotNull(), "grok-build/subagent").otherwise("grok-build").alias("source_agent"), F.coalesce("cwd", F.lit("unknown")).alias("project"), F.coalesce("created", _iso(F.col("first"))).alias("created_at"))
    role = F.when(F.col("kind") == "user_message_chunk", "user").when(F.col("kind").isin("agent_message_chunk", "agent_thought_chunk", "tool_call"), "assistant").when((F.col("kind") == "tool_call_update") & update("status").isin("completed", "failed"), "tool").otherwise("system")
    rows = rows.withColumn("role", role).withColumn("id", F.format_string("%s:%06d", "session_id", "line"))
    turns = rows.select("session_id", "id", _iso(F.col("ms")).alias("timestamp"), "role", F.when(F.col("role") == "system", F.col("kind")).alias("label"), F.when(F.col("role") == "system", F.col("value")).alias("raw"))
    names = rows.where("kind = 'tool_call'").groupBy("session_id", update("toolCallId").alias("call_id")).agg(F.min_by(update("title"), "line").alias("called"))
    result = F.col("role") == "tool"
    blocks = rows.where("role <> 'system'").withColumn("call_id", update("toolCallId")).join(names, ["session_id", "call_id"], "left").select(
        "session_id", F.col("id").alias("message_id"), "role", F.lit(0).alias("ordinal"), F.when(result, "tool_result").when(F.col("kind") == "tool_call", "tool_call").when(F.col("kind") == "agent_thought_chunk", "thinking").otherwise("text").alias("kind"), update("content", "text").alias("text"), F.col("called").alias("tool_name"), "call_id",
        F.to_json(get_json(V, "params", "update", "rawInput")).alias("input"), F.to_json(F.coalesce(get_json(V, "params", "update", "rawOutput"), get_json(V, "params", "update", "content"))).alias("output"), (update("status") == "failed").alias("failed"),
    )
    return _canonical(sessions, turns, blocks, "grok-build")


def opencode(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The JSON tree storage/{session,message,part}; one fused tool part is a call and, once finished, a tool message with its result."""
    rows = _rows(spark, path, ".json")
    at = lambda kind: rows.where(F.col("file").contains(f"/storage/{kind}/"))
    sessions = at("session").select(_s("id").alias("id"), _s("parentID").alias("parent_session_id"), F.coalesce(_s("directory"), _s("projectID")).alias("project"), _iso(_s("time", "created")).alias("created_at"), F.when(_s("parentID").isNotNull(), "opencode/subagent").otherwise("opencode").alias("source_agent")).where("id is not null")
    messages = at("message").select(_s("sessionID").alias("session_id"), _s("id").alias("id"), _iso(_s("time", "created")).alias("timestamp"), _s("role").alias("role"))
    order = Window.partitionBy("message_id").orderBy("id")
    parts = at("part").select(_s("sessionID").alias("session_id"), _s("messageID").alias("message_id"), _s("id").alias("id"), _s("type").alias("kind"), "v").where("kind in ('text', 'reasoning', 'file', 'tool')").withColumn("ordinal", F.row_number().over(order) - 1)
    parts = parts.join(messages.select(F.col("session_id"), F.col("id").alias("message_id"), "role", "timestamp"), ["session_id", "message_id"])
    done = (F.col("kind") == "tool") & _s("state", "status").isin("completed", "error")
    back_id = F.concat("message_id", F.lit(":"), _s("callID"))
    turns = messages.select("session_id", "id", "timestamp", "role").unionByName(parts.where(done).select("session_id", back_id.alias("id"), F.coalesce(_iso(_s("state", "time", "end")), F.col("timestamp")).alias("timestamp"), F.lit("tool").alias("role")))
    own = parts.select("session_id", "message_id", "role", "ordinal", F.when(F.col("kind") == "tool", "tool_call").otherwise(F.col("kind")).alias("kind"), _s("text").alias("text"), _s("tool").alias("tool_name"), _s("callID").alias("call_id"), F.to_json(get_json(V, "state", "input")).alias("input"), NONE.alias("output"), F.lit(None).cast("boolean").alias("failed"), _s("mime").alias("media_type"))
    back = parts.where(done).select("session_id", back_id.alias("message_id"), F.lit("tool").alias("role"), F.lit(0).alias("ordinal"), F.lit("tool_result").alias("kind"), NONE.alias("text"), _s("tool").alias("tool_name"), _s("callID").alias("call_id"), NONE.alias("input"), F.to_json(F.coalesce(get_json(V, "state", "output"), get_json(V, "state", "error"))).alias("output"), (_s("state", "status") == "error").alias("failed"), NONE.alias("media_type"))
    return _canonical(sessions, turns, own.unionByName(back), "opencode")


def claude_desktop_app(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Only ``local_*/audit.jsonl``; the nested ``.claude`` folders hold the same turns again and are left out."""
    t = adapters.claude_code(spark, path, keep=F.col("file").rlike(r"/local_[^/]+/audit\.jsonl$") & ~F.col("file").contains("/.claude/"), agent="claude-desktop-app")
    return t


def nanoclaw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Transcripts below data/v2-sessions/<group>/.claude-shared; the group is the project."""
    keep = F.col("file").contains("/.claude-shared/projects/")
    t = adapters.claude_code(spark, path, keep=keep, agent="nanoclaw", project=F.regexp_extract("file", r"/v2-sessions/([^/]+)/", 1))
    return t


def hermes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One SQLite store per profile; message id <session>:<row id>; a sentinel prefix marks JSON content."""
    rows = sqlite_rows(spark, path).withColumnRenamed("value", "v")
    s = rows.where("table = 'sessions'")
    sessions = s.select(_s("id").alias("id"), _s("parent_session_id").alias("parent_session_id"), F.when(_s("source") == "cron", "hermes/cron").when(_s("parent_session_id").isNotNull() & _s("end_reason").isNull(), "hermes/subagent").otherwise("hermes").alias("source_agent"), F.coalesce(_s("session_key"), F.when(_s("chat_id").isNotNull(), F.concat_ws(":", _s("source"), _s("chat_id"))), _s("cwd"), _s("source")).alias("project"), F.coalesce(_s("started_at"), _s("created_at")).alias("created_at"))
    m = rows.where("table = 'messages'").withColumn("session_id", _s("session_id")).withColumn("id", F.concat_ws(":", _s("session_id"), _s("id"))).withColumn("role", F.when(_s("role").isin("user", "assistant", "tool"), _s("role")).otherwise("system"))
    turns = m.select("session_id", "id", _s("timestamp").alias("timestamp"), "role", F.when(F.col("role") == "system", _s("role")).alias("label"), F.when(F.col("role") == "system", F.to_json("v")).alias("raw"))
    content = _s("content")
    packed = F.when(content.startswith("\x00json:"), F.try_parse_json(F.substring(content, 7, 1 << 30)))
    said = m.where("role <> 'system'").withColumn("packed", packed).select("session_id", F.col("id").alias("message_id"), "role", F.coalesce(F.array_join(F.transform(F.try_variant_get(F.col("packed"), "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "\n"), content).alias("body"), _s("tool_name").alias("tool_name"), _s("tool_call_id").alias("call_id"), F.try_parse_json(_s("tool_calls")).alias("calls"))
    text = said.where("body is not null and body <> ''").select("session_id", "message_id", "role", F.lit(0).alias("ordinal"), F.when(F.col("role") == "tool", "tool_result").otherwise("text").alias("kind"), F.col("body").alias("text"), "tool_name", "call_id", NONE.alias("input"), F.to_json(F.struct(F.col("body").alias("content"))).alias("output"), F.lit(None).cast("boolean").alias("failed"))
    calls = said.select("session_id", "message_id", "role", F.posexplode(F.try_variant_get(F.col("calls"), "$", "array<variant>")).alias("n", "item")).select("session_id", "message_id", "role", (F.col("n") + 1).alias("ordinal"), F.lit("tool_call").alias("kind"), NONE.alias("text"), F.coalesce(_i("function", "name"), _i("name")).alias("tool_name"), _i("id").alias("call_id"), F.coalesce(_i("function", "arguments"), _i("arguments")).alias("input"), NONE.alias("output"), F.lit(None).cast("boolean").alias("failed"))
    return _canonical(sessions, turns, text.unionByName(calls), "hermes")


def devin(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A forest of message nodes in SQLite: one message is one ``message_id`` across all nodes that place it."""
    rows = sqlite_rows(spark, path).withColumnRenamed("value", "v")
    sessions = rows.where("table = 'sessions'").select(_s("id").alias("id"), F.coalesce(_s("working_directory"), F.lit("unknown")).alias("project"), _s("created_at").alias("created_at"))
    nodes = rows.where("table = 'message_nodes'").select(_s("session_id").alias("session_id"), _s("row_id").try_cast("bigint").alias("row_id"), _s("created_at").alias("created_at"), F.try_parse_json(_s("chat_message")).alias("v"))
    once = nodes.withColumn("id", _s("message_id")).where("id is not null").withColumn("again", F.row_number().over(Window.partitionBy("session_id", "id").orderBy("row_id"))).where("again = 1")
    once = once.withColumn("role", F.when(_s("role").isin("user", "assistant", "tool"), _s("role")).otherwise("system"))
    turns = once.select("session_id", "id", F.coalesce(_s("created_at"), F.col("created_at")).alias("timestamp"), "role", F.when(F.col("role") == "system", _s("role")).alias("label"), F.when(F.col("role") == "system", F.to_json("v")).alias("raw"))
    said = once.where("role <> 'system'")
    text = said.select("session_id", F.col("id").alias("message_id"), "role", F.lit(0).alias("ordinal"), F.when(F.col("role") == "tool", "tool_result").otherwise("text").alias("kind"), _s("content").alias("text"), _s("name").alias("tool_name"), _s("tool_call_id").alias("call_id"), NONE.alias("input"), F.to_json(get_json(V, "content")).alias("output"), F.lit(None).cast("boolean").alias("failed")).where("text is not null")
    calls = said.select("session_id", F.col("id").alias("message_id"), "role", F.posexplode(_items("tool_calls")).alias("n", "item")).select("session_id", "message_id", "role", (F.col("n") + 1).alias("ordinal"), F.lit("tool_call").alias("kind"), NONE.alias("text"), F.coalesce(_i("function", "name"), _i("name")).alias("tool_name"), _i("id").alias("call_id"), F.coalesce(_i("function", "arguments"), F.to_json(get_json(F.col("item"), "arguments"))).alias("input"), NONE.alias("output"), F.lit(None).cast("boolean").alias("failed"))
    return _canonical(sessions, turns, text.unionByName(calls), "devin")


def agy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SQLite of opaque step payloads: every step is kept as a system message with its raw row; keyed by trajectory and index."""
    rows = sqlite_rows(spark, path).withColumnRenamed("value", "v").where("table = 'steps'").withColumn("session_id", F.regexp_extract("file", r"([^/]+)\.db$", 1))
    sessions = rows.groupBy(F.col("session_id").alias("id")).agg(F.min(_s("created_at")).alias("created_at")).withColumn("project", F.col("id"))
    turns = rows.select("session_id", F.concat_ws(":", F.coalesce(_s("trajectory_id"), F.col("session_id")), F.coalesce(_s("idx"), F.col("line").cast("string")), _s("status")).alias("id"), _s("created_at").alias("timestamp"), F.lit("system").alias("role"), F.lit("step").alias("label"), F.to_json("v").alias("raw"))
    empty = spark.createDataFrame([], "session_id string, message_id string, role string, ordinal int, kind string, text string, tool_name string, call_id string, input string, output string, failed boolean")
    return _canonical(sessions, turns, empty, "agy")


adapters.REGISTRY.update({"opencode": opencode, "openclaw": openclaw, "hermes": hermes, "nanoclaw": nanoclaw, "pi-coding-agent": pi_coding_agent, "oh-my-pi": oh_my_pi, "grok-build": grok_build, "claude-desktop-app": claude_desktop_app, "devin": devin, "agy": agy})
