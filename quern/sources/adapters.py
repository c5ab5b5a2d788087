"""Readers of on-disk client transcripts into the canonical sessions, messages and parts.

JSONL formats are read with line numbers (needed for fallback ids and for "earlier in the
file"), by a Python data source that splits by file; rows become VARIANT and everything after
that is DataFrame work. SQLite stores, zip exports and archives are read by the same source
with another opener.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.json_getters import as_variant, get_json, get_string
from quern.operators.derive import INJECTED_PREFIXES_ENVELOPE, capped, part_id, user_provenance

LINES = "file string, line bigint, value string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open_lines(path: str) -> Iterator[str]:
    if path.endswith(".zst"):
        import zstandard

        with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as f:
            yield from io.TextIOWrapper(f, encoding="utf-8", errors="replace")
    elif path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            for name in sorted(z.namelist()):
                if name.endswith(".json"):
                    data = json.loads(z.read(name))
                    for item in data if isinstance(data, list) else [data]:
                        yield json.dumps(item, ensure_ascii=False)
                elif name.endswith(".jsonl"):
                    yield from z.read(name).decode("utf-8", "replace").splitlines()
    elif path.endswith((".db", ".sqlite", ".sqlite3")):
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            db.row_factory = sqlite3.Row
            for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                for row in db.execute(f'SELECT rowid AS "_rowid", * FROM "{table}" ORDER BY rowid'):
                    yield json.dumps({"_table": table, **{k: (v.hex() if isinstance(v, bytes) else v) for k, v in dict(row).items()}}, ensure_ascii=False)
        finally:
            db.close()
    elif path.endswith(".json"):
        with open(path, encoding="utf-8", errors="replace") as f:
            data = json.load(f)
        for item in data if isinstance(data, list) else [data]:
            yield json.dumps(item, ensure_ascii=False)
    else:
        with open(path, encoding="utf-8", errors="replace") as f:
            yield from f


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffixes = options["path"], tuple(options.get("suffixes", ".jsonl").split(","))

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [_File(self.root)]
        return [_File(str(p)) for p in sorted(Path(self.root).rglob("*")) if p.is_file() and (p.name.endswith(self.suffixes) or ".jsonl" in self.suffixes and ".jsonl." in p.name)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no file matched
            return
        for number, line in enumerate(_open_lines(partition.path), 1):
            if line.strip():
                yield partition.path, number, line.rstrip("\n")


class TranscriptLines(DataSource):
    """``spark.read.format("transcript_lines")``: one row per record of every file below ``path``; ``.jsonl`` covers rotated and zstd files too."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def lines(spark: SparkSession, path: str, suffixes: str = ".jsonl") -> DataFrame:
    spark.dataSource.register(TranscriptLines)
    return spark.read.format("transcript_lines").option("path", path).option("suffixes", suffixes).load()


def _tables(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> dict[str, DataFrame]:
    return {"sessions": sessions, "messages": messages, "parts": parts}


def _first(value, order="line"):
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def claude_code(spark: SparkSession, path: str, keep: Column | None = None, agent: str = "claude-code", project: Column | None = None) -> dict[str, DataFrame]:
    """One session a file; user and assistant rows are turns, every other row a system carrier with the raw record."""
    v = F.col("v")
    rows = lines(spark, path).withColumn("v", as_variant("value")).where("v is not null")
    rows = rows if keep is None else rows.where(keep)
    s = lambda *k: get_string(v, *k)
    side = F.regexp_extract("file", r"/subagents/(?:agent-)?([^/]+)\.jsonl$", 1)
    facts = rows.groupBy("file").agg(_first(s("sessionId")).alias("own"), _first(s("cwd")).alias("project"), _first(s("timestamp")).alias("created_at"), _first(s("agentType")).alias("kind"))
    facts = facts.withColumn("side", side).withColumn("own", F.coalesce("own", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)))
    facts = facts.select("file", F.when(F.col("side") != "", F.concat_ws("/", "own", F.concat(F.lit("agent-"), F.col("side")))).otherwise(F.col("own")).alias("session_id"), F.when(F.col("side") != "", F.col("own")).alias("parent_session_id"), F.when(F.col("side") != "", F.concat(F.lit(f"{agent}/"), F.coalesce("kind", F.lit("subagent")))).otherwise(agent).alias("source_agent"), F.coalesce(*([project] if project is not None else []), "project", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)).alias("project"), "created_at")
    sessions = facts.where("created_at is not null").select(F.col("session_id").alias("id"), "parent_session_id", F.lit(None).cast("string").alias("parent_message_id"), "source_agent", "created_at", "project")
    items = F.try_variant_get(v, "$.message.content", "array<variant>")
    only_results = F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: F.try_variant_get(x, "$.type", "string") == "tool_result"), F.lit(False))
    kind = s("type")
    turn = kind.isin("user", "assistant")
    m = rows.join(facts.select("file", "session_id", "source_agent", "project"), "file").withColumn("items", items)
    m = m.select("*", F.coalesce(s("uuid"), F.concat_ws(":", "session_id", "line")).alias("id"), F.when(~turn, "system").when(only_results, "tool").otherwise(kind).alias("role"))
    once = m.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "id").orderBy("line"))).where("again = 1")
    messages = once.select("session_id", "id", s("timestamp").alias("timestamp"), "role", "source_agent", "project", F.when(F.col("role") == "system", F.coalesce(s("subtype"), kind)).alias("content"), F.when(F.col("role") == "system", F.col("value")).alias("options"))
    said = once.where("role <> 'system'")
    text = s("message", "content")
    plain = said.where("items is null").select("session_id", "id", "role", F.lit(0).alias("ordinal"), F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("variant").alias("item"), s("isMeta").alias("meta"), "file", "line")
    many = said.where("items is not null").select("session_id", "id", "role", F.posexplode("items").alias("ordinal", "item"), s("isMeta").alias("meta"), "file", "line")
    i = F.col("item")
    g = lambda *k: get_string(i, *k)
    many = many.select("session_id", "id", "role", "ordinal", g("type").alias("kind"), F.coalesce(g("text"), g("thinking")).alias("text"), "item", "meta", "file", "line")
    p = plain.unionByName(many)
    calls = many.where(F.col("kind").isin("tool_use", "server_tool_use")).groupBy("file", g("id").alias("call")).agg(F.min_by(g("name"), "line").alias("called"), F.min("line").alias("call_line"))
    joined = p.withColumn("call", F.when(F.col("kind") == "tool_result", g("tool_use_id"))).join(calls, ["file", "call"], "left")
    known = F.when(F.col("call_line") < F.col("line"), F.col("called"))
    part_type = F.when(F.col("kind") == "thinking", "reasoning").when(F.col("kind").isin("tool_use", "server_tool_use"), "tool_call").when(F.col("kind") == "tool_result", "tool_result").when(F.col("kind").isin("image", "file", "document"), "file").otherwise("text")
    provenance = F.when(F.col("kind") == "tool_result", "injected").when(F.col("role") == "user", user_provenance("text", F.col("meta") == "true")).otherwise(F.lit("conversational"))
    parts = joined.select(
        "session_id", F.col("id").alias("message_id"), part_id("id", "ordinal").alias("id"), "ordinal", part_type.alias("type"), provenance.alias("provenance"), F.when(part_type == "tool_call", g("name")).when(part_type == "tool_result", known).alias("tool_name"), F.when(part_type == "tool_call", g("id")).when(part_type == "tool_result", F.col("call")).alias("call_id"),
        F.when(part_type == "tool_result", F.coalesce(g("is_error").try_cast("boolean"), F.lit(False))).alias("is_failure"), F.when(part_type.isin("text", "reasoning"), capped(F.coalesce("text", F.to_json(i)))).alias("text"), F.when(part_type == "tool_call", F.to_json(get_json(i, "input"))).alias("params"), F.when(part_type == "tool_result", F.to_json(get_json(i, "content"))).alias("result"), F.when(part_type == "file", g("source", "media_type")).alias("media_type"),
    )
    return _tables(sessions, messages, parts)


def codex_cli(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Envelope rows {timestamp, type, payload}; older files start with a bare session row and bare payloads."""
    v = F.col("v")
    raw = lines(spark, path).withColumn("v", as_variant("value")).where("v is not null")
    envelope = get_string(v, "payload").isNotNull()
    rows = raw.withColumn("p", F.when(envelope, get_json(v, "payload")).otherwise(v)).withColumn("at", get_string(v, "timestamp")).withColumn("outer", F.when(envelope, get_string(v, "type")))
    p = F.col("p")
    g = lambda *k: get_string(p, *k)
    meta = F.when((F.col("outer") == "session_meta") | (F.col("outer").isNull() & (F.col("line") == 1) & g("type").isNull()), g("id"))
    facts = rows.groupBy("file").agg(_first(meta).alias("session_id"), _first(g("cwd")).alias("cwd"), _first(F.coalesce(F.when(meta.isNotNull(), g("timestamp")), F.col("at"))).alias("created_at"))
    facts = facts.where("session_id is not null").withColumn("project", F.coalesce("cwd", F.regexp_extract("file", r"([^/]+)$", 1)))
    sessions = facts.select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("parent_message_id"), F.lit("codex-cli").alias("source_agent"), "created_at", "project")
    kind = g("type")
    body = rows.where(~meta.isNotNull()).join(facts.select("file", "session_id", "created_at", "project"), "file")
    role = F.when((kind == "message") & g("role").isin("developer", "system"), "system").when(kind == "message", g("role")).when(kind.isin("function_call_output", "custom_tool_call_output"), "tool").when(kind.isin("reasoning", "function_call", "custom_tool_call", "local_shell_call"), "assistant").otherwise("system")
    m = body.withColumn("id", F.format_string("%s:%06d", "session_id", "line")).withColumn("role", role)
    messages = m.select("session_id", "id", F.when(F.col("outer").isNull() | (F.col("outer") == "response_item"), F.coalesce("at", "created_at")).otherwise(F.col("created_at")).alias("timestamp"), "role", F.lit("codex-cli").alias("source_agent"), "project", F.lit(None).cast("string").alias("content"), F.when(F.col("role") == "system", F.col("value")).alias("options"))
    items = F.coalesce(F.try_variant_get(p, "$.content", "array<variant>"), F.try_variant_get(p, "$.summary", "array<variant>"))
    texts = m.where(kind.isin("message", "reasoning")).select("session_id", "id", "role", kind.alias("kind"), F.posexplode(items).alias("ordinal", "item"))
    i = F.col("item")
    text = F.coalesce(get_string(i, "text"), F.to_json(i))
    said = texts.select("session_id", F.col("id").alias("message_id"), part_id("id", "ordinal").alias("id"), "ordinal", F.when(F.col("kind") == "reasoning", "reasoning").otherwise("text").alias("type"), F.when(F.col("role") == "system", "injected").when(F.col("role") == "user", user_provenance(text, prefixes=INJECTED_PREFIXES_ENVELOPE)).otherwise("conversational").alias("provenance"), *[F.lit(None).cast(t).alias(c) for c, t in (("tool_name", "string"), ("call_id", "string"), ("is_failure", "boolean"))], capped(text).alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("params", "result", "media_type")])
    names = m.where(kind.isin("function_call", "custom_tool_call")).groupBy("file", g("call_id").alias("call")).agg(F.min_by(g("name"), "line").alias("called"), F.min("line").alias("call_line"))
    tools = m.where(kind.isin("function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output")).withColumn("call", g("call_id")).join(names, ["file", "call"], "left")
    result = kind.endswith("_output")
    code = F.try_variant_get(F.try_parse_json(g("output")), "$.metadata.exit_code", "int")
    used = tools.select("session_id", F.col("id").alias("message_id"), part_id("id", F.lit(0)).alias("id"), F.lit(0).alias("ordinal"), F.when(result, "tool_result").otherwise("tool_call").alias("type"), F.when(result, "injected").otherwise("conversational").alias("provenance"), F.when(result, F.when(F.col("call_line") < F.col("line"), F.col("called"))).otherwise(g("name")).alias("tool_name"), F.col("call").alias("call_id"), F.when(result, F.coalesce(code != 0, F.lit(False))).alias("is_failure"), F.lit(None).cast("string").alias("text"), F.when(~result, F.coalesce(g("arguments"), g("input"))).alias("params"), F.when(result, F.to_json(get_json(p, "output"))).alias("result"), F.lit(None).cast("string").alias("media_type"))
    return _tables(sessions, messages, said.unionByName(used))


def letta_code(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``transcript.jsonl`` below <agent>/<conversation>; a tool row is a call message and a result message."""
    v = F.col("v")
    g = lambda *k: get_string(v, *k)
    rows = lines(spark, path).withColumn("v", as_variant("value")).where("v is not null")
    agent, talk = F.regexp_extract("file", r"/([^/]+)/([^/]+)/[^/]+\.jsonl$", 1), F.regexp_extract("file", r"/([^/]+)/([^/]+)/[^/]+\.jsonl$", 2)
    rows = rows.withColumn("session_id", F.concat_ws("+", agent, talk)).withColumn("project", agent).withColumn("kind", g("kind")).withColumn("at", g("captured_at"))
    sessions = rows.groupBy(F.col("session_id").alias("id")).agg(F.min("project").alias("project"), _first(F.col("at")).alias("created_at")).select("id", F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("parent_message_id"), F.lit("letta-code").alias("source_agent"), "created_at", "project")
    tool = F.col("kind") == "tool_call"
    role = F.when(F.col("kind") == "user", "user").when(F.col("kind").isin("assistant", "reasoning") | tool, "assistant").otherwise("system")
    base = rows.select("*", F.format_string("%s:%06d", "session_id", "line").alias("id"), role.alias("role"))
    call = base.select("session_id", "id", F.col("at").alias("timestamp"), "role", F.lit("letta-code").alias("source_agent"), "project", F.when(F.col("role") == "system", F.col("kind")).alias("content"), F.when(F.col("role") == "system", F.col("value")).alias("options"))
    answers = base.where(tool & g("resultText").isNotNull())
    back = answers.select("session_id", F.concat("id", F.lit(":result")).alias("id"), F.col("at").alias("timestamp"), F.lit("tool").alias("role"), F.lit("letta-code").alias("source_agent"), "project", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("options"))
    none = lambda t="string": F.lit(None).cast(t)
    own = base.where(F.col("kind").isin("user", "assistant", "reasoning") | tool).select("session_id", F.col("id").alias("message_id"), part_id("id", F.lit(0)).alias("id"), F.lit(0).alias("ordinal"), F.when(tool, "tool_call").when(F.col("kind") == "reasoning", "reasoning").otherwise("text").alias("type"), F.when(F.col("kind") == "user", user_provenance(g("text"))).otherwise("conversational").alias("provenance"), F.when(tool, g("name")).alias("tool_name"), F.when(tool, F.coalesce(g("source_line_id"), F.col("id"))).alias("call_id"), none("boolean").alias("is_failure"), F.when(~tool, capped(g("text"))).alias("text"), F.when(tool, g("argsText")).alias("params"), none().alias("result"), none().alias("media_type"))
    got = answers.select("session_id", F.concat("id", F.lit(":result")).alias("message_id"), part_id(F.concat("id", F.lit(":result")), F.lit(0)).alias("id"), F.lit(0).alias("ordinal"), F.lit("tool_result").alias("type"), F.lit("injected").alias("provenance"), g("name").alias("tool_name"), F.coalesce(g("source_line_id"), F.col("id")).alias("call_id"), (~F.coalesce(g("resultOk").try_cast("boolean"), F.lit(True))).alias("is_failure"), none().alias("text"), none().alias("params"), F.to_json(get_json(v, "resultText")).alias("result"), none().alias("media_type"))
    return _tables(sessions, call.unionByName(back), own.unionByName(got))


def claude_ai_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A zip (or its ``conversations.json``): session = conversation uuid, project = account uuid."""
    v, m, i = F.col("v"), F.col("m"), F.col("i")
    rows = lines(spark, path, ".zip,.json").withColumn("v", as_variant("value")).where(F.try_variant_get(F.col("v"), "$.chat_messages", "array<variant>").isNotNull())
    g = lambda c, *k: get_string(c, *k)
    facts = rows.select(g(v, "uuid").alias("session_id"), g(v, "account", "uuid").alias("project"), g(v, "created_at").alias("created_at"), "v")
    sessions = facts.select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("parent_message_id"), F.lit("claude-ai-export").alias("source_agent"), "created_at", "project")
    each = facts.select("session_id", "project", F.posexplode(F.try_variant_get(v, "$.chat_messages", "array<variant>")).alias("at", "m"))
    items = F.try_variant_get(m, "$.content", "array<variant>")
    tools = F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: F.try_variant_get(x, "$.type", "string") == "tool_result"), F.lit(False))
    each = each.withColumn("id", F.coalesce(g(m, "uuid"), F.concat_ws(":", "session_id", "at"))).withColumn("items", items).withColumn("role", F.when(tools, "tool").when(g(m, "sender") == "human", "user").otherwise("assistant"))
    messages = each.select("session_id", "id", g(m, "created_at").alias("timestamp"), "role", F.lit("claude-ai-export").alias("source_agent"), "project", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("options"))
    blocks = each.select("session_id", F.col("id").alias("message_id"), "role", F.posexplode("items").alias("ordinal", "i"))
    kind = g(i, "type")
    t = F.when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").when(kind == "thinking", "reasoning").otherwise("text")
    parts = blocks.select("session_id", "message_id", part_id("message_id", "ordinal").alias("id"), "ordinal", t.alias("type"), F.when(t == "tool_result", "injected").otherwise("conversational").alias("provenance"), F.when(t.isin("tool_call", "tool_result"), g(i, "name")).alias("tool_name"), F.when(t == "tool_call", g(i, "id")).when(t == "tool_result", g(i, "tool_use_id")).alias("call_id"), F.when(t == "tool_result", F.coalesce(g(i, "is_error").try_cast("boolean"), F.lit(False))).alias("is_failure"), F.when(t.isin("text", "reasoning"), capped(F.coalesce(g(i, "text"), g(i, "thinking")))).alias("text"), F.when(t == "tool_call", F.to_json(get_json(i, "input"))).alias("params"), F.when(t == "tool_result", F.to_json(get_json(i, "content"))).alias("result"), F.lit(None).cast("string").alias("media_type"))
    return _tables(sessions, messages, parts)


def sqlite_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every table of the SQLite files below ``path``: (file, line, table, value VARIANT)."""
    rows = lines(spark, path, ".db,.sqlite,.sqlite3").withColumn("value", as_variant("value"))
    return rows.select("file", "line", get_string(F.col("value"), "_table").alias("table"), "value")


#: Readers in the order in which sources are probed.
REGISTRY = {"claude-code": claude_code, "codex-cli": codex_cli, "letta-code": letta_code, "claude-ai-export": claude_ai_export}


def read(spark: SparkSession, adapter: str, path: str) -> dict[str, DataFrame]:
    from quern.sources import more_adapters  # noqa: F401 - fills the registry

    if adapter not in REGISTRY:
        raise KeyError(f"no adapter {adapter!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[adapter](spark, path)
