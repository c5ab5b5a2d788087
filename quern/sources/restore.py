"""Stored sessions back to client transcript files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fidelity(source_agent: str, target: str) -> str:
    """``native`` if the session came from the target client or a sub-agent of it, else ``foreign``."""
    return "native" if source_agent == target or source_agent.startswith(target + "/") else "foreign"


def claude_code_lines(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, position, value): JSON lines of each session's file, in order of time and id. Carriers are replayed as they were."""
    block = (
        F.when(F.col("type") == "text", F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
        .when(F.col("type") == "reasoning", F.to_json(F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking"))))
        .when(F.col("type") == "tool_call", F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("call_id").alias("id"), F.col("tool_name").alias("name"), F.try_parse_json("params").alias("input"))))
        .when(F.col("type") == "tool_result", F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_use_id"), F.try_parse_json("result").alias("content"), F.col("is_failure").alias("is_error"))))
    )
    body = parts.select("session_id", F.col("message_id").alias("id"), "ordinal", block.alias("block")).where("block is not null").groupBy("session_id", "id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"]), ","), F.lit("]")).alias("content"))
    rows = messages.drop("content").join(body.withColumnRenamed("content", "content_blocks"), ["session_id", "id"], "left").join(sessions.select(F.col("id").alias("session_id"), F.col("project").alias("cwd")), "session_id")
    slot = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    turn = F.to_json(F.struct(slot.alias("type"), F.col("id").alias("uuid"), F.col("session_id").alias("sessionId"), "timestamp", "cwd", F.struct(slot.alias("role"), F.try_parse_json(F.coalesce("content_blocks", F.lit("[]"))).alias("content")).alias("message")))
    name = F.concat(F.regexp_replace("cwd", r"[^A-Za-z0-9]", "-"), F.lit("/"), F.regexp_replace("session_id", "/", "/subagents/"), F.lit(".jsonl"))
    return rows.select(name.alias("path"), F.struct("timestamp", "id").alias("position"), F.when((F.col("role") == "system") & F.try_parse_json("options").isNotNull(), F.col("options")).otherwise(turn).alias("value"))


def write_files(lines: DataFrame, root: str) -> list[str]:
    """Write each path below ``root`` in order; an existing file is never overwritten, and a failure removes what was written."""
    written: list[str] = []
    handle, current = None, None
    try:
        for row in lines.orderBy("path", "position").select("path", "value").toLocalIterator():
            if row.path != current:
                if handle:
                    handle.close()
                full = os.path.join(root, row.path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                handle, current = open(full, "x", encoding="utf-8"), row.path  # noqa: SIM115
                written.append(full)
            handle.write(row.value + "\n")
    except BaseException:
        for full in written:
            os.remove(full)
        raise
    finally:
        if handle:
            handle.close()
    return written
