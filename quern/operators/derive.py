"""Derived columns of the archive: searchable text, tool identity, ids, labels and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blank, id_key

# Fixed values of the client formats: how text that the client put into the user's slot begins.
INJECTED_PREFIXES = ("<task-notification>", "<command-name>", "<command-message>", "<command-args>", "<local-command-caveat>", "<local-command-stdout>", "[Request interrupted by user")
INJECTED_PREFIXES_ENVELOPE = ("<environment_context>", "<user_instructions>", "# AGENTS.md")
#: A text leaf above this many bytes is replaced by a marker that keeps its size.
#: Bytes beyond which the readers of client formats put a marker in place of a text; None keeps every text whole.
TEXT_CAP: int | None = None


def canonical_role(role: Column | str) -> Column:
    """system, user, assistant or tool, whatever spelling the client used; NULL for anything else."""
    r = id_key(role)
    return F.when(r.isin("system", "developer"), "system").when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "model"), "assistant").when(r.isin("tool", "function", "toolresult"), "tool")


def search_text(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, message_key, search_text) of user and assistant messages.

    Conversational text parts, and file parts by name and media type, joined by newlines in
    the order of their ordinals; chunks that are blank are left out; nothing left gives NULL.
    Exact repeats of a part count once.
    """
    p = parts.where("provenance = 'conversational' and type in ('text', 'file') and session_id is not null and message_id is not null")
    chunks = F.when(F.col("type") == "text", F.array("text")).otherwise(F.array("file_name", "media_type"))
    kept = F.filter(chunks, lambda c: ~blank(c))
    rows = p.select("session_id", id_key("message_id").alias("message_key"), "id", F.coalesce("ordinal", F.lit(2**31 - 1)).alias("ordinal"), kept.alias("chunks")).where(F.size("chunks") > 0).distinct()
    joined = rows.groupBy("session_id", "message_key").agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "chunks"))).alias("c")).select("session_id", "message_key", F.array_join(F.flatten(F.transform("c", lambda x: x["chunks"])), "\n").alias("search_text"))
    speakers = messages.where(canonical_role("role").isin("user", "assistant")).select("session_id", "message_key").distinct()
    return speakers.join(joined, ["session_id", "message_key"], "left")


def tool_identity(parts: DataFrame) -> DataFrame:
    """Part rows with ``tool_name``, ``call_id`` and ``is_failure`` only where their type has them."""
    call, result = F.col("type") == "tool_call", F.col("type") == "tool_result"
    approval = F.col("type") == "tool_approval_request"
    return parts.withColumns({"tool_name": F.when(call | result, F.col("tool_name")), "call_id": F.when(call | result | approval, F.col("call_id")), "is_failure": F.when(result, F.col("is_failure"))})


def part_id(message_id: Column | str, ordinal: Column | str) -> Column:
    return F.format_string("%s:%04d", message_id, ordinal)


def session_root(session_id: Column | str) -> Column:
    """Grouping key of search results: the id up to its first slash."""
    return F.substring_index(session_id, "/", 1)


def is_subagent(source_agent: Column | str) -> Column:
    return (F.col(source_agent) if isinstance(source_agent, str) else source_agent).contains("/")


def user_provenance(text: Column | str, is_meta: Column | None = None, prefixes: tuple[str, ...] = INJECTED_PREFIXES) -> Column:
    t = F.ltrim(F.col(text) if isinstance(text, str) else text)
    injected = reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes])
    injected = injected if is_meta is None else injected | F.coalesce(is_meta, F.lit(False))
    return F.when(F.coalesce(injected, F.lit(False)), "injected").otherwise("conversational")


def capped(text: Column | str, cap: int | None = None) -> Column:
    """The whole text, or, where a cap in bytes is set, a marker with the size of a longer one."""
    c, cap = F.col(text) if isinstance(text, str) else text, cap or TEXT_CAP
    return c if cap is None else F.when(F.octet_length(c) > cap, F.concat(F.lit("[text of "), F.octet_length(c).cast("string"), F.lit(" bytes left out]"))).otherwise(c)


def rfc3339(time: Column | str) -> Column:
    """A timestamp as text in UTC with exactly six digits behind the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def part_body(parts: DataFrame) -> DataFrame:
    """Parts with ``body`` (VARIANT): of a file its media type, name and kind of data, of every other type its own fields without NULLs."""
    field = lambda *names: F.to_json(F.struct(*names))
    file = F.to_json(F.struct("media_type", "file_name", F.when(F.col("file_name").isNotNull(), "name").otherwise("inline").alias("data_kind")))
    body = (
        F.when(F.col("type") == "file", file)
        .when(F.col("type") == "tool_call", field("tool_name", "call_id", "params"))
        .when(F.col("type") == "tool_result", field("tool_name", "call_id", "is_failure", "result"))
        .otherwise(field("text"))
    )
    return parts.withColumn("body", F.try_parse_json(body))


def part_from_body(parts: DataFrame) -> DataFrame:
    """The columns of ``part_body`` read back from ``body``; a body that cannot be read gives NULLs."""
    get = lambda name, kind: F.try_variant_get("body", f"$.{name}", kind).alias(name)
    own = [get(n, "boolean" if n == "is_failure" else "string") for n in ("text", "tool_name", "call_id", "is_failure", "params", "result", "media_type", "file_name")]
    return parts.select("session_id", "message_id", "id", "ordinal", "type", *own)


def part_label(parts: DataFrame) -> DataFrame:
    """(.., label): a short name of what a part is; NULL for text and reasoning."""
    label = (
        F.when(F.col("type") == "file", F.coalesce("file_name", "media_type"))
        .when((F.col("type") == "tool_result") & F.col("is_failure"), F.concat(F.coalesce("tool_name", F.lit("tool")), F.lit(" (failed)")))
        .when(F.col("type").isin("tool_call", "tool_result"), F.col("tool_name"))
    )
    return parts.withColumn("label", label)


class P:
    """Scalar predicates as column builders; ``all_of`` of nothing is true, empty ``any_of`` terms are dropped."""

    eq = staticmethod(lambda c, v: F.col(c) == v)
    ne = staticmethod(lambda c, v: F.col(c) != v)
    is_null = staticmethod(lambda c: F.col(c).isNull())
    is_not_null = staticmethod(lambda c: F.col(c).isNotNull())
    like_contains = staticmethod(lambda c, v: F.contains(F.col(c), F.lit(v)))
    regex = staticmethod(lambda c, v: F.col(c).rlike(v))
    gte = staticmethod(lambda c, v: F.col(c) >= v)
    lte = staticmethod(lambda c, v: F.col(c) <= v)
    not_ = staticmethod(lambda p: ~p)

    @staticmethod
    def within(c: str, values: list) -> Column:
        return F.col(c).isin(list(values))

    @staticmethod
    def all_of(*terms: Column) -> Column:
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    @staticmethod
    def any_of(*terms: Column | None) -> Column:
        kept = [t for t in terms if t is not None]
        return reduce(lambda a, b: a | b, kept) if kept else F.lit(True)


def scope(project: str | None = None, project_regex: str | None = None, session_id: str | None = None, source_agent: str | None = None, from_date: str | None = None, to_date: str | None = None, timestamp: str = "timestamp") -> Column:
    """Search filter; every clause given must hold. Dates are ``YYYY-MM-DD``, the last day up to 23:59:59."""
    import re

    terms: list[Column] = []
    if project is not None:
        terms.append(P.like_contains("project", project))
    if project_regex is not None:
        terms.append(P.regex("project", project_regex))
    if session_id is not None:
        terms.append(P.eq("session_id", session_id))
    if source_agent is not None:
        terms.append(P.regex("source_agent", "^" + re.sub(r"([^\w/ ])", r"\\\1", source_agent) + "(/|$)"))
    for day, time, bound in ((from_date, "00:00:00", P.gte), (to_date, "23:59:59", P.lte)):
        if day is not None:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
                raise ValueError(f"a date is written YYYY-MM-DD, not {day!r}")
            terms.append(bound(timestamp, F.lit(f"{day} {time}").cast("timestamp")))
    return P.all_of(*terms)
