"""Read-only SQL over the archive: a gate, views, functions, budgets, hints and exports.

A statement is parsed by Spark's own parser and its whole tree (children, CTE bodies,
subqueries inside expressions) is checked against a list of allowed nodes, so anything that
is not a query is refused before it is analysed. Relations must be views of the archive or
CTEs of the statement itself: paths, catalogs and commands cannot be reached. Functions that
run code (reflect and the like, TRANSFORM) are refused.

The views live under their plain names in a Spark session of the surface's own, so statements run as
they are written. Names that Spark spells otherwise are changed in the statement's code only, never in
literals, quoted names or comments (``pieces``). Double quotes enclose identifiers.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.json_getters import MAX_KEYS
from quern.operators import bm25
from quern.session import fresh_path

INLINE_ROWS, INLINE_MOST, INLINE_BYTES, JSON_BYTES, CELL = 100, 1000, 80_000, 2 * 1024 * 1024, 1000
TIMEOUT, LEAST_TIMEOUT, MOST_TIMEOUT = 30, 1, 600

_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit LimitAndOffset Offset Tail UnresolvedRelation UnresolvedInlineTable SubqueryAlias Join LateralJoin AsOfJoin Union Except Intersect Distinct UnresolvedWith UnresolvedHaving OneRowRelation Generate "
    "UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases WithWindowDefinition Pivot Unpivot Window Deduplicate UnresolvedHint UnresolvedTVFAliases Sample LocalRelation Range UnresolvedOrdinal RepartitionByExpression Repartition UnionLoop UnresolvedTVFAliases".split()
)
_FTS = r"(\b(?:from|join)\s+)fts\s*\(\s*'(\w+)'\s*,\s*'((?:[^']|'')*)'\s*\)"
_ALIAS = re.compile(r"\s+(?:as\s+)?(?!where\b|join\b|on\b|group\b|order\b|limit\b|left\b|right\b|inner\b|full\b|cross\b|union\b|having\b|using\b|semi\b|anti\b|lateral\b|natural\b|intersect\b|except\b|window\b|offset\b)[A-Za-z_]", re.I)
_CODE = frozenset("reflect java_method try_reflect try_java_method python_udf".split())
_JSON = ("options", "params", "result", "variant_data")
#: Error classes of Spark and what to tell the caller; the first that fits is used.
HINTS = (
    ("UNRESOLVED_COLUMN", "columns are those of SELECT * FROM information_schema_columns; conversational text is messages.search_text, part bodies are parts.text, parts.params and parts.result"),
    ("UNRESOLVED_ROUTINE", "JSON is read with json_get_string|int|float|bool(col, key), json_get(col, key) and json_extract(col, '$.a.b'); ranked text search is fts('messages', 'words') in FROM"),
    ("TABLE_OR_VIEW_NOT_FOUND", "the tables are sessions, messages and parts"),
    ("WRONG_NUM_ARGS", "json_get_string(col, key, ..) takes a column and one to six keys or indexes; whole paths are read with json_extract(col, '$.a.b')"),
    ("DIVIDE_BY_ZERO", "guard the divisor with nullif(x, 0) or use try_divide"),
    ("CAST_INVALID_INPUT", "use try_cast to get NULL where a value does not fit"),
    ("MISSING_AGGREGATION", "every selected column must be grouped or aggregated; any_value(col) picks one"),
    ("DATATYPE_MISMATCH", "compare values of one type; JSON fields need a typed getter"),
)


#: Date codes of ``to_char`` and how Java's formatter writes them; %% last.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSSSSS", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}
#: Names of functions that Spark calls otherwise.
_RENAMED = {"approx_distinct": "approx_count_distinct", "approx_percentile_cont": "approx_percentile", "to_char": "quern_to_char", "log": "quern_log"}
_PIECE = re.compile(r"""(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`)|(?P<note>--[^\n]*|/\*.*?\*/)""", re.S)


def pieces(sql: str) -> Iterator[tuple[str, str]]:
    """The statement in pieces: ``code``, ``text`` (string literals), ``name`` (quoted identifiers) and ``note`` (comments)."""
    at = 0
    for m in _PIECE.finditer(sql):
        if m.start() > at:
            yield "code", sql[at : m.start()]
        yield m.lastgroup, m[0]
        at = m.end()
    if at < len(sql):
        yield "code", sql[at:]


class SqlRefused(ValueError):
    """The statement is not allowed."""


class SqlFailed(RuntimeError):
    """The statement is allowed but does not run."""


class SqlTimeout(SqlFailed):
    """The statement took too long."""


def _seq(xs) -> Iterator:
    it = xs.iterator()
    while it.hasNext():
        yield it.next()


def _walk(node) -> Iterator[tuple[str, object]]:
    """Every plan and expression below a parsed node, CTE bodies and subqueries included."""
    kind = node.getClass().getSimpleName()
    yield kind, node
    if kind == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            yield from _walk(pair.productElement(1))
    if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "InSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from _walk(node.query() if kind == "InSubquery" else node.plan())
    if _is_plan(node):
        for e in _seq(node.expressions()):
            yield from _walk(e)
    for child in _seq(node.children()):
        yield from _walk(child)


def _is_plan(node) -> bool:
    cls = node.getClass()
    while cls is not None:
        if cls.getName() == "org.apache.spark.sql.catalyst.plans.QueryPlan":
            return True
        cls = cls.getSuperclass()
    return False


class SqlSurface:
    """SQL over sessions, messages and parts. ``tables`` hold the canonical columns; ids are renamed to ``session_id`` and ``message_id``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], timeout: int = TIMEOUT, scores: Callable[..., DataFrame] | None = None):
        """``scores``: how one full-text query of the messages is scored (words, operator), where an index is stored."""
        self.scores = scores or (lambda words, operator="or": bm25.scores(self.views["messages"], ["session_id", "message_id"], "search_text", words, operator=operator))
        self.timeout = max(LEAST_TIMEOUT, min(timeout, MOST_TIMEOUT))
        self.spark = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if key.startswith(("spark.sql.", "quern.")) and spark.conf.isModifiable(key) or key.startswith("quern."):
                self.spark.conf.set(key, value)
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.views: dict[str, DataFrame] = {}
        self._scored: set[str] = set()
        for name, df in tables.items():
            key = {"messages": "message_id", "sessions": "session_id"}.get(name)
            if key and "id" in df.columns:
                df = df.withColumnRenamed("id", key)
            self.views[name] = df.drop("data", "message_key")
        rows = [(t, c, d) for t, df in self.views.items() for c, d in df.dtypes]
        self.views["information_schema_columns"] = spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
        for name, df in self.views.items():
            self._adopt(df, name)
        self._functions()

    def _adopt(self, df: DataFrame, name: str) -> None:
        """Make a DataFrame of any session a view of this one."""
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().analyzed())
        DataFrame(jdf, self.spark).createOrReplaceTempView(name)

    def _functions(self) -> None:
        getters = {"string": "STRING", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN"}
        keys = "k1 STRING" + "".join(f", k{i} STRING DEFAULT NULL" for i in range(2, MAX_KEYS + 1))
        step = "CASE WHEN {k} IS NULL THEN '' WHEN try_cast({k} AS INT) IS NULL THEN concat('[\\'', {k}, '\\']') ELSE concat('[', {k}, ']') END"
        path = "concat('$', " + ", ".join(step.format(k=f"k{i}") for i in range(1, MAX_KEYS + 1)) + ")"
        pattern = "f"
        for i, code in enumerate(_STRFTIME):
            pattern = f"replace({pattern}, '%{code}', '{chr(0xE000 + i)}')"
        pattern = f"regexp_replace({pattern}, '([A-Za-z]+)', '\\'$1\\'')"
        for i, java in enumerate(_STRFTIME.values()):
            pattern = f"replace({pattern}, '{chr(0xE000 + i)}', '{java}')"
        micros = "(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + CAST(extract(SECOND FROM width) * 1000000 AS BIGINT))"
        define = [
            *[f"json_get_{n}(j STRING, {keys}) RETURNS {t} RETURN try_cast(get_json_object(j, {path}) AS {t})" for n, t in getters.items()],
            f"json_get(j STRING, {keys}) RETURNS STRING RETURN get_json_object(j, {path})",
            "json_extract(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
            "json_array_contains(j STRING, k STRING, v STRING) RETURNS BOOLEAN RETURN array_contains(from_json(get_json_object(j, concat('$.', k)), 'array<string>'), v)",
            "json_array_count(j STRING, k STRING) RETURNS INT RETURN json_array_length(get_json_object(j, concat('$.', k)))",
            "contains_tokens(t STRING, words STRING) RETURNS BOOLEAN RETURN size(array_except(filter(split(words, '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), split(t, '[^\\\\p{L}\\\\p{N}]+'))) = 0",
            "starts_with(s STRING, p STRING) RETURNS BOOLEAN RETURN startswith(s, p)",
            "ends_with(s STRING, p STRING) RETURNS BOOLEAN RETURN endswith(s, p)",
            "regexp_match(s STRING, p STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN regexp_like(s, p) THEN regexp_extract_all(s, p, 0) END",
            f"date_bin(width INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP) RETURNS TIMESTAMP RETURN timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(t) - unix_micros(origin)) / {micros}) AS BIGINT) * {micros})",
            "age(a TIMESTAMP, b TIMESTAMP) RETURNS INTERVAL DAY TO SECOND RETURN a - b",
            f"quern_to_char(t TIMESTAMP, f STRING) RETURNS STRING RETURN date_format(t, {pattern})",
            "quern_log(a DOUBLE, b DOUBLE DEFAULT NULL) RETURNS DOUBLE RETURN CASE WHEN b IS NULL THEN log10(a) ELSE log(a, b) END",
        ]
        for text in define:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")

    # the gate

    def check(self, sql: str) -> bool:
        """Refuse whatever is not one read-only query; True for EXPLAIN."""
        text = sql.strip().rstrip(";").strip()
        explain = re.match(r"explain\s+(?:analyze\s+|formatted\s+|extended\s+)?", text, re.I)
        body = text[explain.end() :] if explain else text
        try:
            tree = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        except Exception as error:  # noqa: BLE001 - py4j wraps the parser's exception
            message = str(getattr(error, "java_exception", error)).split("\n")[0]
            raise SqlRefused(f"not one statement that can be parsed: {message}") from None
        named: set[str] = set()
        relations: list[str] = []
        for kind, node in _walk(tree):
            if kind == "UnresolvedWith":
                named |= {pair.productElement(0).lower() for pair in _seq(node.cteRelations())}
            if kind == "UnresolvedRelation":
                relations.append(".".join(_seq(node.multipartIdentifier())))
            elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
                name = ".".join(_seq(node.nameParts() if kind == "UnresolvedFunction" else node.name())).lower()
                if name.split(".")[-1] in _CODE:
                    raise SqlRefused(f"the function {name} is not allowed")
            elif _is_plan(node) and kind not in _NODES:
                raise SqlRefused(f"only queries are allowed, not {kind}")
        for name in relations:
            plain = name.lower().removeprefix("information_schema.")
            if plain not in named and plain not in self.views and plain.replace("columns", "information_schema_columns") not in self.views and name not in self._scored:
                raise SqlRefused(f"no table {name}; the tables are {', '.join(sorted(self.views))}")
        self._check_text(body)
        return bool(explain)

    def _check_text(self, body: str) -> None:
        columns = "|".join(_JSON)
        body = "".join(t if kind != "text" or t.startswith(("'%", "'$'")) else "''" for kind, t in pieces(body) if kind != "note")
        if re.search(rf"\bselect\b(?:(?!\bfrom\b).)*(?<![\w.'])(?:\w+\.)?vector\b(?!\s*\()", body, re.I | re.S):
            raise SqlRefused("the column vector cannot be selected; it may be used in WHERE")
        if re.search(rf"\bcast\s*\(\s*(?:\w+\.)?(?:{columns})\s+as\b|(?:{columns})\s*::", body, re.I):
            raise SqlRefused("JSON columns cannot be cast; use json_extract(col, '$') for the whole or json_get_string(col, key) for a field")
        if re.search(r"json_extract\s*\(\s*[\w.]+\s*,\s*'\$'\s*\)\s+(?:not\s+)?i?like\s+'%", body, re.I):
            raise SqlRefused("a leading wildcard over a whole JSON document reads everything; extract the field first")

    # running

    def _fts(self, body: str) -> str:
        """``fts('messages', 'words')`` in FROM becomes a view of scored messages."""

        def swap(m: re.Match) -> str:
            lead, table, query = m[1], m[2], m[3].replace("''", "'")
            df = self.views[table]
            try:
                clause = json.loads(query)
            except ValueError:
                clause = {"match": {"terms": query}}
            keys = ["session_id", "message_id"]
            if "boolean" in clause:
                terms = {k: [c["match"]["terms"] for c in clause["boolean"].get(k, [])] for k in ("must", "should", "must_not")}
                scored = bm25.combine(self.scores, keys, **terms)
            elif "match" in clause:
                scored = self.scores(clause["match"]["terms"], operator=clause["match"].get("operator", "or").lower())
            else:
                raise SqlRefused("fts takes words, a match or a boolean query; phrases are not indexed")
            name = f"fts_{uuid.uuid4().hex[:12]}"
            self._adopt(df.join(scored.withColumnRenamed("score", "_score"), keys), name)
            self._scored.add(name)
            return f"{lead}{name}" + ("" if _ALIAS.match(body, m.end()) else " AS fts")

        code, at = set(), 0
        for kind, text in pieces(body):
            if kind == "code":
                code.update(range(at, at + len(text)))
            at += len(text)
        return re.sub(_FTS, lambda m: swap(m) if m.start() in code else m[0], body, flags=re.I)

    def _spelled(self, body: str) -> str:
        """The statement in Spark's spelling; only code is touched."""
        out = []
        for kind, text in pieces(body):
            if kind == "code":
                text = re.sub(r"\binformation_schema\s*\.\s*columns\b", "information_schema_columns", text, flags=re.I)
                text = re.sub(rf"\b({'|'.join(_RENAMED)})(\s*\()", lambda m: _RENAMED[m[1].lower()] + m[2], text, flags=re.I)
            out.append(text)
        return "".join(out)

    def frame(self, sql: str) -> DataFrame:
        """The checked statement as a DataFrame; vectors and binary columns are left out of a wildcard."""
        text = sql.strip().rstrip(";").strip()
        gated = re.sub(_FTS, r"\1\2", text, flags=re.I)
        if any(kind == "code" and re.search(r"\bfts\s*\(", t, re.I) for kind, t in pieces(gated)):
            raise SqlRefused("fts('messages', 'words') is a table: use it in FROM")
        self.check(self._spelled(gated))
        try:
            df = self.spark.sql(self._spelled(self._fts(text)))
        except PySparkException as error:
            raise SqlFailed(self.hint(error)) from error
        hidden = [f.name for f in df.schema.fields if f.dataType.simpleString() == "binary" or f.name == "vector"]
        shown = df.drop(*hidden)
        return shown.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in shown.schema.fields])

    def hint(self, error: Exception) -> str:
        text = str(error)
        name = (error.getCondition() if isinstance(error, PySparkException) else "") or ""
        return next((f"{text}\nhint: {hint}" for pattern, hint in HINTS if pattern in name or pattern in text), text)

    def _timed(self, run):
        tag = f"quern-{uuid.uuid4().hex}"
        expired = threading.Event()

        def stop() -> None:
            expired.set()
            self.spark.interruptTag(tag)

        self.spark.addTag(tag)
        timer = threading.Timer(self.timeout, stop)
        timer.start()
        try:
            return run()
        except PySparkException as error:
            if expired.is_set():
                raise SqlTimeout(f"the query took more than {self.timeout} s") from error
            raise SqlFailed(self.hint(error)) from error
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def rows(self, sql: str, limit: int = INLINE_ROWS, budget: int = JSON_BYTES) -> dict:
        """JSON mode: at most ``limit`` rows within a byte budget, the first always; NULL keys are left out."""
        limit = max(1, min(limit, INLINE_MOST))
        got = self._timed(lambda: self.frame(sql).limit(limit + 1).toJSON().collect())
        out, used = [], 0
        for line in got[:limit]:
            used += len(line.encode())
            if out and used > budget:
                break
            out.append(json.loads(line))
        return {"rows": out, "truncated": len(out) < len(got)}

    def inline(self, sql: str, limit: int = INLINE_ROWS) -> str:
        """Table of text with clipped cells; rows are halved until it fits the budget."""
        limit = max(1, min(limit, INLINE_MOST))
        columns, got = self._timed(lambda: ((df := self.frame(sql)).columns, df.limit(limit + 1).collect()))
        shown = got[:limit]
        clip = lambda v: "NULL" if v is None else (s if len(s) <= CELL else s[:CELL] + "...") if (s := re.sub(r"\s*\n\s*", " ", str(v))) is not None else ""
        while True:
            lines = [" | ".join(columns), *(" | ".join(clip(v) for v in r) for r in shown)]
            text = "\n".join(lines)
            if len(text.encode()) <= INLINE_BYTES or len(shown) <= 1:
                break
            shown = shown[: len(shown) // 2]
        return f"{len(shown)} rows{' (more follow)' if len(shown) < len(got) else ''}\n{text}"

    def explain(self, sql: str) -> str:
        """The formatted plan; after ANALYZE the plan as it ran, each operator with its counts."""
        lead = re.match(r"\s*explain\s+(analyze\s+|formatted\s+|extended\s+)?", sql, re.I)
        df = self.frame(sql[lead.end() :] if lead else sql)
        execution = df._jdf.queryExecution()
        if not (lead and lead[1] and lead[1].lower().strip() == "analyze"):
            return execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        self._timed(lambda: execution.toRdd().count())
        lines: list[str] = []

        def walk(node, depth: int) -> None:
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                return walk(node.executedPlan(), depth)
            if kind.endswith("QueryStageExec"):
                return walk(node.plan(), depth)
            counts = [f"{m._1()}={m._2().value()}" for m in _seq(node.metrics()) if m._2().value() > 0]
            lines.append("  " * depth + f"{node.nodeName()} {' '.join(sorted(counts))}".rstrip())
            for child in _seq(node.children()):
                walk(child, depth + 1)

        walk(execution.executedPlan(), 0)
        return "\n".join(lines)

    def export(self, sql: str, form: str = "parquet") -> str:
        """Write the whole result as parquet or ndjson to the shared folder; returns the path."""
        if re.match(r"\s*explain\b", sql, re.I):
            raise SqlRefused("EXPLAIN cannot be exported")
        if form not in ("parquet", "ndjson"):
            raise SqlRefused("an export is parquet or ndjson")
        path = fresh_path(self.spark, "export")

        def run() -> None:
            writer = self.frame(sql).write
            writer.parquet(path) if form == "parquet" else writer.json(path)

        self._timed(run)
        return path
