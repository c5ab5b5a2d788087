"""Store, ingest, export, copy, SQL surface, search, reads, adapters and streaming on small fixtures."""

import json
import sqlite3
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import fulltext
from quern.operators import bm25, copying, derive, ingest, reads, search, vectors
from quern.plans.sql_surface import SqlFailed, SqlRefused, SqlSurface
from quern.sources import adapters
from quern.store import Conflict, Store
from quern.streaming.ingest import stream_ingest


def ev(seq, kind, batch="b", **payload):
    return (batch, seq, kind, json.dumps(payload))


def events(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, seq bigint, kind string, payload string")


STREAM = [
    ev(1, "message", id="m0", session_id="s1"),
    ev(2, "session", id="s1", source_agent="cli", project="/p", created_at="2024"),
    ev(3, "part", id="p0", session_id="s1", message_id="m1"),
    ev(4, "message", id="m1", session_id="s1", role="user"),
    ev(5, "part", id="p1", session_id="s1", message_id="m1", ordinal=0, type="text", text="hi"),
    ev(6, "part", id="p1", session_id="s1", message_id="m1", ordinal=0, type="text", text="again"),
    ev(7, "message", id="m1", session_id="s1", role="user"),
    ev(8, "message", id="m2", session_id="other", role="user"),
    ev(9, "part", id="p2", session_id="s1", message_id="m2"),
    ev(10, "session", id="s2", source_agent="  ", project="/p"),
    ev(11, "message", id="m3", session_id="s2", role="user"),
    ev(12, "session", id="s3", source_agent="cli", project="/p", parent_message_id="x"),
    ev(13, "session", id="s4", source_agent="cli", project="/p"),
    ev(14, "message", id="m4", session_id="s4", role="assistant"),
    ("b", 15, "message", "{broken"),
    ("b", 16, "oddity", json.dumps({"id": "z"})),
]


def test_validation_reasons(spark):
    got = {r.seq: r.reason for r in ingest.validate(events(spark, STREAM)).collect()}
    assert got == {
        1: "message_before_session", 2: None, 3: "part_before_message", 4: None, 5: None, 6: "duplicate_part_key", 7: "duplicate_message_id", 8: "message_session_mismatch", 9: "part_message_mismatch",
        10: "empty_source_agent", 11: "message_before_session", 12: "parent_message_without_session", 13: None, 14: None, 15: "uncategorized", 16: "uncategorized",
    }


def test_ingest_is_idempotent_and_keeps_stored_labels(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    first = {r.outcome: r["count"] for r in ingest.ingest(store, events(spark, STREAM)).groupBy("outcome").count().collect()}
    assert first == {"inserted": 5, "error": 11}
    again = {r.outcome: r["count"] for r in ingest.ingest(store, events(spark, STREAM)).groupBy("outcome").count().collect()}
    assert again == {"matched": 5, "error": 11}
    assert store.counts() == {"sessions": 2, "messages": 2, "parts": 1}
    relabelled = [ev(1, "session", id="s1", source_agent="new", project="/q"), ev(2, "message", id="m9", session_id="s1", role="user")]
    ingest.ingest(store, events(spark, relabelled)).collect()
    m = store.table("messages", F.col("id") == "m9").first()
    assert (m.source_agent, m.project) == ("cli", "/p")
    with pytest.raises(ValueError):
        ingest.check_batch([])


def test_store_updates_snapshots_conflicts_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, n int")
    assert store.append_absent("sessions", df) == 2
    at = store.version("sessions")
    assert store.append_absent("sessions", spark.createDataFrame([("b", 9), ("c", 5)], "id string, n int")) == 1
    assert store.table("sessions", version=at).count() == 2
    assert store.update_matched("sessions", spark.createDataFrame([("a", 7), ("zz", 1)], "id string, n int")) == 1
    store.append("sessions", spark.createDataFrame([("d", 6)], "id string, n int"))
    store.compact("sessions")
    assert sorted((r.id, r.n) for r in store.table("sessions").collect() if r.id != "b") == [("a", 7), ("c", 5), ("d", 6)]
    with pytest.raises(Conflict):
        store._commit("sessions", 1, [])


def test_copy_and_verify(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        copying.copy(a, b)
    ingest.ingest(a, events(spark, STREAM)).collect()
    assert copying.copy(a, b) == {"parts": 1, "messages": 2, "sessions": 2}
    assert copying.copy(a, b) == {"parts": 0, "messages": 0, "sessions": 0}
    assert all(r.synced for r in copying.verify_stores(a, b).collect())


def test_export_order(spark):
    s = spark.createDataFrame([("s2",), ("s1",)], "id string")
    m = spark.createDataFrame([("s1", "b", "2"), ("s1", "a", "2"), ("s1", "z", "1")], "session_id string, id string, timestamp string")
    p = spark.createDataFrame([("s1", "z", "q", 1), ("s1", "z", "r", 0)], "session_id string, message_id string, id string, ordinal int")
    got = [(e["kind"], e["id"]) for e in (json.loads(r.value) for r in ingest.export_events(s, m, p).collect())]
    assert got == [("session", "s1"), ("message", "z"), ("part", "r"), ("part", "q"), ("message", "a"), ("message", "b"), ("session", "s2")]


def test_stream_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.json").write_text("\n".join(json.dumps({"batch_id": b, "seq": s, "kind": k, "payload": p}) for b, s, k, p in STREAM))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        stream_ingest(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    assert store.counts() == {"sessions": 2, "messages": 2, "parts": 1}


# SQL


@pytest.fixture(scope="module")
def sql(spark):
    m = spark.createDataFrame([("s", "m-user", datetime(2024, 1, 1), "user", "what is the answer\nreally", "{}", [1.0]), ("s", "m-asst", datetime(2024, 1, 2), "assistant", "the answer is forty-two", '{"a":{"b":[1,"x"]},"n":null}', None)], "session_id string, id string, timestamp timestamp, role string, search_text string, options string, vector array<float>")
    p = spark.createDataFrame([("s", "m-asst", "p-call", 1, "tool_call", "Bash", "call-1", None, '{"command":"echo hi"}'), ("s", "m-asst", "p-result", 2, "tool_result", "Bash", "call-1", False, None)], "session_id string, message_id string, id string, ordinal int, type string, tool_name string, call_id string, is_failure boolean, params string")
    s = spark.createDataFrame([("s", "cli")], "id string, source_agent string")
    return SqlSurface(spark, {"messages": m, "parts": p, "sessions": s})


def test_sql_answers(sql):
    one = lambda q: sql.rows(q)["rows"]
    assert len(one("SELECT role, count(*) FROM messages GROUP BY role")) == 2
    assert "vector" not in sql.frame("SELECT * FROM messages").columns
    assert one("SELECT json_get_string(params, 'command') AS c FROM parts WHERE type = 'tool_call'") == [{"c": "echo hi"}]
    assert one("SELECT json_extract(options, '$.a.b') AS b FROM messages WHERE message_id = 'm-asst'") == [{"b": '[1,"x"]'}]
    assert one("SELECT message_id FROM messages WHERE contains_tokens(search_text, 'forty two')") == [{"message_id": "m-asst"}]
    assert one("SELECT c.tool_name, count(*) AS n FROM parts c LEFT JOIN parts r ON c.session_id = r.session_id AND c.call_id = r.call_id AND r.type = 'tool_result' WHERE c.type = 'tool_call' GROUP BY 1") == [{"tool_name": "Bash", "n": 1}]
    assert one("SELECT message_id FROM fts('messages', 'forty') ORDER BY _score DESC") == [{"message_id": "m-asst"}]
    assert one('SELECT message_id FROM fts(\'messages\', \'{"match": {"terms": "answer really", "operator": "And"}}\')') == [{"message_id": "m-user"}]
    assert "what is the answer really" in sql.inline("SELECT search_text FROM messages")
    assert sql.rows("SELECT message_id FROM messages", limit=1) == {"rows": [{"message_id": "m-user"}], "truncated": True} or sql.rows("SELECT message_id FROM messages", limit=1)["truncated"]
    assert "Physical Plan" in sql.explain("EXPLAIN SELECT 1")
    assert "numOutputRows=2" in sql.explain("EXPLAIN ANALYZE SELECT role FROM messages WHERE length(role) > 1")
    assert one("SELECT json_get_string(options, 'a', 'b', 1) AS x, json_get_int(options, 'a', 'b', 0) AS i FROM messages WHERE role = 'assistant'") == [{"x": "x", "i": 1}]
    assert one("SELECT DISTINCT 'copied from messages' AS t, \"role\" FROM messages WHERE role <> 'user'") == [{"t": "copied from messages", "role": "assistant"}]
    assert one("SELECT count(*) AS n FROM sessions , messages WHERE sessions.session_id = messages.session_id -- from parts") == [{"n": 2}]
    assert one("SELECT to_char(timestamp, '%Y/%m/%dT%H h') AS t, log(100.0) AS l, log(2, 8) AS k FROM messages WHERE role = 'user'") == [{"t": "2024/01/01T00 h", "l": 2.0, "k": 3.0}]
    assert one("SELECT fts.message_id FROM fts('messages', 'forty') WHERE 'fts(' <> ''") == [{"message_id": "m-asst"}]
    assert sql.spark.read.parquet(sql.export("SELECT role FROM messages")).count() == 2


@pytest.mark.parametrize(
    "bad",
    [
        "INSERT INTO messages VALUES (1)", "DROP TABLE messages", "SELECT 1; SELECT 2", "SET a = 1", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', '0')", "SELECT TRANSFORM(role) USING 'cat' AS (a) FROM messages",
        "SELECT CAST(options AS string) FROM messages", "SELECT vector FROM messages", "SHOW TABLES", "WITH a AS (SELECT java_method('x', 'y')) SELECT * FROM a", "SELECT (SELECT max(reflect('a', 'b')) FROM parts) FROM messages", "CALL x()",
        "SELECT fts('messages', 'x') FROM messages", "SELECT 1 FROM messages WHERE json_extract(options, '$') LIKE '%x'", "",
    ],
)
def test_sql_refuses(sql, bad):
    with pytest.raises(SqlRefused):
        sql.rows(bad)


def test_sql_hints(sql):
    with pytest.raises(SqlFailed, match="hint"):
        sql.rows("SELECT nope FROM messages")


# search and reads


def test_bm25_against_brute_force(spark):
    import math

    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "alpha alpha delta delta", 4: "", 5: None, 6: "Gamma, GAMMA; beta"}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    words = {k: [w.strip(",;").lower() for w in (v or "").split()] for k, v in docs.items() if v}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q in ("beta", "gamma"):
        n = sum(q in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(q):
                want[k] = want.get(k, 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {r.id: r.score for r in bm25.scores(df, ["id"], "text", "Beta gamma").collect()}
    assert got == pytest.approx(want)
    assert {r.id for r in bm25.boolean(df, ["id"], "text", must=["beta"], must_not=["gamma"]).collect()} == {1}


def test_stemmer():
    want = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "hoping": "hope", "generalizations": "general", "happy": "happi", "running": "run", "naïve": "naïve", "ties": "tie", "vulnerabilities": "vulner", "conditional": "condit"}
    assert {w: fulltext.stem(w) for w in want} == want


def archive(spark):
    rows = [(f"s{i % 3}" + ("/agent" if i % 7 == 0 else ""), f"m{i:02d}", "cli/sub" if i % 7 == 0 else "cli", "/p", datetime(2024, 1, 1 + i), "needle " * (i % 4 + 1) + "hay " * i) for i in range(12)]
    return spark.createDataFrame(rows, "session_id string, message_id string, source_agent string, project string, timestamp timestamp, search_text string")


def test_search_pipeline(spark):
    m = archive(spark)
    found = search.search(m, search.Request("needle", 2), now=F.lit("2024-02-01").cast("timestamp")).collect()
    assert len(found) == 2 and all(h.message_id not in ("m00", "m07") for r in found for h in r.hits)
    assert found[0]["rank"] >= found[1]["rank"]
    recent = search.search(m, search.Request("needle", 3, sort_by="recency")).collect()
    assert [r["rank"] for r in recent] == sorted((r["rank"] for r in recent), reverse=True)
    assert search.searchable(m, F.col("project") == "/p").first()[0] == 12
    with pytest.raises(search.SearchError):
        search.search(m, search.Request("  "))
    cut = search.snippet_of("x" * 700 + " needle " + "y" * 700, "the needle")
    assert "needle" in cut and cut.startswith("[") and len(cut) < 700


def test_pages_and_context(spark):
    m = archive(spark)
    page = reads.session_page(m, "s1", limit=2)
    assert [r.message_id for r in page["messages"]] == ["m01", "m04"] and page["after_remaining"] == 1
    assert [r.message_id for r in reads.session_page(m, "s1", anchor="m10", where="before", budget=1)["messages"]] == ["m04"]
    with pytest.raises(reads.NotFound):
        reads.session_page(m, "s1", anchor="nope")
    near = reads.message_context(m, m.where("message_id = 'm04'"), 1, 1)
    assert {(r.message_id, r.offset) for r in near.collect()} == {("m01", -1), ("m04", 0), ("m10", 1)}


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 40)] + [(99, None), (98, [0.0, 0.0])], "id int, v array<double>")
    got = [r.id for r in vectors.nearest(v, "id", "v", [5.0, 1.0], 3).collect()]
    assert got[0] == 5 and len(got) == 3
    many = vectors.nearest_many(v.where("id < 90"), "id", "v", v.where("id in (5, 9)").select(F.col("id").alias("query"), "v"), 2)
    assert {(r.query, r.key) for r in many.where("rank = 1").collect()} <= {(5, 6), (5, 4), (9, 10)}
    index = vectors.InvertedFile(v.where("id < 90"), "id", "v", lists=4)
    assert index.filed.count() == 39 and index.nearest([5.0, 1.0], 1, probes=4).first().id == 5


def test_derivations(spark):
    p = spark.createDataFrame([("s", " M1", "a", 1, "text", "conversational", "second", None, None), ("s", "m1", "b", 0, "text", "conversational", "first", None, None), ("s", "m1", "b", 0, "text", "conversational", "first", None, None), ("s", "m1", "c", 2, "file", "conversational", None, "f.png", "image/png"), ("s", "m1", "d", 3, "text", "injected", "no", None, None), ("s", "m2", "e", 0, "text", "conversational", "  ", None, None)], "session_id string, message_id string, id string, ordinal int, type string, provenance string, text string, file_name string, media_type string")
    m = spark.createDataFrame([("s", "m1", "Human "), ("s", "m2", "ai"), ("s", "m3", "tool")], "session_id string, message_key string, role string")
    got = {r.message_key: r.search_text for r in derive.search_text(m, p).collect()}
    assert got == {"m1": "first\nsecond\nf.png\nimage/png", "m2": None}
    with pytest.raises(ValueError):
        derive.scope(from_date="yesterday")


# adapters


def test_claude_code_transcript(spark, tmp_path):
    d = tmp_path / "projects" / "-work-x"
    d.mkdir(parents=True)
    rows = [
        {"type": "user", "uuid": "u1", "sessionId": "S", "timestamp": "2025-01-01T00:00:00Z", "cwd": "/work/x", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "uuid": "u2", "sessionId": "S", "timestamp": "2025-01-01T00:00:01Z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "u3", "sessionId": "S", "timestamp": "2025-01-01T00:00:02Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]}},
        {"type": "user", "sessionId": "S", "timestamp": "2025-01-01T00:00:03Z", "message": {"role": "user", "content": "<command-name>x</command-name>"}},
        {"type": "summary", "subtype": "compact", "sessionId": "S", "uuid": "u5"},
    ]
    (d / "S.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    t = adapters.read(spark, "claude-code", str(tmp_path))
    assert [(r.id, r.project, r.source_agent) for r in t["sessions"].collect()] == [("S", "/work/x", "claude-code")]
    assert {r.id: r.role for r in t["messages"].collect()} == {"u1": "user", "u2": "assistant", "u3": "tool", "S:4": "user", "u5": "system"}
    parts = {r.id: (r.type, r.provenance, r.tool_name, r.text) for r in t["parts"].collect()}
    assert parts["u2:0002"][:3] == ("tool_call", "conversational", "Bash") and parts["u3:0000"][:3] == ("tool_result", "injected", "Bash")
    assert parts["S:4:0000"][1] == "injected" and parts["u2:0000"][0] == "reasoning" and parts["u1:0000"][3] == "hello"


def test_codex_letta_export_and_sqlite(spark, tmp_path):
    c = tmp_path / "codex"
    c.mkdir()
    rows = [
        {"timestamp": "T0", "type": "session_meta", "payload": {"id": "C", "cwd": "/w", "timestamp": "T0"}},
        {"timestamp": "T1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"timestamp": "T2", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "k", "arguments": "{}"}},
        {"timestamp": "T3", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": '{"output":"","metadata":{"exit_code":1}}'}},
    ]
    (c / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    t = adapters.read(spark, "codex-cli", str(c))
    assert t["sessions"].first().project == "/w"
    assert {(r.type, r.tool_name, r.is_failure) for r in t["parts"].collect()} == {("text", None, None), ("tool_call", "shell", None), ("tool_result", "shell", True)}
    e = tmp_path / "letta" / "agent-1" / "talk-2"
    e.mkdir(parents=True)
    (e / "transcript.jsonl").write_text(json.dumps({"kind": "user", "text": "q", "captured_at": "T"}) + "\n" + json.dumps({"kind": "tool_call", "name": "f", "argsText": "{}", "resultText": "r", "resultOk": False, "captured_at": "T"}))
    t = adapters.read(spark, "letta-code", str(tmp_path / "letta"))
    assert t["sessions"].first().id == "agent-1+talk-2" and t["messages"].count() == 3
    assert {r.type for r in t["parts"].collect()} == {"text", "tool_call", "tool_result"}
    z = tmp_path / "x.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("conversations.json", json.dumps([{"uuid": "U", "account": {"uuid": "A"}, "created_at": "T", "chat_messages": [{"uuid": "1", "sender": "human", "created_at": "T", "content": [{"type": "text", "text": "hey"}]}]}]))
    t = adapters.read(spark, "claude-ai-export", str(z))
    assert t["sessions"].first().project == "A" and t["parts"].first().text == "hey"
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE t (a int, b text)")
    db.execute("INSERT INTO t VALUES (1, 'x')")
    db.commit()
    db.close()
    assert adapters.sqlite_rows(spark, str(tmp_path / "a.db")).selectExpr("table", "value:b::string AS b").first().b == "x"
    with pytest.raises(KeyError):
        adapters.read(spark, "nobody", "/")
