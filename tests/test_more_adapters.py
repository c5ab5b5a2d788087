import json
import sqlite3
from datetime import datetime, timezone

import pytest

from quern.sources import adapters, restore


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)))


def shape(t):
    return sorted((r.type, r.provenance, r.tool_name, r.call_id) for r in t["parts"].collect())


#: Invented instants: 3 February 2023, 04:05:06.789 UTC, and a minute later.
FIRST_MS = int(datetime(2023, 2, 3, 4, 5, 6, tzinfo=timezone.utc).timestamp()) * 1000 + 789
LATER_MS = FIRST_MS + 60_000


def test_pi_and_kin(spark, tmp_path):
    said = lambda n, role, content, **more: {"type": "message", "id": f"row-{n}", "timestamp": f"2023-02-03T04:0{n}:00Z", "message": {"role": role, "content": content, **more}}
    put(tmp_path / "a" / "otter.jsonl", [
        {"type": "session", "version": 3, "id": "otter", "timestamp": "2023-02-03T04:00:00Z", "cwd": "/srv/mill"},
        said(1, "user", [{"type": "text", "text": "count the sacks"}]),
        {"type": "model_change", "id": "row-2", "timestamp": "2023-02-03T04:02:00Z"},
        said(3, "assistant", [{"type": "toolCall", "id": "call-7", "name": "count", "arguments": {"of": "sacks"}}, {"type": "thinking", "thinking": "flour or grain?"}]),
        said(4, "toolResult", [{"type": "text", "text": "door locked"}], toolCallId="call-7", toolName="count", isError=True),
    ])
    t = adapters.read(spark, "pi-coding-agent", str(tmp_path))
    assert {r.id: r.role for r in t["messages"].collect()} == {"row-1": "user", "row-2": "system", "row-3": "assistant", "row-4": "tool"}
    assert shape(t) == [("reasoning", "conversational", None, None), ("text", "conversational", None, None), ("tool_call", "conversational", "count", "call-7"), ("tool_result", "injected", "count", "call-7")]
    put(tmp_path / "b" / "heron.jsonl", [{"kind": "header", "version": 4, "id": "heron", "createdAt": FIRST_MS, "cwd": "/srv/pond"}, {"kind": "entry", "id": "only", "type": "message", "timestamp": LATER_MS, "message": {"role": "user", "content": "is it deep?"}}])
    t = adapters.read(spark, "oh-my-pi", str(tmp_path / "b"))
    assert t["sessions"].first().created_at == "2023-02-03T04:05:06.789Z" and t["parts"].first().text == "is it deep?" and t["sessions"].first().source_agent == "oh-my-pi"


def test_grok(spark, tmp_path):
    folder = tmp_path / "mill" / "night-shift"
    steps = [
        {"sessionUpdate": "plan"}, {"sessionUpdate": "user_message_chunk", "content": {"type": "text", "text": "open the sluice"}},
        {"sessionUpdate": "tool_call", "toolCallId": "call-3", "title": "sluice", "rawInput": {"turns": 4}}, {"sessionUpdate": "tool_call_update", "toolCallId": "call-3", "status": "failed", "rawOutput": {"turns": 0}},
    ]
    put(folder / "updates.jsonl", [{"timestamp": (FIRST_MS + n) // 1000, "params": {"sessionId": "night-shift", "update": u, "_meta": {"agentTimestampMs": FIRST_MS + 500 * n}}} for n, u in enumerate(steps)])
    (folder / "summary.json").write_text(json.dumps({"info": {"id": "night-shift", "cwd": "/srv/mill"}, "created_at": "2023-02-03"}))
    t = adapters.read(spark, "grok-build", str(tmp_path))
    assert (t["sessions"].first().project, t["sessions"].first().created_at) == ("/srv/mill", "2023-02-03")
    assert [r.role for r in t["messages"].orderBy("id").collect()] == ["system", "user", "assistant", "tool"]
    assert shape(t)[-1] == ("tool_result", "injected", "sluice", "call-3")


def test_opencode_tree(spark, tmp_path):
    root = tmp_path / "storage"
    put(root / "session" / "mill" / "dawn.json", [{"id": "dawn", "directory": "/srv/mill", "time": {"created": FIRST_MS}}])
    put(root / "message" / "dawn" / "reply.json", [{"id": "reply", "sessionID": "dawn", "role": "assistant", "time": {"created": LATER_MS}}])
    own = {"sessionID": "dawn", "messageID": "reply"}
    for n, part in enumerate(({"type": "step-start"}, {"type": "tool", "callID": "call-9", "tool": "weigh", "state": {"status": "completed", "input": {"unit": "kg"}, "output": "41"}}, {"type": "text", "text": "forty-one"})):
        put(root / "part" / "reply" / f"bit{n}.json", [{"id": f"bit{n}", **own, **part}])
    t = adapters.read(spark, "opencode", str(tmp_path))
    assert sorted(r.role for r in t["messages"].collect()) == ["assistant", "tool"]
    assert [x[0] for x in shape(t)] == ["text", "tool_call", "tool_result"]


def test_sqlite_stores(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "state.db")
    db.executescript("CREATE TABLE sessions (id text, parent_session_id text, source text, cwd text, started_at text); CREATE TABLE messages (id integer primary key, session_id text, role text, content text, timestamp text, tool_calls text)")
    db.execute("INSERT INTO sessions VALUES ('h', NULL, 'cron', '/w', 'T')")
    db.executemany("INSERT INTO messages (session_id, role, content, timestamp, tool_calls) VALUES (?, ?, ?, ?, ?)", [("h", "user", "ask", "1", None), ("h", "assistant", '\x00json:[{"type":"text","text":"two"}]', "2", '[{"id":"k","function":{"name":"f","arguments":"{}"}}]')])
    db.commit()
    t = adapters.read(spark, "hermes", str(tmp_path))
    assert t["sessions"].first().source_agent == "hermes/cron"
    assert {(r.message_id, r.type, r.text) for r in t["parts"].collect()} == {("h:1", "text", "ask"), ("h:2", "text", "two"), ("h:2", "tool_call", None)}
    db = sqlite3.connect(tmp_path / "devin.db")
    db.executescript("CREATE TABLE sessions (id text, working_directory text, created_at text); CREATE TABLE message_nodes (row_id integer, session_id text, created_at text, chat_message text); INSERT INTO sessions VALUES ('d', '/w', 'T')")
    for n in range(3):
        db.execute("INSERT INTO message_nodes VALUES (?, 'd', 'T', ?)", (n, json.dumps({"message_id": "m1" if n < 2 else "m2", "role": "user", "content": f"c{n}"})))
    db.commit()
    d = adapters.read(spark, "devin", str(tmp_path / "devin.db"))
    assert {(r.message_id, r.text) for r in d["parts"].collect()} == {("m1", "c0"), ("m2", "c2")}
    db = sqlite3.connect(tmp_path / "step.db")
    db.executescript("CREATE TABLE steps (trajectory_id text, idx int, status text, created_at text, step_payload blob); INSERT INTO steps VALUES ('t', 0, 'DONE', 'T', x'00ff')")
    db.commit()
    assert adapters.read(spark, "agy", str(tmp_path / "step.db"))["messages"].first().id == "t:0:DONE"


def test_restore_round_trip(spark, tmp_path):
    d = tmp_path / "in" / "-w"
    put(d / "S.jsonl", [{"type": "user", "uuid": "u1", "sessionId": "S", "timestamp": "2025-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}]}}, {"type": "summary", "uuid": "u2", "sessionId": "S", "timestamp": "2025-01-01T00:00:01Z"}])
    t = adapters.read(spark, "claude-code", str(tmp_path / "in"))
    lines = restore.claude_code_lines(t["sessions"], t["messages"], t["parts"])
    assert len(restore.write_files(lines, str(tmp_path / "out"))) == 1
    with pytest.raises(FileExistsError):
        restore.write_files(lines, str(tmp_path / "out"))
    again = adapters.read(spark, "claude-code", str(tmp_path / "out"))
    for name in ("messages", "parts"):
        key = lambda df: sorted((r.id, *(getattr(r, c) for c in ("role", "text", "type") if c in df.columns)) for r in df.collect())
        assert key(again[name]) == key(t[name])
    assert restore.fidelity("claude-code/x", "claude-code") == "native" and restore.fidelity("devin", "claude-code") == "foreign"
