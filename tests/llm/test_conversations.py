from datetime import datetime

from quern.llm import conversations as conv

M = "delivery_id bigint, batch_id string, delivered_at timestamp, session_id string, id string, timestamp string, role string, content string, hostname string, extra int"
P = "session_id string, message_id string, id string, ordinal int, type string, provenance string, call_id string, text string, params string, result string, file_name string, extra int"
HOSTS = [("h", "UTC", "ymd")]


class World:
    def __init__(self, spark):
        self.spark, self.m, self.p, self.ids = spark, [], [], []

    def say(self, session, key, role, at, batch="b1", text="hello", n=0):
        self.m.append((len(self.m), batch, datetime(2024, 1, 1, 0, 0, len(self.m)), session, key, at, role, None, "h", 0))
        if text is not None:
            self.part(session, key, 0, text)

    def part(self, session, key, ordinal, text, kind="text", provenance="conversational", call=None):
        self.p.append((session, key, f"{key.strip().lower()}:{ordinal}:{kind}", ordinal, kind, provenance, call, text, None, None, None, 0))

    def frames(self):
        f = self.spark.createDataFrame
        ids = self.ids or sorted({x[3] for x in self.m})
        return f(self.m, M), f(self.p, P), f([(i, None) for i in ids], "id string, x string"), f(HOSTS, "hostname string, zone_name string, date_order string")

    def reasons(self):
        return {r.session_id: r.reason for r in conv.dropped(*self.frames()).collect()}


def t(n):
    return f"2024-05-01T10:00:{n:02d}Z"


def test_reasons(spark):
    w = World(spark)
    for s in ("good", "twice", "late", "gap", "dup", "nopart", "orphan", "call", "time", "first", "blank", "called"):
        w.say(s, "M1", "Human ", t(1), text="  " if s == "blank" else "q") if s != "first" else w.say(s, "m1", "ai", t(1))
        if s not in ("late", "blank"):
            w.say(s, "m2", "model", "nonsense" if s == "time" else t(2), text=None if s == "nopart" else "a")
    w.say("twice", "m0", "user", t(0))
    w.say("good", " m1", "user", t(1), batch="b2", text="q")
    w.part("good", "m1 ", 0, "q")
    w.part("gap", "m2", 2, "x")
    w.part("dup", "m2", 0, "other", kind="reasoning")
    w.part("orphan", "m77", 0, "x")
    w.part("call", "m2", 1, None, kind="tool_result", call="nowhere")
    w.part("called", "m2", 1, None, kind="tool_call", call="k")
    w.part("called", "m2", 2, None, kind="tool_result", call="k")
    w.ids = [*sorted({x[3] for x in w.m} - {"late"}), "listed only"]
    assert w.reasons() == {"twice": "no_reply", "late": "no_reply", "gap": "broken", "dup": "broken", "nopart": "broken", "orphan": "broken", "call": "broken", "time": "broken", "first": "broken", "blank": "empty", "listed only": "empty"}
    whole = [(r.session_id, r.message_key, r.role, r.text) for r in conv.rebuilt(*w.frames()).collect()]
    assert [x for x in whole if x[0] == "good"] == [("good", "m1", "user", "q"), ("good", "m2", "assistant", "a")]


def test_empty_tables(spark):
    w = World(spark)
    w.ids = ["x"]
    assert w.reasons() == {"x": "empty"}


def test_turns_across_hours(spark):
    w = World(spark)
    for h in range(6):
        w.say("s", f"m{h}", "user" if h % 2 == 0 else "assistant", f"2024-05-01T{h:02d}:00:00Z")
        w.say("r", f"m{h}", "user" if h in (0, 3, 4) else "assistant", f"2024-05-01T{h:02d}:00:00Z")
    assert w.reasons() == {"r": "no_reply"}


def graph(spark, batches):
    w = World(spark)
    for batch, keys in batches.items():
        for k in keys:
            w.say(batch[0], f"m{k:02d}", "user", t(k), batch=batch)
    m, _, _, hosts = w.frames()
    d = conv.timed(m, hosts)
    return {r.batch_id: (r.contig, r.follows, r.shared, r.kind) for r in conv.contigs(d, conv.survivors(d)).collect()}


def test_fragments_overlap_and_merge(spark):
    """Each letter is a session: a chain, nested, a fork, a hole, equal fragments, overlapping copies of one message."""
    got = graph(spark, {
        "a1": (1, 2, 3), "a2": (3, 4, 5), "a3": (4,), "a9": (8, 9),
        "b1": (1, 2, 3), "b2": (2, 3, 4), "b3": (3, 4, 5), "b4": (5, 6),
        "c1": (1, 2, 3), "c2": (3, 4), "c3": (3, 5),
        "d1": (1, 2, 4, 5), "d2": (4, 3, 5), "d3": (1, 5),
        "e1": (1, 2), "e2": (1, 2), "e3": (2, 1, 3),
        "f1": (1, 2, 3, 4, 5, 6), "f2": (2, 3, 4), "f3": (3,), "f4": (5, 6, 7), "f5": (6, 7),
    })
    assert {k: v for k, v in got.items() if k[0] == "a"} == {"a1": ("a1", None, None, "alone"), "a2": ("a1", "a1", 1, "suffix_prefix"), "a3": ("a1", "a2", 1, "inside"), "a9": ("a9", None, None, "alone")}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {"b1": ("b1", None, None, "alone"), "b2": ("b1", "b1", 2, "suffix_prefix"), "b3": ("b1", "b2", 2, "suffix_prefix"), "b4": ("b1", "b3", 1, "suffix_prefix")}
    assert got["c2"] == ("c2", "c1", 1, "fork") and got["c3"] == ("c3", "c1", 1, "fork")
    assert got["d2"][3] == "tangled" and got["d3"][3] == "tangled" and got["d2"][0] == "d2"
    assert got["e3"] == ("e3", None, None, "alone") and got["e1"] == ("e3", "e3", 2, "inside") and got["e2"] == ("e3", "e3", 2, "inside")
    assert got["f2"] == ("f1", "f1", 3, "inside") and got["f3"][3] == "inside" and got["f4"] == ("f1", "f1", 2, "suffix_prefix") and got["f5"] == ("f1", "f4", 2, "inside")


def test_what_is_in_no_contig_is_a_gap(spark, monkeypatch):
    w = World(spark)
    for s in ("s", "z"):
        w.say(s, "m1", "user", t(1), batch="b1")
        w.say(s, "m2", "assistant", t(2), batch="b1")
        w.say(s, "m2", "assistant", t(2), batch="b2")
        w.say(s, "m3", "user", t(3), batch="b2")
        w.say(s, "m4", "assistant", t(4), batch="b2")
    w.p = sorted(set(w.p))
    assert w.reasons() == {}
    whole = conv.contigs
    monkeypatch.setattr(conv, "contigs", lambda d, k: whole(d, k).where("session_id <> 'z' or batch_id <> 'b2'"))
    assert w.reasons() == {"z": "broken"}


def test_untimed_and_unbatched_messages(spark):
    w = World(spark)
    w.say("s", "m1", "user", "nonsense", batch=None)
    w.say("s", "m2", "assistant", t(2), batch=None)
    w.say("r", "m1", "user", t(1), batch=None)
    w.say("r", "m2", "assistant", t(2), batch="b1")
    assert w.reasons() == {"s": "broken"}
