import json
from datetime import datetime

from quern.operators import schema_drift as drift


def tables(spark, files):
    """files: list of (file_id, stream, [option texts])."""
    sf = spark.createDataFrame([(f, s, datetime(2024, 1, 1 + i)) for i, (f, s, _) in enumerate(files)], "file_id bigint, stream_id string, written_at timestamp")
    records = spark.createDataFrame([("session", f, o) for f, _, texts in files for o in texts], "record_kind string, file_id bigint, options string")
    return records, sf


def found(spark, files):
    return {tuple(r)[1:] for r in drift.changes(*tables(spark, files)).collect()}


def j(**x):
    return json.dumps(x)


def test_added_removed_retyped_renamed(spark):
    files = [
        (1, "s", [j(model="tern-2", n=4, flag=True, gone=None), j(model="orchid", n=7, deep={"x": 1})]),
        (2, "s", [j(client={"model": "tern-2"}, n="4", flag=True), j(client={"model": "orchid"}, deep={"x": 2.5}), "{broken", "[1]"]),
        (3, "s", [j(client={"model": "tern-2"}, deep={"x": 1}, tags=["a"])]),
        (9, "other", [j(model="tern-2")]),
    ]
    assert found(spark, files) == {
        (2, "session", "renamed", "model", "client.model"),
        (2, "session", "retyped", "n", "n"),
        (3, "session", "removed", "n", ""),
        (3, "session", "removed", "flag", ""),
        (3, "session", "added", "", "tags"),
    }


def test_other_sort_of_values_is_no_rename(spark):
    files = [(1, "s", [j(model="tern-2"), j(model="orchid")]), (2, "s", [j(city="Port"), j(city="Hill")])]
    assert found(spark, files) == {(2, "session", "removed", "model", ""), (2, "session", "added", "", "city")}


def test_fields_seen_side_by_side_are_no_rename(spark):
    files = [(1, "s", [j(a=True)]), (2, "s", [j(b=True)]), (3, "t", [j(a=True, b=False)]), (4, "u", [j(a=False, b=False)])]
    assert found(spark, files) == {(2, "session", "removed", "a", ""), (2, "session", "added", "", "b")}


def test_null_empty_and_unreadable(spark):
    assert found(spark, []) == set()
    files = [(1, "s", [None, "", "nonsense", "{}"]), (2, "s", [j(a=1)]), (3, "s", [None])]
    assert found(spark, files) == {(2, "session", "added", "", "a"), (3, "session", "removed", "a", "")}


def test_unified_table_has_one_name_and_one_type_a_field(spark):
    files = [
        (1, "s", [j(model="tern-2", n=4, on=True)]), (2, "s", [j(client={"model": "orchid"}, n="4", on=False)]), (3, "s", [j(client={"kind": "tern-2"}, n=5.5, tags=["a", 1])]),
        (7, "other", [j(model="wren", n=1)]), (8, None, [j(model="lost")]),
    ]
    records, sf = tables(spark, files)
    renames = spark.createDataFrame([("s", "session", 2, "model", "client.model"), ("s", "session", 3, "client.model", "client.kind")], "stream_id string, record_kind string, file_id bigint, old_path string, new_path string")
    rows = records.selectExpr("record_kind", "file_id", "cast(file_id as string) as record_id", "options")
    got = {(r.stream_id, r.file_id, r.field): (r.type, r.text_value, r.number_value, r.boolean_value) for r in drift.unify(rows, renames, sf).collect()}
    assert got == {
        ("s", 1, "client.kind"): ("string", "tern-2", None, None), ("s", 2, "client.kind"): ("string", "orchid", None, None), ("s", 3, "client.kind"): ("string", "tern-2", None, None),
        ("s", 1, "n"): ("string", "4", None, None), ("s", 2, "n"): ("string", "4", None, None), ("s", 3, "n"): ("string", "5.5", None, None),
        ("s", 1, "on"): ("boolean", None, None, True), ("s", 2, "on"): ("boolean", None, None, False), ("s", 3, "tags"): ("array", '["a", 1]', None, None),
        ("other", 7, "model"): ("string", "wren", None, None), ("other", 7, "n"): ("number", None, 1.0, None),
    }


def test_records_of_any_depth():
    for depth, text in ((3, '{"a": {"b": {"c": [1, {"d": "x"}], "e": "y"}}}'), (200_000, '{"a":' * 200_000 + "[" * 200_000 + "]" * 200_000 + "}" * 200_000)):
        if depth == 3:
            assert drift._deep_loads(text) == json.loads(text)
        record = drift._loads(text)
        assert isinstance(record, dict)
        inner = record
        while isinstance(inner, dict) and "a" in inner:
            inner = inner["a"]
        assert json.loads(drift._dumps(inner)) == inner if depth == 3 else drift._dumps(inner) == "[" * 200_000 + "]" * 200_000
    for broken in ("", "[1,", '{"a" 1}', '{"a":1} 2', "nope", "[" * 200_000):
        assert drift._loads(broken) is None


def test_flooding_prefers_structure():
    f = lambda p, t, vals: {"path": p, "type": t, "n": 5, "vals": vals, "forms": [], "bins": [], "fractional": 0, "truthy": 0}
    before = [f("usage.in", "number", [1, 2]), f("usage.out", "number", [1, 2])]
    after = [f("tokens.in", "number", [1, 2]), f("tokens.out", "number", [1, 2])]
    scores = drift.flood(before, after)
    assert scores["usage.in", "tokens.in"] > scores["usage.in", "tokens.out"]
