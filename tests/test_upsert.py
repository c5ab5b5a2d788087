from datetime import datetime

from quern.operators import upsert

SCHEMA = "delivery_id bigint, delivered_at timestamp, session_id string, id string, role string, batch_id string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def t(n):
    return datetime(2024, 1, 1, 0, 0, n)


DATA = [(1, t(5), "s", "A ", "u", ""), (2, t(3), "s", "a", "v", ""), (3, t(3), "s", "\ta\n", "w", ""), (4, t(1), "z", "a", "x", ""), (5, None, "s", "b", "y", ""), (6, t(9), "s", "B", "z", ""), (7, t(1), None, "a", "q", ""), (8, t(1), "s", None, "q", "")]


def test_surplus_and_survivors(spark):
    df = rows(spark, DATA)
    assert {r[0] for r in upsert.surplus(df).collect()} == {1, 3, 5}
    assert {r.delivery_id for r in upsert.deduplicate(df).collect()} == {2, 4, 6}


def test_empty(spark):
    assert upsert.surplus(rows(spark, [])).count() == 0
    assert upsert.deduplicate(rows(spark, [])).count() == 0


def test_upserts_commute_and_repeat(spark):
    a, b = rows(spark, DATA[:3]), rows(spark, DATA[3:])
    one = upsert.KeyedStore(spark, buckets=3, payload=["role"]).upsert(a).upsert(b).upsert(a)
    two = upsert.KeyedStore(spark, buckets=3, payload=["role"]).upsert(b).upsert(a).compact()
    keep = lambda s: sorted((r.session_id, r.message_key, r.best.delivery_id, r.role) for r in s.read().collect())
    assert keep(one) == keep(two) == [("s", "a", 2, "v"), ("s", "b", 6, "z"), ("z", "a", 4, "x")]
    one.compact()
    assert keep(one) == keep(two)
    assert upsert.surplus(rows(spark, DATA), one).count() == 3


def test_merging_runs_needs_no_exchange_and_no_sort(spark):
    s = upsert.KeyedStore(spark, buckets=4).upsert(rows(spark, DATA[:3])).upsert(rows(spark, DATA[3:]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = s.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan


def test_a_store_is_reopened_by_its_path(spark, tmp_path):
    one = upsert.KeyedStore(spark, str(tmp_path / "s"), buckets=3, payload=["role"]).upsert(rows(spark, DATA[:3]))
    two = upsert.KeyedStore(spark.newSession(), str(tmp_path / "s"))
    assert two.runs == 1 and {r.role for r in two.read().collect()} == {"v"}
    two.upsert(rows(two.spark, DATA[2:])).compact()
    assert one.runs == 1 and {r.best.delivery_id for r in one.read().collect()} == {2, 4, 6}
    one.upsert(rows(spark, DATA)).compact()
    assert {r.best.delivery_id for r in two.read().collect()} == {2, 4, 6}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_")]


def test_survivors_with_their_columns(spark):
    got = {(r.session_id, r.message_key, r.delivery_id, r.role) for r in upsert.survivors(rows(spark, DATA), ["role"]).collect()}
    assert got == {("s", "a", 2, "v"), ("s", "b", 6, "z"), ("z", "a", 4, "x")}


def test_one_message_delivered_very_often(spark):
    df = spark.range(5000).selectExpr("id AS delivery_id", "timestamp_seconds(id) AS delivered_at", "'s' AS session_id", "'m' AS id", "'u' AS role", "'' AS batch_id")
    assert upsert.surplus(df).count() == 4999
