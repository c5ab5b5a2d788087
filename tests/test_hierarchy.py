import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.operators import hierarchy, skew

SCHEMA = "id string, parent_session_id string, extra int"


def brute(rows):
    parent = {}
    for i, p, *_ in rows:
        if i is None:
            continue
        named = p if p is not None and p.strip() else None
        old = parent.setdefault(i, None)
        parent[i] = named if old is None else old if named is None else min(old, named)
    out = {}
    for i, own in parent.items():
        if own is None:
            continue
        seen, at = [i], i
        while True:
            p = parent[at]
            if p is None or p not in parent:
                out[i] = (at, len(seen) - 1)
                break
            if p in seen:
                out[i] = (min(seen[seen.index(p) :]), -1)
                break
            seen.append(p)
            at = p
    return out


def lineage(spark, rows):
    return {r[0]: (r[1], r[2]) for r in hierarchy.lineage(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_chain_circle_absent_and_copies(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("c", None, 2), ("d", "gone", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("w", "x", 1), ("s", "s", 1), ("e", "", 1), ("f", "  ", 1), (None, "a", 1), ("b", "a", 1)]
    assert lineage(spark, rows) == brute(rows)


def test_long_chain_and_star(spark):
    rows = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None, 0) for i in range(60)] + [(f"leaf{i}", "n010", 0) for i in range(300)]
    random.Random(1).shuffle(rows)
    assert lineage(spark, rows) == brute(rows)


def test_empty(spark):
    assert lineage(spark, []) == {}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from([None, "", *"abcdefghij"]), st.just(0)), max_size=14))
def test_random_forests(spark, rows):
    assert lineage(spark, rows) == brute(rows)


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("d", "a", 0), ("x", "x", 0)], SCHEMA)
    full = hierarchy.resolve(df, "id", "parent_session_id", paths=True)
    assert {r.id: r.path for r in full.collect()} == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > d", "x": None}
    assert sorted(tuple(r) for r in hierarchy.descendants(full).collect()) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def test_hot_parent_is_split_off(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 50)
    rows = [("r", None, 0), ("x", "r", 0), *[(f"leaf{i}", "x", 0) for i in range(200)], ("deep", "leaf7", 0)]
    assert lineage(spark, rows) == brute(rows)


def ring(name, n, shift=0):
    return [(f"{name}{(i + shift) % n:02d}", f"{name}{(i + shift + 1) % n:02d}", 0) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [("a", "b", 0), ("b", "c", 0), ("c", "a", 0)],
    [("a", "c", 0), ("b", "a", 0), ("c", "b", 0)],
    [*ring("c", 12), ("r", None, 0), ("s", "r", 0), ("t", "s", 0)],
    [*ring("z", 3), *[(f"t{i:02d}", f"t{i + 1:02d}" if i < 20 else "z00", 0) for i in range(21)]],
    [*ring("k", 7), *ring("m", 16), *ring("p", 1), ("x", "k03", 0), ("y", "x", 0), ("a", "m15", 0), ("b", "a", 0), ("c", "b", 0)],
])
def test_circles_have_one_root(spark, rows):
    assert lineage(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", (4, 7, 9))
def test_bare_circles(spark, n):
    shuffled = random.Random(n).sample("abcdefghi"[:n], n)
    circle = [(x, shuffled[(i + 1) % n], 0) for i, x in enumerate(shuffled)]
    assert lineage(spark, circle) == brute(circle)


def test_ids_that_hold_the_separator(spark):
    rows = [("a > b", None, 0), ("c", "a > b", 0), ("a", None, 0), ("x > y", "x > y", 0), ("z", "x > y", 0)]
    full = hierarchy.resolve(spark.createDataFrame(rows, SCHEMA), "id", "parent_session_id", paths=True)
    assert [tuple(r) for r in hierarchy.descendants(full).collect()] == [("a > b", "c", 1)]
    assert [tuple(r) for r in hierarchy.circle_descendants(full).collect()] == [("x > y", "z", 1)]


def test_hot_hub_below_the_root(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 50)
    rows = [("r", None, 0), ("hub", "r", 0), *[(f"m{i:03d}", "hub", 0) for i in range(150)], *[(f"l{i:03d}", f"m{i:03d}", 0) for i in range(150)]]
    assert lineage(spark, rows) == brute(rows)


def test_descendants_of_circles_and_of_what_hangs_below(spark):
    rows = [*ring("c", 5), ("x", "c03", 0), ("y", "x", 0), ("leaf", "y", 0), ("s", "s", 0), ("u", "s", 0), ("r", None, 0), ("v", "r", 0)]
    full = hierarchy.resolve(spark.createDataFrame(rows, SCHEMA), "id", "parent_session_id", paths=True)
    got = [tuple(r) for r in hierarchy.circle_descendants(full).collect()]
    parent, wanted = {i: p for i, p, _ in rows}, set()
    for i in set(parent) - {"r", "v"}:
        seen, at = [i], parent[i]
        while at not in seen:
            seen.append(at)
            wanted.add((at, i, len(seen) - 1))
            at = parent[at]
    assert len(got) == len(set(got)) and set(got) == wanted and ("c02", "leaf", 7) in wanted
    assert [tuple(r) for r in hierarchy.descendants(full).collect()] == [("r", "v", 1)]
