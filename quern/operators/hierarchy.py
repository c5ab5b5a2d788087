"""Parent-child links of unknown depth to full hierarchies, by pointer doubling.

Every round joins the ancestor pointers to themselves, which doubles the distance they
span, so a forest of depth d is done after log2(d) + 1 rounds. What no round can close any
more runs in a circle; the rounds go on until every pointer stands on its circle and has
seen all of it, which takes the logarithm of the longest circle or way into one.

Only inner nodes (ids that are somebody's parent) take part in the rounds; leaves, mostly
the great majority, are attached once at the end. Rows that reached their root leave the
rounds and are written once, so a root with a third of all rows below it is never joined again.
A join can meet a node with a huge number of pointers to it, in a round or where leaves are
attached: nodes holding more than 1/HOT of them (there are fewer than HOT) are joined by broadcast.

Defined results
* An id may occur in several rows. Its parent is the smallest parent named in any of them;
  NULL, '' and blank parents name none, rows with a NULL id are left out.
* A parent that is not among the ids ends the lineage below it: its child is a root.
* Circles, and whatever leads into one: ``depth`` -1, ``root`` the smallest id on the circle,
  ``path`` NULL. Their ancestors up to one turn of the circle are kept in ``around``, each once; no
  node is its own ancestor.
* Ids may hold any character, also the separator of the written path: pairs are read off arrays of ids.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blank
from quern.operators import skew
from quern.session import cut

SEPARATOR = " > "


def links(rows: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, parent) once per id; parent NULL where no row of the id names one."""
    named = F.when(~blank(parent), F.col(parent))
    return rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(named).alias("parent"))


def _hot(children: DataFrame, key: str) -> tuple[int, int, DataFrame | None]:
    return skew.hot_keys(children.groupBy(key).count(), [key])


def _join_on(children: DataFrame, parents: DataFrame, key: str, few: DataFrame | None, how: str = "left") -> DataFrame:
    return skew.join_on(children, parents, [key], few, how)


def _join_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    return _join_on(children, parents, "parent", _hot(children, "parent")[2])


_ARRAY = "array<string>"


def resolve(rows: DataFrame, node: str = "id", parent: str = "parent_id", paths: bool = False) -> DataFrame:
    """One row per id: (id, parent, root, depth bigint, is_cycle[, path, steps, around]).

    ``parent`` is NULL for roots (also where the named parent is absent). ``steps`` are the ids from the
    root to the row's own and ``path`` the same as text; both NULL where the lineage never ends. ``around`` are
    the ids of such a lineage, NULL where it ends.
    """
    named = cut(links(rows, node, parent), "links")
    ids = named.select(F.col("id").alias("parent"))
    # Edges whose parent exists; a self-loop is a circle of one.
    edges = cut(_join_parent(named.where("parent is not null"), ids.withColumn("there", F.lit(True))).where("there").select("id", "parent"), "edges")
    roots = named.join(edges, "id", "left_anti").select("id")
    inner_ids = edges.select(F.col("parent").alias("id")).distinct()
    none = F.lit(None).cast(_ARRAY)
    own = F.array("id") if paths else none
    # Per inner node: the ancestor reached so far, the steps to it, whether it is a root, the smallest id met on
    # the way (excluding the ancestor itself), which names the circle, and the ids from below the ancestor down.
    inner_edges = edges.join(inner_ids, "id", "left_semi")
    open_ = cut(inner_edges.select("id", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("steps"), F.col("id").alias("least"), F.lit(False).alias("lower"), own.alias("trail"), F.lit(False).alias("done")), "open")
    tops = inner_ids.join(edges, "id", "left_anti").select("id", F.col("id").alias("anc"), F.lit(0).cast("bigint").alias("steps"), F.col("id").alias("least"), F.lit(False).alias("lower"), (F.array().cast(_ARRAY) if paths else none).alias("trail"), F.lit(True).alias("done"))
    # Resolved rows stay in the tables of the round that resolved them; nothing rewrites them.
    done = [cut(tops, "done")]
    left, met, few = _hot(open_, "anc")
    for _ in range(math.ceil(math.log2(left + 1)) + 1 if left else 0):
        right = functools.reduce(DataFrame.unionByName, done, open_).select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"), F.col("least").alias("least2"), F.col("trail").alias("trail2"))
        moved = cut(
            _join_on(open_, right, "anc", few, "inner").select(
                "id", F.col("anc2").alias("anc"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("lower"),
                (F.concat("trail2", "trail") if paths else none).alias("trail"), F.col("done2").alias("done"),
            ), "moved", by="done",
        )
        done.append(moved.where("done"))
        open_ = moved.where("not done")
        now, heads, few = _hot(open_, "anc")
        if now == 0:
            break
        # None closed: all open pointers led to open nodes, so none ever will. As many ancestors as before: the
        # pointers only turn on their circles. No id became lower: each has seen the whole circle.
        if now == left and heads == met and open_.where("lower").isEmpty():
            break
        left, met = now, heads
    # A node leading into a circle has an ancestor on it; the ancestor's least id is that of the whole circle.
    circle = open_.select(F.col("id").alias("anc"), F.col("least").alias("circle"))
    # Its trail spans the way to the circle and a whole turn: the nearest of each id counts.
    around = F.reverse(F.array_distinct(F.reverse("trail"))) if paths else none
    stuck = _join_on(open_, circle, "anc", few).select("id", F.col("circle").alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("steps"), around.alias("around"))
    way = F.concat(F.array("anc"), "trail") if paths else none
    ended = functools.reduce(DataFrame.unionByName, done).select("id", F.col("anc").alias("root"), F.col("steps").alias("depth"), way.alias("steps"), none.alias("around"))
    inner = cut(ended.unionByName(stuck), "inner")
    # Leaves hang below inner nodes; inner nodes keep what the rounds found.
    leaf_edges = edges.join(inner_ids, "id", "left_anti")
    above = inner.withColumnRenamed("id", "parent")
    below = lambda c: F.concat(c, F.array("id")) if paths else none
    leaves = _join_parent(leaf_edges, above).select("id", "parent", "root", F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + 1).cast("bigint").alias("depth"), below("steps").alias("steps"), below("around").alias("around"))
    lonely = roots.join(inner_ids, "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), own.alias("steps"), none.alias("around"))
    middle = inner.join(inner_edges, "id", "left").select("id", "parent", "root", "depth", "steps", "around")
    out = leaves.unionByName(lonely).unionByName(middle).withColumn("is_cycle", F.col("depth") < 0)
    return out.withColumn("path", F.array_join("steps", SEPARATOR)) if paths else out.drop("steps", "around")


def lineage(sessions: DataFrame) -> DataFrame:
    """(session_id, root_session_id, depth) of every session id that names a parent in at least one row."""
    named = sessions.where(F.col("id").isNotNull() & ~blank("parent_session_id")).select("id").distinct()
    return resolve(sessions, "id", "parent_session_id").join(named, "id", "left_semi").select(F.col("id").alias("session_id"), F.col("root").alias("root_session_id"), "depth")


def _pairs(resolved: DataFrame, steps: str) -> DataFrame:
    at = resolved.where(F.col(steps).isNotNull() & (F.col("depth") != 0)).select("id", F.col(steps).alias("steps"))
    return at.select(F.col("id").alias("descendant"), F.posexplode("steps").alias("at", "ancestor"), (F.size("steps") - 1).alias("last")).where("at < last").select("ancestor", "descendant", (F.col("last") - F.col("at")).cast("bigint").alias("distance"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on one path, from ``resolve(paths=True)`` rows.

    The closure is read off each node's path, so its size is the sum of the depths and no
    join over a whole tree is needed. Lineages that never end have no path and no rows here:
    theirs are in ``circle_descendants``, and both together are the whole closure.
    """
    return _pairs(resolved, "steps")


def circle_descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair of a lineage that never ends, on the circle or below it.

    Each ancestor counts once, at its smallest distance, within one turn of the circle.
    """
    return _pairs(resolved, "around")


def cut_points(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """State of every session's cut point: ``none``, ``no_parent``, ``parent_absent``, ``message_absent`` or ``ok``."""
    from quern.functions.text import id_key

    s = sessions.where("id is not null").select("id", F.when(~blank("parent_session_id"), F.col("parent_session_id")).alias("parent"), F.when(~blank("parent_message_id"), id_key("parent_message_id")).alias("at")).distinct()
    there = sessions.where("id is not null").select(F.col("id").alias("parent")).distinct().withColumn("has_parent", F.lit(True))
    keys = messages.select(F.col("session_id").alias("parent"), id_key("id").alias("at")).where("parent is not null and at is not null").distinct().withColumn("has_message", F.lit(True))
    j = s.join(there, "parent", "left").join(keys, ["parent", "at"], "left")
    state = F.when(F.col("at").isNull(), "none").when(F.col("parent").isNull(), "no_parent").when(F.col("has_parent").isNull(), "parent_absent").when(F.col("has_message").isNull(), "message_absent").otherwise("ok")
    return j.select(F.col("id").alias("session_id"), F.col("at").alias("cut_point"), state.alias("state"))
