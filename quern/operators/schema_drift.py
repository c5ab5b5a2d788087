"""JSON records whose fields drift from file to file: one table and a list of changes.

1. ``profile`` reads every record once and keeps, per (kind, file, path, type), a count and
   bounded sketches of the values. Partial profiles are made per task, so what is shuffled is
   schema, not data, and a file with a third of all rows costs one partial row per task.
2. ``changes`` compares each file of a stream with the one before it.
3. Renames are found by similarity flooding. Each file's schema is a graph of objects, fields
   and types; pairs of nodes start with a similarity of names and values, and scores are
   propagated along equally labelled edges until they settle. Of the settled scores a
   consistent one-to-one choice is made among pairs of one type whose values are of the same
   sort. Two fields that live side by side in files of the corpus are different fields and
   cannot be a rename of each other.
4. ``unify`` casts and unions all versions into one table under each stream's latest names, with one type a field.

Defined results
* A path is the dotted way to a value that is not an object; arrays are values; null counts
  as absent; unreadable JSON, NULL and documents that are no object have no paths.
* A file with rows but no readable paths still counts as a file of its stream.
* A path that occurs with several types in a file has the most frequent (ties: by name).
* Files without an entry in ``source_files`` belong to no stream and are left out.
* Keys that contain a dot are kept as they are, so they look like a nested path.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import hierarchy
from quern.session import cut

#: Size of the value sketches (the smallest hashes of distinct values) and when a task passes its partial profiles on.
SKETCH, FLUSH = 32, 200_000
#: Least agreement of values, and largest share of files with both fields, for a rename.
SAME_SORT, SIDE_BY_SIDE = 0.45, 0.02

_PROFILE = "record_kind string, file_id bigint, path string, type string, n bigint, vals array<bigint>, forms array<bigint>, bins array<bigint>, fractional bigint, truthy bigint"
_ARROW = pa.schema([("record_kind", pa.string()), ("file_id", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("vals", pa.list_(pa.int64())), ("forms", pa.list_(pa.int64())), ("bins", pa.list_(pa.int64())), ("fractional", pa.int64()), ("truthy", pa.int64())])
_HEX = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{6,}")
_WORDS = re.compile(r"[\s,;|]+")
_RUN = re.compile(r"[A-Za-z]+|\d+")


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_NAMED = {"true": True, "false": False, "null": None}


def _deep_loads(text: str) -> object:
    """JSON of any depth, without recursion."""
    at, stack, keys = 0, [], []
    skip = lambda i: _BLANK.match(text, i).end()

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("a member needs a name")
        name, i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a member needs a value")
        keys.append(name)
        return skip(i + 1)

    at = skip(at)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append(value)
                at = key(at) if c == "{" else at
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        elif m := _NUMBER.match(text, at):
            value, at = (float(m[0]) if set(m[0]) & set(".eE") else int(m[0])), m.end()
        else:
            word = next((w for w in _NAMED if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"nothing readable at {at}")
            value, at = _NAMED[word], at + len(word)
        while True:
            at = skip(at)
            if not stack:
                if at < len(text):
                    raise ValueError("more than one value")
                return value
            top = stack[-1]
            if isinstance(top, dict):
                top[keys.pop()] = value
            else:
                top.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                at = key(at) if isinstance(top, dict) else at
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise ValueError(f"neither more nor the end at {at}")
            at += 1
            value = stack.pop()


def _loads(text: str | None) -> object:
    """The value of a JSON text; None where it is unreadable."""
    try:
        return json.loads(text) if text else None
    except RecursionError:
        try:
            return _deep_loads(text or "")
        except ValueError:
            return None
    except ValueError:
        return None


def _dumps(value: object) -> str:
    """JSON text of a value of any depth, names in order."""
    try:
        return json.dumps(value, sort_keys=True)
    except RecursionError:
        out, todo = [], [value]
        while todo:
            x = todo.pop()
            if isinstance(x, _Mark):
                out.append(x)
            elif isinstance(x, dict | list) and x:
                items = sorted(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
                inner: list[object] = []
                for i, (k, v) in enumerate(items):
                    inner += [_Mark((", " if i else "") + (f"{json.dumps(k)}: " if k is not None else "")), v]
                ends = ("{", "}") if isinstance(x, dict) else ("[", "]")
                todo += reversed([_Mark(ends[0]), *inner, _Mark(ends[1])])
            else:
                out.append(json.dumps(x))
        return "".join(out)


class _Mark(str):
    """Punctuation of JSON text, as against a string in it."""


def _leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                yield path, v


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _form(text: str) -> str:
    """Shape of a value, '' where it is a mere word: ``rq_1f2e3d4c`` -> ``rq_#``, ``2.10.4`` -> ``9.9.9``."""
    out = _HEX.sub("#", text)
    out = _RUN.sub(lambda m: "9" if m[0].isdigit() else m[0] if len(m[0]) < 4 else "a", out)
    return out if any(c in out for c in "#9") else ""


class _Part:
    """Partial profile of one (kind, file, path, type)."""

    __slots__ = ("bins", "forms", "fractional", "n", "truthy", "vals")

    def __init__(self) -> None:
        self.n = self.fractional = self.truthy = 0
        self.vals: set[int] = set()
        self.forms: set[int] = set()
        self.bins: dict[int, int] = defaultdict(int)

    def _keep(self, kept: set[int], value: int) -> None:
        kept.add(value)
        if len(kept) > 4 * SKETCH:
            kept.intersection_update(sorted(kept)[:SKETCH])

    def add(self, value: object, kind: str) -> None:
        self.n += 1
        if kind == "string":
            for word in _WORDS.split(value):
                self._keep(self.vals, _hash(word))
            if form := _form(value):
                self._keep(self.forms, _hash(form))
        elif kind == "number":
            self._keep(self.vals, _hash(repr(value)))
            self.fractional += value != int(value) if math.isfinite(value) else 0
            self.bins[round(4 * math.log10(abs(value))) if value and math.isfinite(value) else -400] += 1
        elif kind == "array":
            for x in value:
                self._keep(self.vals, _hash(x if isinstance(x, str) else _dumps(x)))
        else:
            self.truthy += bool(value)


def _type(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array"


def _profile_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[tuple, _Part] = defaultdict(_Part)

    def out() -> pa.RecordBatch:
        rows = [
            {"record_kind": k, "file_id": f, "path": p, "type": t, "n": x.n, "vals": sorted(x.vals)[:SKETCH], "forms": sorted(x.forms)[:SKETCH], "bins": [b for pair in x.bins.items() for b in pair], "fractional": x.fractional, "truthy": x.truthy}
            for (k, f, p, t), x in parts.items()
        ]
        parts.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    for batch in batches:
        kinds, files, texts = (batch.column(i).to_pylist() for i in range(3))
        for kind, file, text in zip(kinds, files, texts, strict=True):
            parts[kind, file, None, None].n += 1
            record = _loads(text)
            if isinstance(record, dict):
                for path, value in _leaves(record):
                    t = _type(value)
                    parts[kind, file, path, t].add(value, t)
        if len(parts) > FLUSH:
            yield out()
    yield out()


def profile(records: DataFrame) -> DataFrame:
    """Profiles of (record_kind, file_id, options) rows; one row with NULL path per file counts its records."""
    parts = records.where("file_id is not null").select("record_kind", "file_id", "options").mapInArrow(_profile_task, _PROFILE)
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, SKETCH).alias(c)
    return parts.groupBy("record_kind", "file_id", "path", "type").agg(F.sum("n").alias("n"), least("vals"), least("forms"), F.flatten(F.collect_list("bins")).alias("bins"), F.sum("fractional").alias("fractional"), F.sum("truthy").alias("truthy"))


def records(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.select(F.lit("session").alias("record_kind"), "file_id", "options").unionByName(messages.select(F.lit("message").alias("record_kind"), "file_id", "options"))


def fields(profiles: DataFrame) -> DataFrame:
    """One row per (record_kind, file_id, path) with its most frequent type."""
    w = Window.partitionBy("record_kind", "file_id", "path").orderBy(F.desc("n"), "type")
    return profiles.where("path is not null").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def corpus_values(known: DataFrame) -> DataFrame:
    """(record_kind, path, type, wide): a sketch of a field's values over all files.

    A file with three records shows little of what a field can hold. Each file passes on its
    eight smallest value hashes, the top SKETCH distinct ones are kept per field (a grouped
    limit before the shuffle, so a field of every file stays small).
    """
    at = ["record_kind", "path", "type"]
    each = known.where("type in ('string', 'array')").select(*at, F.explode(F.slice("vals", 1, 8)).alias("val")).distinct()
    kept = each.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("val"))).where(F.col("rank") <= SKETCH)
    return kept.groupBy(*at).agg(F.collect_list("val").alias("wide"))


def file_chain(profiles: DataFrame, source_files: DataFrame) -> DataFrame:
    """(stream_id, record_kind, file_id, before) for each file of a stream and its predecessor of that kind."""
    having = profiles.where("path is null").select("record_kind", "file_id")
    listed = source_files.where("file_id is not null and stream_id is not null").groupBy("file_id").agg(F.min("stream_id").alias("stream_id"), F.min("written_at").alias("written_at"))
    w = Window.partitionBy("stream_id", "record_kind").orderBy(F.col("written_at").asc_nulls_first(), "file_id")
    return having.join(listed, "file_id").withColumn("before", F.lag("file_id").over(w)).where("before is not null").select("stream_id", "record_kind", "file_id", "before")


def _tokens(name: str) -> set[str]:
    return {t.lower() for t in re.findall(r"[A-Za-z][a-z]*|[A-Z]+|\d+", name)}


def _name_likeness(a: str, b: str) -> float:
    x, y = _tokens(a), _tokens(b)
    tokens = len(x & y) / max(1, min(len(x), len(y)))
    p, q = (({s[i : i + 3] for i in range(len(s) - 2)} or {s}) for s in (a.lower(), b.lower()))
    return max(tokens * 0.8, 2 * len(p & q) / (len(p) + len(q)))


def _histogram(flat: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i in range(0, len(flat), 2):
        out[flat[i]] += flat[i + 1]
    return out


def value_likeness(a: dict, b: dict) -> float:
    """How far two fields of one type carry the same sort of values, 0 to 1."""
    if a["type"] != b["type"]:
        return 0.0
    if a["type"] == "boolean":
        return 0.6
    va, vb = set(a["vals"]), set(b["vals"])
    shared = len(va & vb) / max(1, min(len(va), len(vb)))
    if a["type"] in ("string", "array"):
        wa, wb = set(a.get("wide") or ()), set(b.get("wide") or ())
        shared = max(shared, len(wa & wb) / max(1, min(len(wa), len(wb))))
        fa, fb = set(a["forms"]), set(b["forms"])
        return max(shared, 0.9 * len(fa & fb) / max(1, min(len(fa), len(fb))))
    if abs(a["fractional"] / a["n"] - b["fractional"] / b["n"]) > 0.5:
        return 0.0
    ha, hb = _histogram(a["bins"]), _histogram(b["bins"])
    if not ha or not hb:
        return shared
    na, nb = sum(ha.values()), sum(hb.values())

    def mean(h: dict[int, int], n: int) -> float:
        return sum(k * v for k, v in h.items()) / n

    apart = abs(mean(ha, na) - mean(hb, nb)) / 4
    spread = lambda h, n: math.sqrt(sum(v * (k - mean(h, n)) ** 2 for k, v in h.items()) / n) / 4
    near = math.exp(-((apart / (0.15 + spread(ha, na) + spread(hb, nb))) ** 2))
    return max(shared, near)


def flood(before: list[dict], after: list[dict], rounds: int = 30, tolerance: float = 1e-3) -> dict[tuple[str, str], float]:
    """Similarity flooding between two schemas; settled scores of all pairs of fields.

    Nodes are fields, the objects above them and types. Edges lead from an object to what it
    holds and from a field to its type. A pair of nodes passes its score to the pairs its
    equally labelled edges lead to and back, each edge's weight shared among its targets.
    """
    score: dict[tuple[str, str], float] = {}
    edges: dict[tuple, set[tuple]] = defaultdict(set)
    kept = {a["path"] for a in before} & {b["path"] for b in after}
    for a in before:
        for b in after:
            p, q = a["path"], b["path"]
            # A field that stays is matched with itself; only what stops and starts is open.
            if p != q and (p in kept or q in kept):
                continue
            score["f:" + p, "f:" + q] = (1.0 if p == q else 0.3 * _name_likeness(p, q)) + value_likeness(a, b)
            edges["f:" + p, "f:" + q].add(("t:" + a["type"], "t:" + b["type"]))
            x, y, below = p, q, ("f:" + p, "f:" + q)
            while True:
                x, y = x.rpartition(".")[0], y.rpartition(".")[0]
                up = ("o:" + x, "o:" + y)
                edges[up].add(below)
                score.setdefault(up, 1.0 if x == y else 0.3 * _name_likeness(x or "$", y or "$"))
                if not x or not y:
                    break
                below = up
            score.setdefault(("t:" + a["type"], "t:" + b["type"]), float(a["type"] == b["type"]))
    flows: dict[tuple, list[tuple[tuple, float]]] = defaultdict(list)
    into: dict[tuple, int] = defaultdict(int)
    for targets in edges.values():
        for t in targets:
            into[t] += 1
    for node, targets in edges.items():
        for t in targets:
            flows[t].append((node, 1 / len(targets)))
            flows[node].append((t, 1 / into[t]))
    start = dict(score)
    for _ in range(rounds):
        new = {k: start[k] + v + sum(score[o] * w for o, w in flows[k]) for k, v in score.items()}
        top = max(new.values()) or 1.0
        new = {k: v / top for k, v in new.items()}
        moved = math.sqrt(sum((new[k] - score[k]) ** 2 for k in new))
        score = new
        if moved < tolerance:
            break
    return {(p[2:], q[2:]): v for (p, q), v in score.items() if p[:2] == "f:"}


def choose(removed: list[dict], added: list[dict], scores: dict[tuple[str, str], float], barred: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Consistent one-to-one renames: best settled score first, values of the same sort only."""
    pairs = [(scores[a["path"], b["path"]], a["path"], b["path"]) for a in removed for b in added if (a["path"], b["path"]) not in barred and value_likeness(a, b) >= SAME_SORT]
    out, used_a, used_b = [], set(), set()
    for _, p, q in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if p not in used_a and q not in used_b:
            out.append((p, q))
            used_a.add(p)
            used_b.add(q)
    return out


_RENAMED = pa.schema([("record_kind", pa.string()), ("file_id", pa.int64()), ("old_path", pa.string()), ("new_path", pa.string())])


def _match_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            before, after = row["before_fields"], row["after_fields"]
            was, now = {x["path"] for x in before}, {x["path"] for x in after}
            removed, added = [x for x in before if x["path"] not in now], [x for x in after if x["path"] not in was]
            barred = {(x["old"], x["new"]) for x in row["barred"] or []}
            out += [{"record_kind": row["record_kind"], "file_id": row["file_id"], "old_path": p, "new_path": q} for p, q in choose(removed, added, flood(before, after), barred)]
        yield pa.RecordBatch.from_pylist(out, schema=_RENAMED)


def _side_by_side(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """Candidate pairs (record_kind, old, new) whose fields occur together in more than a few files of either."""
    pairs = candidates.select("record_kind", "old", "new").distinct()
    sizes = present.groupBy("record_kind", "path").agg(F.count("*").alias("files"))
    both = pairs.join(present.withColumnRenamed("path", "old"), ["record_kind", "old"]).join(present.withColumnRenamed("path", "new"), ["record_kind", "new", "file_id"]).groupBy("record_kind", "old", "new").agg(F.count("*").alias("both"))
    sized = both.join(sizes.withColumnsRenamed({"path": "old", "files": "old_files"}), ["record_kind", "old"]).join(sizes.withColumnsRenamed({"path": "new", "files": "new_files"}), ["record_kind", "new"])
    return sized.where(F.col("both") > F.least("old_files", "new_files") * SIDE_BY_SIDE).select("record_kind", "old", "new")


def changes(all_records: DataFrame, source_files: DataFrame) -> DataFrame:
    """(stream_id, file_id, record_kind, change_kind, old_path, new_path), without repeats."""
    profiles = cut(profile(all_records), "profiles")
    chain = cut(file_chain(profiles, source_files), "chain")
    sketch = ["type", "n", "vals", "forms", "bins", "fractional", "truthy", "wide"]
    plain = fields(profiles)
    known = plain.join(corpus_values(plain), ["record_kind", "path", "type"], "left").select("record_kind", "file_id", "path", F.struct("path", *sketch).alias("field"))
    now = known.join(chain.select("record_kind", "file_id"), ["record_kind", "file_id"])
    was = known.withColumnRenamed("file_id", "before").join(chain.select("record_kind", "file_id", "before"), ["record_kind", "before"]).select("record_kind", "file_id", "path", F.col("field").alias("old_field"))
    compared = cut(was.join(now, ["record_kind", "file_id", "path"], "full"), "compared")
    removed, added = compared.where("field is null"), compared.where("old_field is null")
    at = ["record_kind", "file_id"]
    candidates = cut(
        removed.select(*at, F.col("path").alias("old"), F.col("old_field.type").alias("type")).join(added.select(*at, F.col("path").alias("new"), F.col("field.type").alias("type")), [*at, "type"]).select(*at, "old", "new"), "candidates"
    )
    barred = candidates.join(_side_by_side(candidates, known.select("record_kind", "file_id", "path")), ["record_kind", "old", "new"]).groupBy(*at).agg(F.collect_list(F.struct("old", "new")).alias("barred"))
    schemas = compared.join(candidates.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.collect_list("old_field").alias("before_fields"), F.collect_list("field").alias("after_fields"))
    renamed = cut(schemas.join(barred, at, "left").select(*at, "before_fields", "after_fields", "barred").mapInArrow(_match_task, "record_kind string, file_id bigint, old_path string, new_path string"), "renamed")
    gone = removed.select(*at, F.lit("removed").alias("change_kind"), F.col("path").alias("old_path"), F.lit("").alias("new_path")).join(renamed.select(*at, "old_path"), [*at, "old_path"], "left_anti")
    come = added.select(*at, F.lit("added").alias("change_kind"), F.lit("").alias("old_path"), F.col("path").alias("new_path")).join(renamed.select(*at, "new_path"), [*at, "new_path"], "left_anti")
    retyped = compared.where("old_field.type <> field.type").select(*at, F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    every = gone.unionByName(come).unionByName(retyped).unionByName(renamed.withColumn("change_kind", F.lit("renamed")))
    return every.join(chain.select("stream_id", *at), at).select("stream_id", "file_id", "record_kind", "change_kind", "old_path", "new_path")


def field_history(all_records: DataFrame, source_files: DataFrame) -> DataFrame:
    """(record_kind, path, type, files, records): what each field was in all files together."""
    known = fields(profile(all_records))
    return known.groupBy("record_kind", "path", "type").agg(F.count("*").alias("files"), F.sum("n").alias("records"))


def canonical_names(renames: DataFrame, source_files: DataFrame) -> DataFrame:
    """(stream_id, record_kind, path, canonical): the name that a stream's field has in the end.

    ``renames``: stream_id, record_kind, file_id, old_path, new_path. A stream's renames are followed from name to name (the
    latest of a name counts) by pointer doubling; names that were swapped in a circle are all called by the smallest.
    """
    when = source_files.groupBy("file_id").agg(F.min("written_at").alias("written_at"))
    name = lambda c: F.to_json(F.struct("stream_id", "record_kind", F.col(c).alias("path")))
    latest = F.struct(F.col("written_at").isNotNull(), "written_at", "file_id", "new_path")
    links = renames.join(when, "file_id", "left").groupBy(name("old_path").alias("id")).agg(F.max_by(name("new_path"), latest).alias("parent_id"))
    links = cut(links, "links")
    both = links.unionByName(links.select(F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    part = lambda c, k: F.get_json_object(c, f"$.{k}").alias(k)
    return hierarchy.resolve(both).select(part("id", "stream_id"), part("id", "record_kind"), part("id", "path"), F.get_json_object("root", "$.path").alias("canonical"))


_LONG = pa.schema([("record_kind", pa.string()), ("file_id", pa.int64()), ("record_id", pa.string()), ("path", pa.string()), ("type", pa.string()), ("value", pa.string())])


def _explode_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[] for _ in _LONG]
        for kind, file, record_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            record = _loads(text)
            for path, value in _leaves(record) if isinstance(record, dict) else ():
                for column, x in zip(columns, (kind, file, record_id, path, _type(value), value if isinstance(value, str) else _dumps(value)), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LONG.types, strict=True)], schema=_LONG)


def unify(records_with_id: DataFrame, renames: DataFrame, source_files: DataFrame) -> DataFrame:
    """One consistent table of all versions, a row a field of a record:
    (stream_id, record_kind, file_id, record_id, field, type, text_value, number_value, boolean_value).

    Fields have their stream's latest names. A field has one type in all files of its stream: its own where that never
    changed, else string; values are cast to it and stand in the column of that type (arrays as JSON text). Records of
    files that belong to no stream are left out. Input columns: record_kind, file_id, record_id, options.
    """
    long = records_with_id.select("record_kind", "file_id", "record_id", "options").mapInArrow(_explode_task, "record_kind string, file_id bigint, record_id string, path string, type string, value string")
    streams = source_files.where("file_id is not null and stream_id is not null").groupBy("file_id").agg(F.min("stream_id").alias("stream_id"))
    rows = long.join(streams, "file_id")
    at = ["stream_id", "record_kind", "path"]
    named = cut(rows.join(canonical_names(renames, source_files), at, "left").withColumn("field", F.coalesce("canonical", "path")).drop("path", "canonical"), "named")
    # One row a field: schema, not data.
    types = named.groupBy("stream_id", "record_kind", "field").agg(F.min("type").alias("low"), F.max("type").alias("high"))
    common = types.select("stream_id", "record_kind", "field", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("string").alias("common"))
    j = named.join(common, ["stream_id", "record_kind", "field"])
    return j.select(
        "stream_id", "record_kind", "file_id", "record_id", "field", F.col("common").alias("type"), F.when(F.col("common").isin("string", "array"), F.col("value")).alias("text_value"),
        F.when(F.col("common") == "number", F.col("value").try_cast("double")).alias("number_value"), F.when(F.col("common") == "boolean", F.col("value").try_cast("boolean")).alias("boolean_value"),
    )
