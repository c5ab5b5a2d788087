"""Conversations rebuilt from message rows, and the ones to drop.

Messages arrive in export fragments (the rows of one session in one batch) that may overlap.

1. ``ranked`` orders the messages of every fragment that shares any with another, and gives each its rank and the
   sums of the message hashes before it.
2. ``overlaps`` finds suffix-prefix matches. Each fragment is linked to the one that begins first among those that
   hold one of its shared messages (a representative; copies are never paired with each other). A
   link says how far the two are shifted; the hash sums of the stretch they must then share are compared, so
   one look-up tells whether it is the same in both, without a hole: the end of one and the
   beginning of the other (``suffix_prefix``), or all of one within the other (``inside``); else ``tangled``.
3. ``contigs`` merges fragments along unambiguous links (each takes the predecessor it shares most with; a predecessor that
   two fragments take is a fork and ends the path) by pointer doubling; a fragment inside another is absorbed by it.
4. ``assemble`` takes the messages of all contigs, one copy of each (the earliest delivery), and puts them
   in order of time, then id; parts follow by ordinal. A part whose message is in no contig is a gap.
5. ``verdicts`` drops conversations that are empty, broken (a gap among others) or miss a reply, by the data's statement.

A session of any size is no single task's business: turns are compared within (session, hour)
blocks and the blocks are combined by their first and last turn, and ranks likewise.

Defined results
* Ids of messages are compared trimmed and in lower case. Roles are canonical (NULL where the
  spelling is none of the known); turns are user or assistant messages with a conversational,
  non-blank text part.
* Messages without session or id cannot be placed and are left out; so are parts without session.
* Rows without a batch are one fragment of their session.
* Exact repeats of parts count once. NULL ordinals break a conversation. An unreadable time
  breaks it; such messages come last in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import blank, id_key
from quern.operators.hierarchy import resolve
from quern.operators.instants import with_instant
from quern.operators.skew import hot_keys, join_on
from quern.operators.upsert import identified
from quern.session import cut

HOUR_US = 3_600_000_000
KEY = ["session_id", "message_key"]
ROLES = {"system": ("system", "developer"), "user": ("user", "human"), "assistant": ("assistant", "ai", "model"), "tool": ("tool", "function", "toolresult")}


def canonical_role(role: str):
    r = id_key(role)
    out = F.when(F.lit(False), F.lit(""))
    for name, spellings in ROLES.items():
        out = out.when(r.isin(*spellings), name)
    return out


def timed(messages: DataFrame, hosts: DataFrame, content: bool = True) -> DataFrame:
    """Every delivery that can be placed: identity, batch, role, instant and, unless nobody needs it, content."""
    rows = identified(messages).select(*KEY, F.coalesce("batch_id", F.lit("")).alias("batch_id"), "delivered_at", "delivery_id", canonical_role("role").alias("role"), *(["content"] if content else []), "timestamp", "hostname")
    return with_instant(rows, "timestamp", hosts).drop("hostname", "timestamp")


def survivors(deliveries: DataFrame) -> DataFrame:
    """One row per message, the earliest delivery, with the fragments it was seen in (``copies``, ``first_batch``, ``last_batch``)."""
    rank = F.struct(F.col("delivered_at").isNull(), "delivered_at", F.col("delivery_id").isNull(), "delivery_id")
    return deliveries.groupBy(*KEY).agg(
        F.min_by(F.struct(*[c for c in ("role", "utc_us", "content", "batch_id") if c in deliveries.columns]), rank).alias("row"), F.count("*").alias("copies"), F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch")
    ).select(*KEY, "row.*", "copies", "first_batch", "last_batch")


def _position() -> F.Column:
    return F.struct(F.col("utc_us").isNull().alias("untimed"), F.col("utc_us").alias("us"), F.col("message_key").alias("key"))


BATCH = ["session_id", "batch_id"]
#: Bits of one message hash; two are kept, and sums of both compared.
BITS = 31


def _block() -> F.Column:
    """Stretch of a session that one task orders: an hour, or, of untimed messages, those whose ids begin alike."""
    return F.struct(F.coalesce(F.floor(F.col("utc_us") / HOUR_US), F.lit(1 << 50)).alias("hour"), F.when(F.col("utc_us").isNull(), F.substring("message_key", 1, 12)).otherwise("").alias("prefix"))


def ranked(deliveries: DataFrame, kept: DataFrame) -> DataFrame:
    """(session_id, batch_id, message_key, utc_us, is_shared, rank, sum1, sum2) of the fragments that share messages.

    A message stands where its surviving copy does; ``sum1`` and ``sum2`` add up the hashes of those before it. Ranks and
    sums are made block by block, so a fragment of any size is never ordered by one task.
    """
    shared = kept.where("first_batch <> last_batch").select(*KEY)
    touched = deliveries.join(shared, KEY, "left_semi").select(*BATCH).distinct()
    rows = deliveries.join(touched, BATCH, "left_semi").select(*BATCH, "message_key").distinct()
    placed = rows.join(kept.select(*KEY, "utc_us", (F.col("first_batch") != F.col("last_batch")).alias("is_shared")), KEY).withColumn("block", _block())
    marks = [F.pmod(F.xxhash64("message_key", F.lit(seed)), F.lit(1 << BITS)) for seed in (1, 2)]
    hashed = placed.withColumn("h1", marks[0]).withColumn("h2", marks[1])
    w = Window.partitionBy(*BATCH, "block").orderBy("utc_us", "message_key").rowsBetween(Window.unboundedPreceding, 0)
    inner = hashed.withColumn("n", F.count("*").over(w)).withColumn("s1", F.sum("h1").over(w)).withColumn("s2", F.sum("h2").over(w))
    upto = Window.partitionBy(*BATCH).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = hashed.groupBy(*BATCH, "block").agg(F.count("*").alias("m"), F.sum("h1").alias("t1"), F.sum("h2").alias("t2"))
    before = before.select(*BATCH, "block", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("m", "t1", "t2")])
    j = inner.join(before, [*BATCH, "block"])
    return j.select(*BATCH, "message_key", "utc_us", "is_shared", (F.col("m") + F.col("n") - 1).alias("rank"), (F.col("t1") + F.col("s1") - F.col("h1")).alias("sum1"), (F.col("t2") + F.col("s2") - F.col("h2")).alias("sum2"), "h1", "h2")


def overlaps(rows: DataFrame) -> DataFrame:
    """(session_id, a, b, shared, kind) for fragments linked by a shared message, from ``ranked`` rows; ``a`` begins first.

    ``shared`` is the length of the common stretch (for ``tangled`` the number of links found).
    """
    last = F.struct("rank", F.col("sum1") + F.col("h1"), F.col("sum2") + F.col("h2"))
    frag = rows.groupBy(*BATCH).agg(F.min(F.struct(F.col("utc_us").isNull().alias("untimed"), F.col("utc_us").alias("us"), F.col("message_key").alias("key"))).alias("head"), F.max(last).alias("last"))
    frag = frag.select(*BATCH, "head", (F.col("last")["rank"] + 1).alias("size"), F.col("last")["col2"].alias("all1"), F.col("last")["col3"].alias("all2"))
    copies = rows.where("is_shared").join(frag.select(*BATCH, "head", "size"), BATCH)
    # Of the fragments that hold a message, the one that begins first (the longest of those, then by name) stands for all.
    order = F.struct("head", -F.col("size"), "batch_id")
    first = copies.groupBy(*KEY).agg(F.min_by(F.struct(F.col("batch_id").alias("a"), F.col("rank").alias("rank_a")), order).alias("f"), F.count("*").alias("count"))
    few = hot_keys(first, KEY)[2]
    links = join_on(copies.select(*KEY, F.col("batch_id").alias("b"), F.col("rank").alias("rank_b")), first.select(*KEY, "f.a", "f.rank_a"), KEY, few, "inner").where("a <> b")
    links = links.groupBy("session_id", "a", "b", (F.col("rank_a") - F.col("rank_b")).alias("shift")).agg(F.count("*").alias("found"))
    side = lambda x: frag.select("session_id", F.col("batch_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "all1", "all2")])
    j = links.join(side("a"), ["session_id", "a"]).join(side("b"), ["session_id", "b"])
    j = j.withColumn("m", F.least(F.col("size_a") - F.col("shift"), "size_b")).withColumn("end_a", F.col("shift") + F.col("m"))
    sums = lambda x, at, name: rows.select("session_id", F.col("batch_id").alias(x), F.col("rank").alias(at), F.col("sum1").alias(f"{name}1"), F.col("sum2").alias(f"{name}2"))
    j = j.join(sums("a", "shift", "low"), ["session_id", "a", "shift"], "left").join(sums("a", "end_a", "high"), ["session_id", "a", "end_a"], "left").join(sums("b", "m", "own"), ["session_id", "b", "m"], "left")
    same = F.lit(True)
    for i in (1, 2):
        high = F.when(F.col("end_a") == F.col("size_a"), F.col(f"all{i}_a")).otherwise(F.col(f"high{i}"))
        own = F.when(F.col("m") == F.col("size_b"), F.col(f"all{i}_b")).otherwise(F.col(f"own{i}"))
        same = same & (high - F.col(f"low{i}") == own)
    exact = F.coalesce(same & (F.col("shift") >= 0), F.lit(False))
    kind = F.when(exact & (F.col("m") == F.col("size_b")), "inside").when(exact, "suffix_prefix").otherwise("tangled")
    found = j.select("session_id", "a", "b", kind.alias("kind"), F.when(exact, F.col("m")).otherwise(F.col("found")).alias("shared"), exact.alias("exact"))
    best = found.groupBy("session_id", "a", "b").agg(F.max(F.struct("exact", "shared", "kind")).alias("r"))
    return best.select("session_id", "a", "b", "r.shared", "r.kind")


def contigs(deliveries: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per fragment: (session_id, batch_id, contig, follows, shared, kind).

    Fragments of one unambiguous path, or inside one, share a contig (named after its first fragment). ``follows`` is the
    fragment that this one continues or lies in, ``kind`` how; ``alone`` where there is none, ``fork`` where another
    continues the same one, ``tangled`` where a shared stretch differs.
    """
    over = cut(overlaps(cut(ranked(deliveries, kept), "ranked")), "overlaps")
    inside = F.col("kind") == "inside"
    # Each fragment takes one link: the one that holds it whole, else the one it shares most with.
    best = over.groupBy("session_id", F.col("b").alias("batch_id")).agg(F.max_by(F.struct("a", "shared", "kind"), F.struct(inside, F.col("kind") == "suffix_prefix", "shared", F.col("a"))).alias("l")).select("session_id", "batch_id", "l.*")
    takers = best.where("kind = 'suffix_prefix'").groupBy("session_id", "a").agg(F.count("*").alias("takers"))
    told = best.join(takers, ["session_id", "a"], "left").withColumn("kind", F.when((F.col("kind") == "suffix_prefix") & (F.col("takers") > 1), "fork").otherwise(F.col("kind"))).drop("takers")
    told = cut(told, "links")
    name = lambda c: F.concat_ws("\u001f", "session_id", c)
    links = told.where("kind in ('inside', 'suffix_prefix')").select(name("batch_id").alias("id"), name("a").alias("parent_id"))
    every = deliveries.select(*BATCH).distinct()
    if links.isEmpty():
        roots = deliveries.sparkSession.createDataFrame([], "session_id string, batch_id string, contig string")
    else:
        both = links.unionByName(links.select(F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("parent_id")))
        part = lambda c, i: F.element_at(F.split(c, "\u001f"), i)
        roots = resolve(both).select(part("id", -2).alias("session_id"), part("id", -1).alias("batch_id"), part("root", -1).alias("contig"))
    j = every.join(roots, BATCH, "left").join(told.withColumnRenamed("a", "follows"), BATCH, "left")
    return j.select(*BATCH, F.coalesce("contig", "batch_id").alias("contig"), "follows", "shared", F.coalesce("kind", F.lit("alone")).alias("kind"))


def part_facts(parts: DataFrame) -> DataFrame:
    """(session_id, message_key, n_parts, parts_ok, has_text) per message, exact repeats of a part aside."""
    body = [c for c in parts.columns if c not in ("session_id", "message_id", "ordinal")]
    text = (F.col("type") == "text") & (F.col("provenance") == "conversational") & ~blank("text")
    rows = parts.where("session_id is not null").select("session_id", id_key("message_id").alias("message_key"), "ordinal", F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in body]).alias("body"), text.alias("text"))
    once = rows.groupBy(*KEY, "ordinal", "body").agg(F.max("text").alias("text"))
    # 0..n-1 once each: n rows, bounds 0 and n-1, and the sum of the ordinals' hashes that a gapless run has.
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))
    facts = once.groupBy(*KEY).agg(F.count("*").alias("n_parts"), F.count("ordinal").alias("numbered"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.sum(mark("ordinal")).alias("marks"), F.max("text").alias("has_text"))
    run = F.when(F.col("n_parts") == 1, mark(F.lit(0).cast("int"))).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), (F.col("n_parts") - 1).cast("int")), mark), F.lit(0).cast("bigint"), lambda s, x: s + x))
    ok = (F.col("numbered") == F.col("n_parts")) & (F.col("low") == 0) & (F.col("high") == F.col("n_parts") - 1)
    return facts.select(*KEY, "n_parts", (F.coalesce(ok, F.lit(False)) & (F.when(ok, F.col("marks") == run).otherwise(False))).alias("parts_ok"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def unanswered_calls(parts: DataFrame) -> DataFrame:
    """Sessions with a tool result whose call is nowhere in the session (a NULL call_id has none)."""
    calls = parts.where("type = 'tool_call' and session_id is not null and call_id is not null").select("session_id", "call_id").distinct()
    results = parts.where("type = 'tool_result' and session_id is not null").select("session_id", "call_id").distinct()
    return results.join(calls, ["session_id", "call_id"], "left_anti").select("session_id").distinct()


def assemble(messages: DataFrame, parts: DataFrame, hosts: DataFrame, content: bool = True) -> DataFrame:
    """Per message of the rebuilt conversations, broken ones included: identity, role, utc_us, contig, and what its parts show.

    Rows of parts without a message have NULL role and ``orphan`` true.
    """
    deliveries = cut(timed(messages, hosts, content), "deliveries")
    kept = cut(survivors(deliveries), "survivors")
    own = [c for c in ("role", "utc_us", "content") if c in kept.columns]
    joined = kept.select(*KEY, *own, "batch_id").join(contigs(deliveries, kept).select(*BATCH, "contig"), BATCH)
    both = joined.withColumn("present", F.lit(True)).join(part_facts(parts), KEY, "full")
    return both.select(*KEY, *own, "contig", F.col("present").isNull().alias("orphan"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("parts_ok", F.lit(False)).alias("parts_ok"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def verdicts(assembled: DataFrame, sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, reason or NULL) for every id of ``sessions`` and of the messages."""
    speaks = F.col("role").isin("user", "assistant")
    turn = speaks & F.col("has_text") & ~F.col("orphan")
    broken = F.col("orphan") | ((F.col("n_parts") > 0) & ~F.col("parts_ok")) | (speaks & (F.col("n_parts") == 0)) | (~F.col("orphan") & F.col("utc_us").isNull())
    rows = assembled.select("session_id", "message_key", "utc_us", F.when(turn, F.col("role") == "user").alias("asks"), F.coalesce(broken, F.lit(False)).alias("broken"), "orphan", F.floor(F.col("utc_us") / HOUR_US).alias("block"))
    # Within a block: is a question followed by a question? Then block by block.
    # A turn without a time breaks its conversation wherever it stands, so none is put in order.
    at = F.struct("utc_us", "message_key")
    w = Window.partitionBy("session_id", "block").orderBy("utc_us", "message_key")
    turns = rows.where("asks is not null and utc_us is not null").withColumn("before", F.lag("asks").over(w))
    spoken = turns.groupBy("session_id", "block").agg(F.max(F.coalesce(F.col("asks") & F.col("before"), F.lit(False))).alias("twice"), F.min_by("asks", at).alias("first"), F.max_by("asks", at).alias("last"))
    order = Window.partitionBy("session_id").orderBy("block")
    chained = spoken.withColumn("before", F.lag("last").over(order))
    told = chained.groupBy("session_id").agg(F.max(F.col("twice") | F.coalesce(F.col("before") & F.col("first"), F.lit(False))).alias("twice"), F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"))
    flags = rows.groupBy("session_id").agg(F.max("broken").alias("broken"), F.min("orphan").alias("only_orphans"), F.max(F.col("asks").isNotNull()).alias("any_turn"))
    every = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct().withColumn("listed", F.lit(True)).join(flags, "session_id", "full").where("listed or not only_orphans")
    dangling = unanswered_calls(parts).withColumn("dangling", F.lit(True))
    j = every.join(told, "session_id", "left").join(dangling, "session_id", "left")
    reason = F.when(~F.coalesce("any_turn", F.lit(False)), "empty").when(F.col("broken") | F.col("dangling") | ~F.col("first"), "broken").when(F.col("twice") | F.col("last"), "no_reply")
    return j.select("session_id", reason.alias("reason"))


def dropped(messages: DataFrame, parts: DataFrame, sessions: DataFrame, hosts: DataFrame) -> DataFrame:
    return verdicts(assemble(messages, parts, hosts, content=False), sessions, parts).where("reason is not null")


def rebuilt(messages: DataFrame, parts: DataFrame, sessions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Sound conversations as rows in order: (session_id, utc_us, message_key, role, ordinal, type, text, contig).

    Rows are written in the order session, time, message, part by a range partitioning, so a
    long conversation may span files but is never gathered into one row or task.
    """
    whole = cut(assemble(messages, parts, hosts), "assembled")
    sound = verdicts(whole, sessions, parts).where("reason is null").select("session_id")
    body = parts.where("provenance = 'conversational'").select("session_id", id_key("message_id").alias("message_key"), "ordinal", "type", F.coalesce("text", "params", "result", "file_name").alias("text")).distinct()
    told = whole.where("not orphan").join(sound, "session_id", "left_semi").join(body, KEY, "left")
    return told.select("session_id", "utc_us", "message_key", "role", "ordinal", "type", F.coalesce("text", "content").alias("text"), "contig").orderBy("session_id", "utc_us", "message_key", "ordinal")
