"""Filling containers of fixed capacity with whole documents: shortest-pack-first over the length histogram.

Packing works on the histogram of lengths, which has at most ``capacity`` entries whatever the
corpus. Lengths are placed longest first; documents of one length go into the open packs with
the most room left (the shortest packs), and packs with the same contents are one pattern with
a count. The patterns are then joined back to documents by rank: the k-th document of a length
goes where the k-th slot of that length is.

* Documents longer than the capacity are cut into full pieces and a remainder; nothing else is split.
* Ranks need no global sort. Documents of a length are spread over salted blocks, the blocks
  are counted and only their offsets are accumulated, so a length shared by a third of all
  documents is ranked in many tasks.
* What reaches the driver is the histogram (at most capacity rows a job), what is broadcast is
  the slot table, whose size is bounded by the number of patterns.

Defined results: NULL texts and texts of no tokens take no space and are left out; a capacity of
NULL or less than 1 packs nothing; equal documents are packed separately.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import TOKENIZER, count_tokens
from quern.session import cut

#: Documents of one length that one rank block should hold.
BLOCK = 100_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with their counts, shortest pack first.

    Each length is given to the open packs with the most room. A group of packs takes the
    length once per pack; if documents are left over, new packs are opened, each filled with
    as many of the length as fit.
    """
    # Open groups by room left: room -> {pattern: count}.
    open_groups: dict[int, dict[tuple, int]] = defaultdict(dict)
    rooms: list[int] = []  # negative rooms, as a heap

    def put(room: int, pattern: tuple, count: int) -> None:
        if count <= 0:
            return
        if room not in open_groups or not open_groups[room]:
            heapq.heappush(rooms, -room)
        group = open_groups[room]
        group[pattern] = group.get(pattern, 0) + count

    for length in sorted((k for k, v in histogram.items() if 0 < k <= capacity and v > 0), reverse=True):
        left = histogram[length]
        later: list[tuple[int, tuple, int]] = []
        while left and rooms and -rooms[0] >= length:
            room = -heapq.heappop(rooms)
            group = open_groups.pop(room, {})
            for pattern in sorted(group):
                count = group[pattern]
                take = min(count, left)
                if take:
                    # Fill as many of this length into each pack as keeps them level with the next group.
                    n = 1
                    if take == count:
                        following = -rooms[0] if rooms else 0
                        n = max(1, min(room // length, left // count, (room - following) // length + 1))
                    used = take * n
                    later.append((room - n * length, (*pattern, (length, n)), take))
                    left -= used
                if count > take:
                    later.append((room, pattern, count - take))
            if len(later) > 64:
                for item in later:
                    put(*item)
                later = []
        for item in later:
            put(*item)
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            put(capacity - fit * length, ((length, fit),), full)
            if rest:
                put(capacity - rest * length, ((length, rest),), 1)
    out = [(p, n) for group in open_groups.values() for p, n in group.items()]
    return sorted(out)


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run of slots, the first container of the run and how many slots a container has."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    container = 0
    for pattern, count in patterns:
        merged: dict[int, int] = defaultdict(int)
        for length, n in pattern:
            merged[length] += n
        for length, n in merged.items():
            runs[length].append((filled[length], container, n))
            filled[length] += n * count
        container += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length): documents longer than the capacity in full pieces and a remainder."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    return sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")).select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).alias("length"))


def ranked(items: DataFrame, most: int) -> DataFrame:
    """Add ``rank``, 0..n-1 within each length; ``most`` is the largest number of items of one length."""
    salts = max(1, -(-most // BLOCK))
    blocked = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = blocked.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return blocked.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"]).select("doc_id", "piece", "start", "length", (F.col("r") + F.col("offset")).alias("rank"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, container) of every document of ``sizes`` (doc_id, n_tokens)."""
    items = pieces(sizes, capacity)
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    table = slots(pack_histogram(histogram, capacity))
    shared = sizes.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            container = np.empty(len(length), np.int64)
            for k in np.unique(length):
                first, start, per = shared.value[int(k)]
                at = np.flatnonzero(length == k)
                run = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = start[run] + (rank[at] - first[run]) // per[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], names=["doc_id", "piece", "start", "length", "container"])

    return ranked(items, max(histogram.values(), default=1)).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, container bigint")


def pack_jobs(documents: DataFrame, jobs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(job_name, doc_id, piece, start, length, container) for every packing job; texts are tokenised once."""
    sizes = cut(count_tokens(documents, ["doc_id"], tokenizer), "sizes")
    out = None
    for name, capacity in sorted((r[0], r[1]) for r in jobs.select("job_name", "capacity_tokens").collect() if r[1] and r[1] > 0):
        one = pack(sizes, int(capacity)).select(F.lit(name).alias("job_name"), "doc_id", "piece", "start", "length", "container")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else documents.sparkSession.createDataFrame([], "job_name string, doc_id bigint, piece int, start bigint, length bigint, container bigint")


def fill_report(packed: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_name, capacity_tokens, pieces, tokens, containers, fill): how full the containers are."""
    per = packed.groupBy("job_name").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"), (F.max("container") + 1).alias("containers"))
    return per.join(F.broadcast(jobs.select("job_name", "capacity_tokens")), "job_name").select("job_name", "capacity_tokens", "pieces", "tokens", "containers", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
