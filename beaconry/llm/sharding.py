"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key is hashed to one of CELLS equal cells of the ring. Each shard owns
VNODES points; a key belongs to the first point clockwise of its cell. A shard
takes rows up to its capacity, its own arcs first and then what is carried to
it; what a full shard cannot take continues clockwise to the next point. With
slack 0 the capacities add up to the row count, so counts are at most one apart
(the law `rows`); with more slack fewer rows leave their home arc.

What is done where: executors count rows by cell (one integer column is read),
the driver walks the ring over at most CELLS counts, whatever the input's size,
and executors number the rows inside each cell and look their interval up. A
cell holds 1/CELLS of the keys and equal texts have keys of their own, so a hot
group of copies spreads evenly. Only ids, sizes and checksums are shuffled.

Defined results: a null text has no bytes (size 8, crc32 of nothing); a null
doc_id is hashed like any other key; repeated rows each get a slot of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 1 << 14
VNODES = 32


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every point. Points of shard k don't depend on later shards, so growing only adds points."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = shard
    return sorted(taken.items())


def place(counts: list[int], shards: int, slack: float = 0.0, vnodes: int = VNODES) -> list[tuple[int, int, int, int]]:
    """(first rank, end rank, shard, first slot): ranks count rows along the ring from cell 0."""
    cells, total = len(counts), sum(counts)
    starts = [0]
    for n in counts:
        starts.append(starts[-1] + n)
    points = ring(shards, vnodes, cells)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [-int(-total * (1 + slack) // shards)] * shards
    used = [0] * shards
    homes = []
    before = 0
    for at, _ in points:
        homes.append([(starts[before], starts[at + 1])])
        before = at + 1
    homes[0].insert(0, (starts[before], total))  # what lies beyond the last point belongs to the first
    out: list[tuple[int, int, int, int]] = []
    carried: deque[tuple[int, int]] = deque()
    first = True
    while first or carried:
        for i, (_, shard) in enumerate(points):
            come = deque(x for x in homes[i] if x[1] > x[0]) if first else deque()
            come.extend(carried)
            carried = deque()
            while come:
                a, b = come.popleft()
                take = min(b - a, room[shard] - used[shard])
                if take:
                    out.append((a, a + take, shard, used[shard]))
                    used[shard] += take
                if a + take < b:
                    carried.append((a + take, b))
                    carried.extend(come)
                    break
        first = False
    return sorted(out)


def shard(docs: DataFrame, shards: int = 24, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row (see the module's text)."""
    h = F.xxhash64(F.col(key))
    cell = F.shiftrightunsigned(h, 50).cast("int")
    found = docs.groupBy(cell.alias("cell")).count().collect()  # CELLS rows at most
    counts = [0] * CELLS
    for row in found:
        counts[row["cell"]] = row["count"]
    starts = [0]
    for n in counts:
        starts.append(starts[-1] + n)
    spans = []
    for a, b, s, slot in place(counts, shards, slack):
        c = bisect_left(starts, a + 1) - 1
        while c < CELLS and starts[c] < b:
            lo, hi = max(a, starts[c]), min(b, starts[c + 1])
            if hi > lo:
                spans.append((c, lo - starts[c], hi - starts[c], s, slot + lo - a))
            c += 1
    # One row a cell and a few more: its size is bounded by CELLS, so it is sent to all tasks as one literal.
    by_cell: dict[int, list] = {}
    for c, lo, hi, s, slot in spans:
        by_cell.setdefault(c, []).append([hi, s, slot - lo])
    spark = docs.sparkSession
    pieces = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps([{"cell": c, "at": x} for c, x in by_cell.items()])), "array<struct<cell:int,at:array<array<bigint>>>>")).alias("x")
    ).select("x.cell", "x.at")
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), h.alias("h"), cell.alias("cell")
    )
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    hit = F.element_at(F.filter("at", lambda x: x[0] > F.col("rank")), 1)
    return (
        rows.join(F.broadcast(pieces), "cell")
        .withColumn("hit", hit)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("hit")[1].cast("int").alias("shard"), (F.col("hit")[2] + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
