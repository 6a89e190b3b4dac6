"""Mixture-controlled packing by deficit round-robin over source queues.

All token ids of all documents form one stream, cut into windows (sequences) of
`window` ids; only the last one is short. Deficit round-robin decides the order:
in each of `ROUNDS` rounds a window every source's deficit grows by its target share, and
the source sends packets (ids of a document, the rest of it later) while its
deficit covers them. A packet has at most `grain` ids and no more than a window's
share of its source, but `LEAST` at least; sources that need more than a round
for a packet begin at staggered deficits, so that they don't send together. So each window holds its sources in target
proportions, and what a packet gives too much or too little is made up for in
the next windows. The targets are a parameter; without one they are the sources'
shares of all ids. A source that has no ids left drops out, and the others keep
their proportions.

The stream is laid out in epochs of at most about `epoch` ids. A source's documents
are put in an order by a hash of id and text, and an epoch takes of every source
as many ids as its target asks for: borders are multiples of `grain` in each
source's own count, and a document that lies across one is split. So every epoch
holds the target shares, the deficit carried over a border is what the source
should have sent less what it did, and all epochs are packed at the same time.
A target far below a source's own share makes many small epochs at the end, where
that source is alone. Places in a source come
from running sums within buckets of the hash and over a table of one row per
(source, bucket). Only lengths are dealt out; the ids meet their pieces in one
join. A source that is a third of all rows is spread over all buckets and epochs,
and a task holds one epoch's lengths, whatever the input's size.

Defined results: a document's ids are followed by the id `end`; a null or empty
text is that id alone; a null source is a queue of its own; rows that repeat an
id are documents of their own, each with its own pieces; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry.llm.common import materialise, whole

WINDOW, GRAIN, EPOCH, END = 2048, 256, 1 << 22, 1
STEP, CHUNK = 256, 1 << 19
LEAST, ROUNDS = 16, 4
BUCKETS = 8  # of the hash, for each epoch


def tokenise(docs: DataFrame, path: str, end: int = END, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, queue, h, n, ids (little-endian unsigned 16-bit) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("queue"), whole(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    last = np.array([end], "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from beaconry.llm.tokens import word_ids

        words = word_ids(path)
        for whole_batch in batches:
            for b in _portions(whole_batch):
                ids = words.many(b["text"].to_pylist())
                n = np.array([len(x) + 1 for x in ids], np.int64)
                whole_ids = np.concatenate([x for own in ids for x in (own, last)])
                at = np.concatenate([[0], 2 * np.cumsum(n)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(whole_ids)])
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["queue"], b["h"], pa.array(n), column], ["doc_id", "queue", "h", "n", "ids"])

    return rows.mapInArrow(run, "doc_id long, queue string, h long, n long, ids binary")


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about CHUNK bytes of text, one at least."""
    a, n = 0, 0
    sizes = pc.binary_length(batch["text"]).to_pylist()
    for i, s in enumerate(sizes):
        n += s
        if n >= CHUNK or i + 1 == len(sizes):
            yield batch.slice(a, i + 1 - a)
            a, n = i + 1, 0


def packet(share: float, window: int = WINDOW, grain: int = GRAIN) -> int:
    """Most ids that a source sends at once."""
    return max(1, min(grain, max(LEAST, int(share * window))))


def schedule(rows: list[tuple[str, int]], share: dict[str, float], carry: dict[str, float], base: int, window: int = WINDOW, grain: int = GRAIN) -> list[list[int]]:
    """Pieces [row, start, length, place in the stream] of an epoch's documents (queue, ids), in the order given."""
    queues: dict[str, list[int]] = {}
    for i, (q, _) in enumerate(rows):
        queues.setdefault(q, []).append(i)
    names = sorted(queues)
    quantum = {q: share[q] * window / ROUNDS for q in names}
    size = {q: packet(share[q], window, grain) for q in names}
    rare = [q for q in names if quantum[q] < size[q]]
    deficit = {q: carry.get(q, 0.0) for q in names}
    for k, q in enumerate(rare):
        deficit[q] += size[q] * k / len(rare)
    head = {q: [0, 0] for q in names}  # document, ids of it that are sent
    pieces: list[list[int]] = []
    at = base
    while names:
        sent = False
        for q in names:
            own, (k, done) = queues[q], head[q]
            left = deficit[q] + quantum[q]
            while k < len(own):
                i = own[k]
                n = min(size[q], rows[i][1] - done)
                if left < n:
                    break
                left -= n
                while n:
                    part = min(n, window - at % window)
                    if pieces and at % window and pieces[-1][0] == i:
                        pieces[-1][2] += part
                    else:
                        pieces.append([i, done, part, at])
                    at, done, n = at + part, done + part, n - part
                sent = True
                if done == rows[i][1]:
                    k, done = k + 1, 0
            head[q], deficit[q] = [k, done], left
        if sent:
            names = [q for q in names if head[q][0] < len(queues[q])]
        else:  # no packet is covered yet: as many rounds at once as the first one needs
            need = lambda q: (min(size[q], rows[queues[q][head[q][0]]][1] - head[q][1]) - deficit[q]) / quantum[q]
            rounds = max(0, int(min(map(need, names))) - 1)
            for q in names:
                deficit[q] += rounds * quantum[q]
    return pieces


PLACES = "row long, start long, length long, place long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _deal(window: int, grain: int):
    def run(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by([("queue", "ascending"), ("at", "ascending")])
        queue, n = parts["queue"].to_pylist(), parts["n"].to_pylist()
        share, carry = dict(zip(queue, parts["share"].to_pylist())), dict(zip(queue, parts["carry"].to_pylist()))
        pieces = np.array(schedule(list(zip(queue, n)), share, carry, parts["base"][0].as_py(), window, grain), np.int64).reshape(-1, 4)
        of = pa.array(pieces[:, 0])
        return pa.table({"row": parts["row"].take(of), "start": parts["start"].take(of).to_numpy() + pieces[:, 1], "length": pieces[:, 2], "place": pieces[:, 3]})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, STEP):
                b = whole_batch.slice(a, STEP)
                pieces = b["pieces"].flatten()
                start, length, place = (pieces.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                of = np.repeat(np.arange(b.num_rows), b["pieces"].value_lengths().to_numpy())
                wide = [memoryview(np.frombuffer(x.as_py(), "<u2").astype("<u4")).cast("B") for x in b["ids"]]
                crc = [zlib.crc32(wide[i][x:y]) for i, x, y in zip(of.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())]
                of = pa.array(of)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b["doc_id"].take(of), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": b["n"].take(of),
                        "sequence_id": place // window, "offset": place % window, "queue": b["queue"].take(of),
                    }
                )

    return run


def targets(own: dict[str, int], target: dict[str, float] | None) -> tuple[dict[str, float], float]:
    """Share of each named source and the factor by which all others' own ids become shares.

    own: ids of the named sources, and of all others under None. Without a target
    every source has its share of all ids. Named shares add up to less than 1 where
    there are other sources: those divide what is left, in proportion to their ids.
    """
    total = sum(own.values()) or 1
    if not target:
        return {}, 1 / total
    named = {q: float(p) for q, p in target.items() if own.get(q)}
    if any(p <= 0 for p in named.values()):
        raise ValueError("a source that has ids needs a share above 0, as all documents are packed")
    left = 1 - sum(named.values())
    if own.get(None):
        if left <= 0:
            raise ValueError("the shares leave nothing to the sources that aren't named")
        return named, left / own[None]
    return {q: p / (1 - left) for q, p in named.items()}, 0.0


def epoch_parts(tokens: DataFrame, total: int, epoch: int = EPOCH, grain: int = GRAIN, target: dict[str, float] | None = None) -> DataFrame:
    """row, epoch, queue, at, start, n, share, carry, base: the part of each document (row, doc_id, queue, h, d, n) that each epoch holds.

    A source of t ids and share p is sent off after v = t / p ids of a stream that
    lacks none; m epochs divide the largest v. Epoch e gets the ids of each source
    from floor(v p e / m g) g on, where g is `grain`, until it has none left. at:
    place in the source; carry: the deficit that earlier epochs leave, what the
    source should have sent less what it did; base: where the epoch begins in the
    stream.
    """
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = {f"={q}": p for q, p in (target or {}).items()}
    sums = tokens.groupBy("queue").agg(F.sum("n").alias("t"))
    own = {r["queue"]: r["t"] for r in sums.filter(F.col("queue").isin(list(named))).collect()} if named else {}  # a row for each source of the target
    named, factor = targets(own | {None: total - sum(own.values())}, named)
    longest = max([own[q] / p for q, p in named.items()] + ([1 / factor] if factor else []))
    m, g = max(1, -(-int(longest + 0.5) // epoch)), F.lit(grain)
    share = F.col("t") * F.lit(factor)
    for q, p in named.items():
        share = F.when(F.col("queue") == q, F.lit(p)).otherwise(share)
    rows = tokens.select("row", "doc_id", "queue", "h", "d", "n", F.pmod(F.xxhash64("h", "row"), F.lit(m * BUCKETS)).alias("bucket"))
    by = materialise(rows.groupBy("queue", "bucket").agg(F.sum("n").alias("own")), "packing-buckets")  # a row for each bucket and source
    t = by.groupBy("queue").agg(F.sum("own").alias("t")).withColumn("share", share)
    own = by.select("queue", "bucket", before("own", Window.partitionBy("queue").orderBy("bucket")).alias("ahead")).join(t, "queue")
    rows = rows.withColumn("at", before("n", Window.partitionBy("queue", "bucket").orderBy("h", "doc_id", "n", "d", "row")))
    rows = rows.join(own, ["queue", "bucket"]).withColumn("at", F.col("at") + F.col("ahead"))
    t, at, end = F.col("t"), F.col("at"), F.col("at") + F.col("n")
    step = F.col("share") * F.lit(longest / m)  # ids of the source in an epoch
    border = lambda e: F.when(e >= m, t).otherwise(F.least(t, F.floor(step * e / g) * g))
    # The first epoch whose end lies beyond an id; rounding may miss it by one either way.
    near = lambda x: F.least(F.lit(m - 1).cast("long"), F.floor(x / step))
    epochs = F.filter(F.sequence(F.greatest(F.lit(0).cast("long"), near(at) - 1), F.least(F.lit(m - 1).cast("long"), near(end + g) + 1)), lambda e: (border(e + 1) > at) & (border(e) < end))
    rows = rows.withColumn("epoch", F.explode(epochs))
    e = F.col("epoch")
    rows = rows.withColumn("start", F.greatest(F.lit(0), border(e) - at)).withColumn("n", F.least(F.col("n"), border(e + 1) - at) - F.col("start"))
    carry = (step * e - border(e)).alias("carry")
    rows = materialise(rows.select("row", "epoch", "queue", (at + F.col("start")).alias("at"), "start", "n", "share", carry), "packing-parts")
    return rows.join(bases(rows.groupBy("epoch").agg(F.sum("n").alias("own"))), "epoch")


def bases(sizes: DataFrame, block: int = 1024) -> DataFrame:
    """epoch, base: the sum of own over smaller epochs; running sums within blocks of epochs, and over the blocks."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialise(sizes.withColumn("block", F.floor(F.col("epoch") / block)), "packing-epochs")
    blocks = sizes.groupBy("block").agg(F.sum("own").alias("own")).select("block", before("own", Window.orderBy("block")).alias("ahead"))
    inner = sizes.select("epoch", "block", before("own", Window.partitionBy("block").orderBy("epoch")).alias("base"))
    return inner.join(blocks, "block").select("epoch", (F.col("base") + F.col("ahead")).alias("base"))


def pack(tokens: DataFrame, window: int = WINDOW, grain: int = GRAIN, epoch: int = EPOCH, target: dict[str, float] | None = None) -> DataFrame:
    """The pieces of all rows of tokenise(); target: share of each source in a window (see targets())."""
    tokens = materialise(tokens.withColumn("d", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 1
    places = epoch_parts(tokens, total, epoch, grain, target).groupBy("epoch").applyInArrow(_deal(window, grain), PLACES)
    places = places.groupBy("row").agg(F.collect_list(F.struct("start", "length", "place")).alias("pieces"))
    return tokens.select("row", "doc_id", "queue", "n", "ids").join(places, "row").select("doc_id", "queue", "n", "ids", "pieces").mapInArrow(_cut(window), PIECES)
