"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Every text becomes a bag of five-word shingles, weighted tf * idf with
   idf = ln((N + 1) / (max(df, floor) + 1)) + 1. All documents are counted, into
   two rows of BUCKETS counters by two hashes, and the smaller count holds
   (count-min). A counter has S / BUCKETS others in it on average, S being all
   shingles; the floor is FLOOR times that, so collisions move no idf by more than
   a few hundredths, at every size, and the table's size is fixed.
2. Improved consistent weighted sampling draws ROWS * BANDS samples of every
   bag: two bags draw the same sample with a probability equal to their weighted
   Jaccard similarity. A band is the hash of ROWS samples. At similarity 0.8 a
   pair shares no band with probability 0.0018, at 0.9 with 0.000006.
3. Equal texts are one node. In each bucket (nodes with an equal band) the node
   with most company leads, and each (leader, member) pair is verified once by
   the weighted Jaccard similarity of the whole bags, so a bucket of n like
   copies costs n - 1 pairs. Members that pass are in the leader's class. No
   link among the others is lost:

   Let x and y be members of leader l, D(x, y) the sum of all differences of
   weights, and W a bag's weight. Similar pairs have D(x, y) <= c (W(x) + W(y)),
   c = far / (2 - far), far = 1 - SIMILAR. The deviations of x are what it has
   beyond l and what it lacks of l; x and y share S of them, and
   D(x, y) = D(x, l) + D(y, l) - 2 S. So if x failed, D(x, l) > c (W(x) + W(l)),
   a link needs S >= D(y, l) / 2 - c (W(y) - W(l)) / 2: y shares nearly half of
   its deviations with x. Ordered by how few have them, one shared deviation must
   be among the first of both, those before which at least the needed weight
   is left (prefix filtering).
   - Both failed: those leave first of which too much is deviations that no
     other has. A group of at most FEW nodes with ROOM deviations is compared in
     one task. Nodes of a larger one that share such a deviation are a new bucket
     with its own leader, and so on until no bucket is left.
   - x failed and y passed: only where sim(x, l) >= 0.6 (1 - similarity is a
     metric), and where at the deviation they share enough is left of both
     (positional filtering). These pairs are verified too, if their nodes are not
     in one class anyway.
4. Classes are the connected components (large star, small star); the smallest
   doc_id names a class and stays.

All per-document state lives in tables; the driver sees the table of idf, counts
and nothing else. Leaders are found by partial aggregation;
a hot bucket or text meets only joins that adaptive execution can split.

Defined results: a null text counts as empty; texts without words are like only
equal texts; a text of one to four words is one shingle; a row without doc_id
is alone and has no class; rows that repeat an id are documents of their own,
unless their texts are equal too (then all get the same result); an empty
table gives no rows; other columns are ignored. Shingles are told apart by 48
bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry.llm.common import forget, materialise, whole

SIZE, SIMILAR, BANDS, ROWS = 5, 0.8, 12, 4
BUCKETS, BLOCK, FLOOR = 1 << 19, 1 << 14, 16
CHUNK_BYTES = 1 << 19
NEAR = 1 - 1e-9  # room for rounding: bounds keep what they only just exclude
FEW, ROOM, PEELS = 2048, 4 << 20, 2  # as many that failed under a leader, with as many deviations, are compared in one task; of more, deviations are joined


class Weights(NamedTuple):
    """idf by bucket, for two hashes of a shingle; the rarer bucket counts."""

    one: np.ndarray
    two: np.ndarray

    def of(self, shingles: np.ndarray) -> np.ndarray:
        a, b = _buckets(shingles, len(self.one))
        return np.maximum(self.one[a], self.two[b])


def _buckets(shingles: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(size - 1)
    return (shingles & low).view(np.int64), ((shingles >> np.uint64(24)) & low).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a few hundred rows or about CHUNK_BYTES of text."""
    for batch in batches:
        a, n = 0, 0
        sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch["text"]]
        for i, s in enumerate(sizes):
            n += s
            if n >= CHUNK_BYTES or i + 1 == len(sizes):
                yield batch.slice(a, i + 1 - a)
                a, n = i + 1, 0


def bags(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, 48-bit shingle, times), ordered by text and shingle."""
    from beaconry.llm.textvec import shingles

    doc, h = shingles(texts, size)
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), times


def weights(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> Weights:
    """The idf of all shingles, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, buckets), np.int64)
        for b in _chunks(batches):
            for row, at in zip(found, _buckets(bags(b["text"].to_pylist(), size)[1], buckets)):
                row += np.bincount(at, minlength=buckets)
        yield from _blocks(enumerate(found.reshape(-1, BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b["block"].to_pylist(), b["n"]):
                n = np.frombuffer(n.as_py(), np.int64)
                found[k] = found[k] + n if k in found else n
        yield from _blocks(found.items())

    # Each task sends its counters as a few dozen rows, whatever it read; sums are made while they stream in.
    rows = docs.select(whole().alias("text")).mapInArrow(count, "block int, n binary").repartition("block").mapInArrow(add, "block int, n binary")
    df = np.zeros(2 * buckets, np.int64)
    for k, n in zip(*(c.to_pylist() for c in rows.toArrow().columns)):  # 2 * buckets counters
        df[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(n, np.int64)
    n, floor = docs.count(), max(1.0, df.sum() / 2 / (buckets / FLOOR))
    idf = (np.log((n + 1) / (np.clip(df, floor, max(n, floor)) + 1)) + 1).astype(np.float32)
    return Weights(idf[:buckets], idf[buckets:])


def _blocks(found) -> Iterator[pa.RecordBatch]:
    for k, n in found:
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["block", "n"])


FINE, COARSE = 14, 8  # bits of c, and of r and b each
_TAIL = 24


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) (r, 1 / r at 2**COARSE levels and ln c at 2**FINE) and of U(0, 1) at 2**COARSE levels."""

    def gamma(levels: int) -> tuple[np.ndarray, np.ndarray]:
        u = (np.arange(levels) + 0.5) / levels
        lo, hi = np.zeros(levels), np.full(levels, 60.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - np.exp(-x) * (1 + x) < u
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        return x, u

    r, u = gamma(1 << COARSE)
    return r, 1 / r, np.log(gamma(1 << FINE)[0]), u


@lru_cache(maxsize=8)
def _common(ln: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a weight: the places of ln c, and those of what is taken off for each (r, b)."""
    r, inv, lc, beta = _variates()
    t = np.floor(ln * inv[:, None] + beta[None, :])
    off = r[:, None] * (t - beta[None, :] + 1)
    return np.round((lc + 100) * (1 << 20)).astype(np.int64) << _TAIL, np.round(off.reshape(-1) * (1 << 20)).astype(np.int64) << _TAIL


def samples(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples (rows) of each bag (columns); bags begin at `first` and are not empty.

    A shingle's r, b and c come from one multiplication of its hash (multiply-shift).
    What they give for the most frequent weight stands in a table.
    """
    r, inv, lc, beta = _variates()
    out = np.empty((k, len(first)), np.int64)
    ln = np.log(weight.astype(np.float32))
    values, counts = np.unique(ln, return_counts=True)
    usual = values[np.argmax(counts)]
    fine, off = _common(float(usual))
    other = np.flatnonzero(ln != usual)
    lo = ln[other].astype(float)
    x, y, at = np.empty(len(shingle), np.uint64), np.empty(len(shingle), np.int64), np.empty(len(shingle), np.uint64)
    for j in range(k):
        np.multiply(shingle, _odd(j), out=x)
        np.right_shift(x, np.uint64(64 - 2 * COARSE), out=at)
        rb = at.view(np.int64)[other]
        np.take(off, at.view(np.int64), out=y, mode="clip")
        np.right_shift(x, np.uint64(64 - 2 * COARSE - FINE), out=at)
        np.bitwise_and(at, np.uint64((1 << FINE) - 1), out=at)
        np.subtract(fine[at.view(np.int64)], y, out=y)
        if len(other):
            i, b = rb >> COARSE, beta[rb & ((1 << COARSE) - 1)]
            own = r[i] * (np.floor(lo * inv[i] + b) - b + 1)
            y[other] = fine[at.view(np.int64)[other]] - (np.round(own * (1 << 20)).astype(np.int64) << _TAIL)
        np.bitwise_and(x, np.uint64((1 << _TAIL) - 1), out=x)
        np.add(y, x.view(np.int64), out=y)
        out[j] = np.minimum.reduceat(y, first)
    return out.view(np.uint64)


@lru_cache(maxsize=4096)
def _odd(j: int) -> np.uint64:
    """The j-th sample's odd factor."""
    from beaconry.llm.textvec import mix

    return mix(np.array([j + 1], np.uint64) * np.uint64(0x632BE59BD9B4E019))[0] | np.uint64(1)


def band_keys(texts: list[str], idf: Weights, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> list[np.ndarray | None]:
    """The 64-bit band keys of each text, None where it has no words."""
    from beaconry.llm.textvec import mix

    doc, sh, times = bags(texts, size)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not len(doc):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    got = samples(sh, times * idf.of(sh), first, bands * rows)
    keys = np.empty((bands, len(first)), np.uint64)
    for j in range(bands):
        x = np.full(len(first), j + 1, np.uint64)
        for i in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + got[j * rows + i])
        keys[j] = x
    for n, d in enumerate(doc[first]):
        out[d] = keys[:, n].view(np.int64)
    return out


def _digest() -> Column:
    return F.unhex(F.sha2(whole(), 256))


def sketches(docs: DataFrame, idf: Weights, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """row, doc_id, digest, bands (empty where there are no words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            keys = band_keys(b["text"].to_pylist(), idf, bands, rows, size)
            keys = pa.array([[] if x is None else x for x in keys], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["digest"], keys], ["row", "doc_id", "digest", "bands"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), whole().alias("text"))
    return source.mapInArrow(run, "row long, doc_id long, digest binary, bands array<long>")


def bag_table(docs: DataFrame, nodes: DataFrame, idf: Weights, size: int = SIZE) -> DataFrame:
    """node, h (ascending shingles, unsigned 64-bit), w (their weights, 32-bit floats) of the nodes (node, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            doc, sh, times = bags(b["text"].to_pylist(), size)
            w = (times * idf.of(sh)).astype(np.float32)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            parts = list(zip(at, at[1:]))
            h, w = ([x[p:q].tobytes() for p, q in parts] for x in (sh, w))
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(h, pa.binary()), pa.array(w, pa.binary())], ["node", "h", "w"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), whole().alias("text")).join(nodes, ["doc_id", "digest"])
    return rows.select("node", "text").mapInArrow(run, "node long, h binary, w binary").dropDuplicates(["node"])


Bag = tuple[np.ndarray, np.ndarray]


def compared(x: Bag, y: Bag) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted Jaccard similarity of two bags; x's deviations from y: keys (odd where x lacks something) and weights."""
    (h, w), (g, v) = x, y
    w, v = w.astype(float), v.astype(float)
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    both = np.minimum(w[i], v[j])
    common = both.sum()
    sim = float(common / (w.sum() + v.sum() - common))
    w[i] -= both
    v[j] -= both
    more, less = w > 0, v > 0
    keys = np.concatenate([h[more] << np.uint64(1), (g[less] << np.uint64(1)) | np.uint64(1)])
    return sim, keys.view(np.int64), np.concatenate([w[more], v[less]])


JUDGED = "a long, b long, sim double, wa double, wb double, d double, keys array<long>, devs array<double>"


def judge(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """a, b, sim, weights of both bags, b's deviations from a (keys, devs; d is their sum) of the pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda h, w: (np.frombuffer(h.as_py(), np.uint64), np.frombuffer(w.as_py(), np.float32))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                c = whole_batch.slice(at, 256)
                out = []
                for ha, wa, hb, wb in zip(c["ha"], c["wa"], c["hb"], c["wb"]):
                    x, y = read(hb, wb), read(ha, wa)
                    sim, keys, devs = compared(x, y)
                    out.append((sim, float(y[1].astype(float).sum()), float(x[1].astype(float).sum()), float(devs.sum()), keys, devs))
                sim, wa, wb, d, keys, devs = zip(*out)
                columns = [pa.array(sim), pa.array(wa), pa.array(wb), pa.array(d), pa.array(keys, pa.list_(pa.int64())), pa.array(devs, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([c["a"], c["b"], *columns], ["a", "b", "sim", "wa", "wb", "d", "keys", "devs"])

    side = lambda df, s: df.select(F.col("node").alias(s), F.col("h").alias(f"h{s}"), F.col("w").alias(f"w{s}"))
    leaders = bag.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")  # few bags lead: only they are dealt out again
    return pairs.join(side(bag, "b"), "b").join(side(leaders, "a"), "a").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, JUDGED)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) from edges (a, b), by alternating large and small stars."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = size
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        forget(large)
        forget(edges)
        edges = new


def _rest(by: list[str], rank: str, w: str) -> Column:
    """Weight of a row and of those after it, the ones that the fewest have first."""
    return F.sum(w).over(Window.partitionBy(*by).orderBy(rank, "key").rowsBetween(0, Window.unboundedFollowing))


def _needed(c: float) -> Column:
    """Least weight of deviations that b shares with anything that failed under a and is similar to b."""
    return (F.col("d") / 2 - (F.col("wb") - F.col("wa")) * (c / 2)) * NEAR


def _spread(judged: DataFrame) -> DataFrame:
    return judged.select("a", "b", "wa", "wb", "d", F.explode(F.arrays_zip("keys", "devs")).alias("x")).select("a", "b", "wa", "wb", "d", F.col("x.keys").alias("key"), F.col("x.devs").alias("w"))


def peeled(rows: DataFrame, c: float, similar: float) -> DataFrame:
    """The rows of _spread() of those b that may be similar to another b of the same a.

    More than 1 - similar of b's weight must not be deviations beyond a that it
    has alone, and what it shares with any other must reach what is needed.
    """
    held = rows.groupBy("a", "key").agg(F.count("*").alias("held"))
    alone, shared = (F.sum(F.when(when, F.col("w")).otherwise(0.0)) for when in ((F.col("held") == 1) & (F.col("key").bitwiseAND(1) == 0), F.col("held") > 1))
    sums = rows.join(held, ["a", "key"]).groupBy("a", "b", "wa", "wb", "d").agg(alone.alias("alone"), shared.alias("shared"))
    keep = sums.filter((F.col("alone") * NEAR <= F.col("wb") * (1 - similar)) & (F.col("shared") >= _needed(c))).select("a", "b")
    out = materialise(rows.join(keep, ["a", "b"], "left_semi"), "deviations")
    forget(rows)
    return out


def candidates(failed: DataFrame, c: float, similar: float, few: int) -> tuple[DataFrame, DataFrame]:
    """Of what failed (judge()'s rows) under the same leader: links among groups that fit a task, and new buckets (band, node) of larger ones."""
    size = failed.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.size("keys")).alias("room")).filter("n > 1")
    size = materialise(size.select("a", ((F.col("n") <= few) & (F.col("room") <= ROOM)).alias("fits")), "groups")
    links = materialise(among(failed.join(size.filter("fits").select("a"), "a"), c, similar), "links")
    large = size.filter("NOT fits").select("a")
    if large.isEmpty():
        return links, large.select(F.col("a").alias("band"), F.col("a").alias("node"))
    rows = materialise(_spread(failed.join(large, "a", "left_semi")), "deviations")
    for _ in range(PEELS):
        rows = peeled(rows, c, similar)
    held = rows.groupBy("a", "key").agg(F.count("*").alias("held")).filter("held > 1")
    rest = rows.join(held, ["a", "key"]).withColumn("rest", _rest(["a", "b"], "held", "w"))
    found = rest.filter(F.col("rest") >= _needed(c)).select(F.xxhash64("a", "key").alias("band"), F.col("b").alias("node"))
    out = materialise(crowded(found), "buckets")
    forget(rows)
    forget(size)
    return links, out


class Member(NamedTuple):
    node: int
    weight: float
    needed: float
    keys: np.ndarray
    devs: np.ndarray


def connected(own: list[Member], similar: float) -> Iterator[tuple[int, int]]:
    """Links that connect the similar members of one group: all pairs that aren't connected yet and may be similar.

    With W the sum of two weights and D = d(x) + d(y) - 2 S the sum of their
    differences, weighted Jaccard similarity is (W - D) / (W + D).
    """
    for _ in range(PEELS):  # as peeled() does
        if len(own) < 2:
            return
        of = np.repeat(np.arange(len(own)), [len(m.keys) for m in own])
        keys, devs = np.concatenate([m.keys for m in own]), np.concatenate([m.devs for m in own])
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        held = times[at]
        alone = np.bincount(of, devs * ((held == 1) & (keys & 1 == 0)), len(own)).tolist()
        shared = np.bincount(of, devs * (held > 1), len(own)).tolist()
        own = [m for m, x, y in zip(own, alone, shared) if x * NEAR <= m.weight * (1 - similar) and y >= m.needed]
    own.sort(key=lambda m: m.weight)
    d, root = [float(m.devs.sum()) for m in own], list(range(len(own)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(own):
        for j in range(i + 1, len(own)):
            y = own[j]
            if x.weight < y.weight * similar * NEAR:
                break
            if find(i) == find(j):
                continue
            _, p, q = np.intersect1d(x.keys, y.keys, assume_unique=True, return_indices=True)
            apart, both = d[i] + d[j] - 2 * np.minimum(x.devs[p], y.devs[q]).sum(), x.weight + y.weight
            if both - apart >= similar * (both + apart):
                root[find(i)] = find(j)
                yield x.node, y.node


def among(failed: DataFrame, c: float, similar: float) -> DataFrame:
    """Links (a, b) that connect the similar nodes b of each group a, each of which fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, w, need, keys, devs in zip(*(batch[k].to_pylist() for k in ("a", "b", "wb", "needed")), batch["keys"], batch["devs"]):
                if a != group:
                    out += connected(own, similar)
                    group, own = a, []
                own.append(Member(b, w, need, keys.values.to_numpy(), devs.values.to_numpy()))
            yield _pairs(out)
        yield _pairs(list(connected(own, similar)))

    rows = failed.select("a", "b", "wb", _needed(c).alias("needed"), "keys", "devs")
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def crowded(members: DataFrame) -> DataFrame:
    """band, node of the buckets that have two nodes or more."""
    some = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    return members.join(some, "band").select("band", "node")


def crossing(told: DataFrame, root: DataFrame, c: float, similar: float) -> DataFrame:
    """Pairs (a, b) of what failed and what passed under the same leader that may be similar and aren't in one class."""
    loose = (1 - 2 * (1 - similar)) * NEAR
    named = lambda df, x: df.join(root.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    doubtful = named(named(told.filter((F.col("sim") < similar) & (F.col("sim") >= loose)), "a"), "b").filter("ra <> rb").drop("ra")
    x = materialise(doubtful, "doubtful")
    passed = told.filter((F.col("sim") >= similar) & (F.col("d") > 0)).join(x.select("a").distinct(), "a", "left_semi")
    ids = x.select("a", "b", "rb").distinct()
    xs, ys = _spread(x), _spread(passed)
    hx, hy = (r.groupBy("a", "key").agg(F.count("*").alias(f"h{k}")) for k, r in (("x", xs), ("y", ys)))
    held = materialise(hx.join(hy, ["a", "key"]).select("a", "key", (F.col("hx") + F.col("hy")).alias("held")), "shared")

    def prefix(rows: DataFrame, need: Column, s: str) -> DataFrame:
        rows = rows.join(held, ["a", "key"]).withColumn("rest", _rest(["a", "b"], "held", "w")).filter(F.col("rest") >= need)
        return rows.select("a", "key", *(F.col(k).alias(f"{k}{s}") for k in ("b", "wb", "d", "rest")))

    failed_need = (F.col("d") - (F.col("wa") + F.col("wb")) * c) / 2 * NEAR
    met = prefix(xs, failed_need, "x").join(prefix(ys, _needed(c), "y"), ["a", "key"])
    left = (F.col("dx") + F.col("dy") - (F.col("wbx") + F.col("wby")) * c) / 2 * NEAR
    pairs = met.filter(F.least("restx", "resty") >= left).select("a", F.col("bx").alias("b"), F.col("by").alias("y")).distinct()
    pairs = pairs.join(ids, ["a", "b"]).select(F.col("b").alias("x"), "y", F.col("rb").alias("rx"))
    out = materialise(named(pairs, "y").filter("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cross")
    forget(x)
    forget(held)
    return out


def near_links(docs: DataFrame, nodes: DataFrame, marks: DataFrame, idf: Weights, similar: float = SIMILAR, size: int = SIZE, few: int = FEW) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each class; marks: node, band; nodes: node, doc_id, digest."""
    c = (1 - similar) / (1 + similar)
    active = materialise(crowded(marks), "buckets")
    bag = materialise(bag_table(docs, nodes.join(active.select("node").distinct(), "node", "left_semi"), idf, size), "bags")
    counts = active.groupBy("band").agg(F.count("*").alias("n"))
    company = materialise(active.join(counts, "band").groupBy("node").agg(F.sum("n").alias("company")), "company")
    told: list[DataFrame] = []
    links: list[DataFrame] = []
    while not active.isEmpty():
        lead = active.join(company, "node").groupBy("band").agg(F.max(F.struct("company", (-F.col("node")).alias("least"))).alias("m"))
        met = active.join(lead.select("band", (-F.col("m.least")).alias("a")), "band").filter("a <> node")
        pairs = materialise(met.select("a", F.col("node").alias("b")).distinct(), "pairs")  # once, however many buckets they meet in
        judged = materialise(judge(pairs, bag), "judged")
        forget(pairs)
        forget(active)
        more, active = candidates(judged.filter(F.col("sim") < similar), c, similar, few)
        told.append(judged)
        links += [judged.filter(F.col("sim") >= similar).select("a", "b"), more]
    if not told:
        return marks.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    everything = reduce(DataFrame.union, told)
    found = materialise(reduce(DataFrame.union, links).distinct(), "links")
    root = components(found)
    cross = crossing(everything, root, c, similar)
    more = materialise(judge(cross, bag).filter(F.col("sim") >= similar).select("a", "b"), "links")
    for df in (*told, bag, company, cross, root):
        forget(df)
    return found.union(more)


def dedup(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """doc_id, class_id (its smallest doc_id), kept, text_sha256 of every row (see the module's text)."""
    idf = weights(docs, size, buckets)
    rows_ = materialise(sketches(docs, idf, bands, rows, size), "sketches")
    texts = rows_.filter("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    nodes = materialise(texts.select("digest", F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias("node")), "nodes")
    marks = rows_.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi")
    links = near_links(docs, nodes, marks.select("node", F.explode("bands").alias("band")), idf, similar, size, few)
    root = components(links)
    named = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A class is named by its smallest doc_id; of texts that share that id, the one of the least digest stays.
    least = root.join(nodes, "node").select("root", "doc_id", "digest").union(root.select(F.col("root").alias("node"), "root").distinct().join(nodes, "node").select("root", "doc_id", "digest"))
    least = least.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("digest", F.struct("doc_id", "digest")).alias("stays"))
    named = materialise(named.join(least, "root", "left").select("digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("stays", "digest").alias("stays")), "classes")
    out = rows_.select("doc_id", "digest").join(named, "digest", "left")
    alone = F.col("doc_id").isNull()
    kept = alone | ((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("stays")))
    return out.select("doc_id", F.when(~alone, F.col("class_id")).alias("class_id"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
