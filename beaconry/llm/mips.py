"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are turned into integers (floor(scale * x)). Queries go out in batches
of a fixed size, each against all rows: a task reads its vectors in the order
of descending length and keeps, for every query of the batch, the k best so far.
The k-th best score is a threshold that only grows, and what can't reach it is
left out without loss:

* a whole block of vectors if |q| * (length of its first vector) is below it;
* a vector if the partial product over the first HEAD rotated dimensions plus
  |rest of q| * |rest of v| is below it.

The rotation holds the right singular vectors of the integer matrix, from its
d x d Gram matrix, so the first dimensions carry most of every product. The
thresholds start from the `seeds` longest vectors of the table, whose size is
fixed. Survivors are scored exactly in 64-bit integers.

Vectors are never shuffled; a task sends on at most k rows a query, and only
those that reach the common threshold. Ties go to the smaller id everywhere.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; a query's own id is
never among its results; rows that repeat a query's id are one query, the one
with the smallest components; of repeated candidate rows each counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry.llm.common import materialise

HEAD, SEEDS, BATCH, ROWS = 16, 2048, 8192, 4096


def integers(rows: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of long), norm of the rows that take part."""
    double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(double, lambda x: F.floor(x * scale).cast("long"))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))


def _matrix(v: pa.Array, d: int) -> np.ndarray:
    flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    n = len(at) - 1
    if len(flat) == n * d and (np.diff(at) == d).all():
        return flat.reshape(n, d).astype(np.int64)
    out = np.zeros((n, d), np.int64)
    at = at - at[0]
    for i in range(n):
        out[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors (columns, largest first) of the matrix of all vectors."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b["v"], d).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    got = rows.select("v").mapInArrow(gram, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # d * d rows
    total = np.zeros(d * d)
    for r in got:
        total[r["at"]] = r["x"]
    total = total.reshape(d, d)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1] if np.isfinite(total).all() else np.eye(d)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)

    def threshold(self) -> np.ndarray:
        own = np.where(self.full >= self.k, self.score[:, -1].astype(float), -np.inf)
        return np.maximum(own, self.floor)

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(q):
            return
        own = np.unique(q)
        held = self.full[own]
        old = np.repeat(own, held)
        col = np.arange(len(old)) - np.repeat(np.cumsum(held) - held, held)
        q, score, id_ = np.concatenate([old, q]), np.concatenate([self.score[old, col], score]), np.concatenate([self.id[old, col], id_])
        order = np.lexsort((id_, -score, q))
        q, score, id_ = q[order], score[order], id_[order]
        first = np.searchsorted(q, own)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        ok = rank < self.k
        self.score[q[ok], rank[ok]], self.id[q[ok], rank[ok]] = score[ok], id_[ok]
        self.full[own] = np.minimum(self.k, np.diff(np.append(first, len(q))))


def search(ids: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], turn: np.ndarray, k: int, floor: np.ndarray, head: int = HEAD) -> Best:
    """The k best of each query among blocks (ids, vectors) that come by descending length."""
    best = Best(len(ids), k, floor)
    qr = queries @ turn
    qn = np.sqrt((queries.astype(float) ** 2).sum(1))
    qh, qt = qr[:, :head], np.sqrt(np.maximum(0, (qr[:, head:] ** 2).sum(1)))
    for own, m in blocks:
        vr = m @ turn
        vn = np.sqrt((m.astype(float) ** 2).sum(1))
        slack = 1e-9 * (qn * vn.max() + 1) if len(vn) else qn
        live = np.flatnonzero(qn * vn.max() + slack >= best.threshold()) if len(vn) else ()
        vh, vt = np.ascontiguousarray(vr[:, :head].T), np.sqrt(np.maximum(0, (vr[:, head:] ** 2).sum(1)))
        for a in range(0, len(live), 256):
            q = live[a : a + 256]
            bound = qh[q] @ vh
            bound += np.multiply.outer(qt[q], vt)
            hit, v = np.nonzero(bound + slack[q][:, None] >= best.threshold()[q][:, None])
            for c in range(0, len(hit), 1 << 15):
                h, w = q[hit[c : c + (1 << 15)]], v[c : c + (1 << 15)]
                other = own[w] != ids[h]
                h, w = h[other], w[other]
                best.add(h, np.einsum("ij,ij->i", queries[h], m[w]), own[w])
    return best


def top(rows: DataFrame, queries: DataFrame, k: int = 5, batch: int = BATCH, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score; both tables as integers() gives them."""
    rows = materialise(rows, "vectors")
    d = rows.agg(F.max(F.size("v"))).first()[0] or 1
    turn = rotation(rows, d)
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "v").toArrow().combine_chunks()
    queries = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    count = queries.count()
    column = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    sid, sm = column(longest, "vec_id").to_numpy(), _matrix(column(longest, "v"), d)
    found = []
    for part in range(-(-count // batch)):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // batch))) == part).orderBy("vec_id").toArrow()  # about `batch` rows
        ids, qm = column(got, "vec_id").to_numpy(), _matrix(column(got, "v"), d)
        first = search(ids, qm, iter([(sid, sm)]), turn, k, np.full(len(ids), -np.inf))
        floor = first.threshold()

        def run(batches: Iterator[pa.RecordBatch], ids=ids, qm=qm, floor=floor) -> Iterator[pa.RecordBatch]:
            blocks = ((b["vec_id"].slice(a, ROWS).to_numpy(), _matrix(b["v"].slice(a, ROWS), d)) for b in batches for a in range(0, b.num_rows, ROWS))
            best = search(ids, qm, blocks, turn, k, floor)
            q, col = np.nonzero(np.arange(k)[None, :] < best.full[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.id[q, col]), pa.array(best.score[q, col])], ["query_id", "vec_id", "score"])

        sorted_ = rows.sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "v")
        found.append(sorted_.mapInArrow(run, "query_id long, vec_id long, score long"))
        if count > batch:
            found[-1] = materialise(found[-1], "found")
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.union(x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
