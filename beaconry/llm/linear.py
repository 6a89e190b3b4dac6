"""Linear models over n-gram indicators that are scaled by naive Bayes log-count ratios.

Shared by the quality classifier and the toxicity chain. Training rows are a
bounded sample of labelled documents (ordered by a hash of the id); n-grams are
counted by class on the executors and only the `features` best come to the
driver, where a linear model of squared hinge loss is fitted by dual coordinate descent.
A fitted model is a table of fixed size that scores a text in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise, whole

Ngrams = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
LOW = np.uint64((1 << 48) - 1)
CHUNK = 1 << 19


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 48-bit n-gram), each once."""
    key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h & LOW))
    return (key >> np.uint64(48)).astype(np.int64), key & LOW


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters (or one longer text), with the first one's number."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK or i + 1 == len(texts) or i - a >= 20_000:
            yield a, texts[a : i + 1]
            a, n = i + 1, 0


class Table:
    """Looks n-grams up: number of each, or -1. Features that meet in one slot: the first stays."""

    def __init__(self, hashes: np.ndarray, bits: int = 19):
        self.mask = np.uint64((1 << bits) - 1)
        at = (hashes & self.mask).astype(np.int64)[::-1]
        self.number = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)
        self.number[at] = np.arange(len(hashes), dtype=np.int32)[::-1]
        self.key[at] = hashes[::-1]

    def rows(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, ordered."""
        h = h & LOW
        at = (h & self.mask).astype(np.int64)
        ok = self.key[at] == h
        ok &= self.number[at] >= 0
        pair = np.unique(doc[ok].astype(np.int64) << 32 | self.number[at[ok]])
        return pair >> 32, pair & 0xFFFFFFFF


class Sample:
    """Labelled texts as features: rows[i] are the numbers of text i's features; labels is a matrix, a column a label."""

    def __init__(self, table: Table, hashes: np.ndarray, rows: list[np.ndarray], labels: np.ndarray):
        self.table, self.hashes, self.rows, self.labels = table, hashes, rows, labels


def sample(docs: DataFrame, labelled: DataFrame, labels: list[str], by: str, ngrams: Ngrams, rows: int, features: int, least: int = 3) -> Sample:
    """Features by class ratio of label `by`, from at most `rows` rows of labelled(doc_id, *labels)."""
    chosen = labelled.filter(" AND ".join(f"{x} IS NOT NULL" for x in ["doc_id", *labels])).dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")  # `rows` rows are sent at most
    texts = materialise(texts.select("doc_id", "text", *labels), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b[by].to_pylist(), np.int64)
            for a, part in chunks(b["text"].to_pylist()):
                doc, h = distinct(*ngrams(part))
                h, at = np.unique(h, return_inverse=True)
                pos = np.bincount(at, y[a + doc], len(h)).astype(np.int64)
                all_ = np.bincount(at, minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(pos), pa.array(all_.astype(np.int64))], ["h", "pos", "n"])

    size = {r[0]: r[1] for r in texts.groupBy(by).count().collect()}
    one, zero = size.get(1, 0), size.get(0, 0)
    ratio = F.abs(F.log((F.col("pos") + 1) / (one + 2.0)) - F.log((F.col("n") - F.col("pos") + 1) / (zero + 2.0)))
    found = texts.select("text", F.col(by).cast("int").alias(by)).mapInArrow(count, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    best = found.filter(F.col("n") >= least).select("h", (ratio * F.log1p("n")).alias("s")).orderBy(F.desc("s"), "h").limit(features).toArrow()
    hashes = best["h"].to_numpy().astype(np.uint64)
    table = Table(hashes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, part in chunks(b["text"].to_pylist()):
                doc, f = table.rows(*ngrams(part))
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                own = [f[x:y].astype(np.int32).tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(a, len(part)), pa.array(own, pa.binary()), *(b[x].slice(a, len(part)) for x in labels)], ["doc_id", "own", *labels])

    ints = texts.select("doc_id", "text", *(F.col(x).cast("int").alias(x) for x in labels))
    got = ints.mapInArrow(encode, f"doc_id {dict(texts.dtypes)['doc_id']}, own binary, " + ", ".join(f"{x} int" for x in labels)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = np.array([got[x].to_pylist() for x in labels], np.int64).T.reshape(-1, len(labels))
    return Sample(table, hashes, [np.frombuffer(x.as_py(), np.int32) for x in got["own"]], y)


def ratios(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Log ratio of each feature's smoothed shares in the two classes."""
    p, q = np.ones(n), np.ones(n)
    for x, one in zip(rows, y):
        (p if one else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features, of dense columns and of the constant: squared hinge loss, dual coordinate descent.

    A row is its features' ratios, scaled to unit length, its dense columns and the constant 1.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    xs = []
    for x in rows:
        v = r[x]
        xs.append(v / max(1e-9, np.sqrt(v @ v)))
    w, u, bias = np.zeros(len(r)), np.zeros(dense.shape[1]), 0.0
    alpha = np.zeros(len(rows))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    diag = 1 / (2 * c * weight)
    square = np.array([v @ v for v in xs]) + (dense * dense).sum(1) + 1 + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], xs[i]
            g = sign[i] * (w[x] @ v + u @ dense[i] + bias) - 1 + diag[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(0.0, alpha[i] - g / square[i])
            step = (new - alpha[i]) * sign[i]
            worst = max(worst, abs(g))
            alpha[i] = new
            w[x] += step * v
            u += step * dense[i]
            bias += step
        if worst < 1e-3:
            break
    return w, u, bias


def margins(rows: list[np.ndarray], dense: np.ndarray, r: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    w, u, bias = model
    out = dense @ u + bias
    for i, x in enumerate(rows):
        v = r[x]
        out[i] += w[x] @ v / max(1e-9, np.sqrt(v @ v))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(m: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is the probability of label 1; Platt's smoothed targets, Newton's method."""
    one, zero = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (one + 1) / (one + 2), 1 / (zero + 2))
    a, b = 1.0, float(np.log((one + 1) / (zero + 1)))
    for _ in range(rounds):
        p = sigmoid(a * m + b)
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ m, d.sum()]) + 1e-6 * np.array([a, 0])
        h = np.array([[s @ (m * m) + 1e-6, s @ m], [s @ m, s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


class Link:
    """One fitted classifier; probabilities of earlier links may be its dense columns."""

    def __init__(self, s: Sample, y: np.ndarray, dense: np.ndarray, folds: int = 3, c: float = 1.0):
        n = len(s.hashes)
        self.dense = dense.shape[1]
        self.constant = None
        self.out_of_fold = np.full(len(y), float(y.mean()) if len(y) else 0.5)
        self.scaled, self.u, self.bias, self.a, self.b = np.zeros(n, np.float32), np.zeros(self.dense), 0.0, 1.0, 0.0
        self.r = np.zeros(n, np.float32)
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        m = np.zeros(len(y))
        fold = np.arange(len(y)) % folds
        for k in range(folds):
            tr, te = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            r = ratios([s.rows[i] for i in tr], y[tr], n)
            model = descend([s.rows[i] for i in tr], dense[tr], y[tr], r, c)
            m[te] = margins([s.rows[i] for i in te], dense[te], r, model)
        self.a, self.b = platt(m, y)
        self.out_of_fold = sigmoid(self.a * m + self.b)
        r = ratios(s.rows, y, n)
        w, self.u, self.bias = descend(s.rows, dense, y, r, c)
        self.scaled, self.r = (w * r).astype(np.float32), r.astype(np.float32)

    def score(self, doc: np.ndarray, f: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probability of each text, from its (text, feature) pairs."""
        n = len(dense)
        if self.constant is not None:
            return np.full(n, self.constant)
        length = np.sqrt(np.bincount(doc, self.r[f].astype(float) ** 2, n))
        m = np.bincount(doc, self.scaled[f].astype(float), n) / np.maximum(1e-9, length)
        return sigmoid(self.a * (m + dense @ self.u + self.bias) + self.b)


def scores(texts: list[str], ngrams: Ngrams, table: Table, links: list[Link]) -> np.ndarray:
    """A column of probabilities for each link, each fed with those before it."""
    out = np.zeros((len(texts), len(links)))
    for a, part in chunks(texts):
        doc, f = table.rows(*ngrams(part))
        for k, link in enumerate(links):
            out[a : a + len(part), k] = link.score(doc, f, out[a : a + len(part), : link.dense])
    return out
