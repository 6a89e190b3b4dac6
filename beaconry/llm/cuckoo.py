"""Exact dedup over a cuckoo-filter index of text digests.

A cuckoo filter keeps a 16-bit fingerprint of every live key in one of two
buckets of four slots, so keys can be inserted, found and deleted. Beside each
slot lies the number of the stored key (digest, byte length, second checksum):
a fingerprint hit is only a candidate and is verified against the content key
kept in that bucket, so false positives never merge different texts. When an
insertion finds no room after MAX_KICKS moves, the table doubles and is filled
again from the stored keys.

On Spark the index is sharded by digest. Copies are first aggregated under a
salt of their doc_id (a text that is a third of the corpus gives at most SALT
rows to its shard), then every partition feeds its own index; the result, one
row per class, is joined back to the compact rows, where adaptive execution can
split a hot class. Texts are read once and never shuffled: about 60 bytes a row
are. `build_index` and `update_index` keep an index as a table for later rounds
of insertions and deletions.

Defined results: a null text counts as empty, and all empty texts are equal;
of equal texts the largest doc_id stays (null ids last; of rows that repeat an
id, one); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise, whole

SLOTS = 4
MAX_KICKS = 200
SALT = 16


class CuckooIndex:
    """Live keys (bytes of 16 and more, uniformly distributed) with insertion, lookup, deletion and resizing."""

    def __init__(self, buckets: int = 256):
        self.keys: dict[int, bytes] = {}
        self.next = 0
        self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.owner = array("q", bytes(8 * SLOTS * buckets))

    def __len__(self) -> int:
        return len(self.keys)

    def _at(self, key: bytes) -> tuple[int, int, int]:
        a, p = struct.unpack_from("<QH", key)
        p = p ^ (a >> 48) or 1
        a = (a * 0x9E3779B97F4A7C15 >> 20) & self.mask
        return p, a, self._other(a, p)

    def _other(self, bucket: int, p: int) -> int:
        return bucket ^ ((p * 0x5BD1E995 >> 7) & self.mask)

    def _slot(self, key: bytes) -> int:
        p, a, b = self._at(key)
        for bucket in (a,) if a == b else (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[s] == p:
                    if self.keys[self.owner[s]] == key:
                        return s
                    self.false_hits += 1
        return -1

    def find(self, key: bytes) -> int:
        """The key's number, or -1."""
        s = self._slot(key)
        return -1 if s < 0 else self.owner[s]

    def insert(self, key: bytes) -> tuple[int, bool]:
        """(number, new)."""
        s = self._slot(key)
        if s >= 0:
            return self.owner[s], False
        number, self.next = self.next, self.next + 1
        self.keys[number] = key
        if not self._put(key, number):
            self.resize()
        return number, True

    def _put(self, key: bytes, number: int) -> bool:
        p, a, b = self._at(key)
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.owner[s] = p, number
                    return True
        bucket = b
        for kick in range(MAX_KICKS):
            s = bucket * SLOTS + (kick + p) % SLOTS
            self.prints[s], p = p, self.prints[s]
            self.owner[s], number = number, self.owner[s]
            bucket = self._other(bucket, p)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.owner[s] = p, number
                    return True
        return False  # the key moved out last is still among the stored keys

    def resize(self) -> None:
        """Doubles the table until all stored keys fit."""
        buckets = self.mask + 1
        done = False
        while not done:
            buckets *= 2
            self._clear(buckets)
            done = all(self._put(k, n) for n, k in self.keys.items())

    def delete(self, key: bytes) -> bool:
        s = self._slot(key)
        if s < 0:
            return False
        del self.keys[self.owner[s]]
        self.prints[s] = 0
        return True

    def dump(self) -> bytes:
        """The live keys, which are all that is needed to fill the table again."""
        return b"".join(struct.pack("<I", len(k)) + k for k in self.keys.values())

    @classmethod
    def load(cls, data: bytes) -> CuckooIndex:
        index, at = cls(), 0
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            index.insert(bytes(data[at + 4 : at + 4 + n]))
            at += 4 + n
        return index


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the content key (digest, bytes, check) of every row."""
    t = whole(text)
    return docs.select(
        F.col(key).alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("check")
    )


def _content_key(digest: bytes, n: int, check: int) -> bytes:
    return bytes(digest) + struct.pack("<iq", n, check)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One index shard: every partial row is looked up, verified and merged into its class."""
    index = CuckooIndex()
    rows: list[list] = []
    for pdf in batches:
        for digest, n, check, top, copies in zip(pdf.digest, pdf.bytes, pdf.check, pdf.top, pdf.copies):
            top = None if pd.isna(top) else int(top)
            number, new = index.insert(_content_key(digest, n, check))
            if new:
                rows.append([digest, n, check, top, copies])
                continue
            row = rows[number]
            row[4] += copies
            if row[3] is None or top is not None and top > row[3]:
                row[3] = top
    for a in range(0, len(rows), 10_000):
        out = pd.DataFrame(rows[a : a + 10_000], columns=["digest", "bytes", "check", "keep_id", "group_size"])
        yield out.astype({"keep_id": "Int64"})


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row (see the module's text)."""
    content = ["digest", "bytes", "check"]
    base = digests(docs, key, text)
    base = materialise(base.groupBy("doc_id", *content).agg(F.count("*").alias("times")), "digests")
    partial = base.groupBy(*content, F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("salt")).agg(F.max("doc_id").cast("long").alias("top"), F.sum("times").alias("copies"))
    classes = (
        partial.select(*content, "top", "copies").repartition("digest")
        .mapInPandas(_classes, "digest binary, bytes int, check long, keep_id long, group_size long")
    )
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return base.join(classes, content).withColumn("copy", copy).select(
        "doc_id", F.col("keep_id").cast(dict(base.dtypes)["doc_id"]).alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


_STATE = "shard int, state binary"


def _keys(docs: DataFrame, shards: int, text: str) -> DataFrame:
    rows = digests(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", text).drop("doc_id").distinct()
    return rows.withColumn("shard", F.pmod(F.col("check"), F.lit(shards)).cast("int"))


def update_index(index: DataFrame, insert: DataFrame, delete: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """The index after deleting the live digests of some texts and then inserting those of others.

    A shard's keys must fit in a task: choose shards in proportion to the distinct texts.
    """
    moves = _keys(delete, shards, text).withColumn("live", F.lit(False)).unionByName(_keys(insert, shards, text).withColumn("live", F.lit(True)))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int((left if len(left) else right).shard.iloc[0])
        filt = CuckooIndex.load(left.state.iloc[0]) if len(left) else CuckooIndex()
        for live in (False, True):
            for r in right[right.live == live].itertuples():
                k = _content_key(r.digest, r.bytes, r.check)
                filt.insert(k) if live else filt.delete(k)
        return pd.DataFrame({"shard": [shard], "state": [filt.dump()]})

    return index.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(merge, _STATE)


def build_index(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """shard, state: the live digests of all texts."""
    spark = docs.sparkSession
    return update_index(spark.createDataFrame([], _STATE), docs, docs.limit(0), shards, text)
