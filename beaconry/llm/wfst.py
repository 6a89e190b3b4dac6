"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file, in three parts that are composed
with each text:

* the normaliser: blanks become the visible blank, and one is put before a text;
* the lexicon: a trie of the model's pieces, with byte arcs for characters that
  no piece holds;
* the grammar: a bigram automaton over pieces. In a byte-pair model the weight
  of piece b after piece a is -log of nothing but a yes or no: 0 if merging the
  characters of both gives a and b again, infinite otherwise. It is evaluated
  lazily by undoing the merges of a and b along their common border.

A segmentation is the model's own exactly if all neighbours in it are such
pairs, and then it is the only one; so the path of finite weight in the tropical
semiring is the shortest path, every position has one best arc into it, and one
pass from left to right finds it. Merging by priority gives the same ids, which
the tests hold against the public library.

Pieces never cross certain borders (two characters that are neighbours in no
piece), so texts are composed part by part, and parts that come again are looked
up in bounded tables.

Defined results: a null or empty text has no ids; decode(encode(x)) is x, but
for visible blanks in x (they become blanks) and broken surrogates; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import whole

BLANK = "▁"
WORDS, PARTS, LONGEST = 400_000, 400_000, 40
NORMAL, BYTE = 1, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        k, i = _varint(b, i)
        kind = k & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            else:
                n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield k >> 3, v


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """(piece, score, type) by id, and what the normaliser does."""
    pieces, how = [], {"name": "identity", "prefix": True, "squeeze": False, "escape": True}
    with open(path, "rb") as f:
        data = f.read()
    for k, v in _fields(data):
        if k == 1:
            d = dict(_fields(v))
            pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif k == 3:
            d = dict(_fields(v))
            how = {"name": d.get(1, b"").decode(), "map": d.get(2, b""), "prefix": bool(d.get(3, 1)), "squeeze": bool(d.get(4, 1)), "escape": bool(d.get(5, 1))}
    return pieces, how


class Transducer:
    """Compiled from a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        pieces, how = read_model(path)
        if how["name"] != "identity" or how.get("map") or how["squeeze"] or not (how["prefix"] and how["escape"]):
            raise ValueError("only the identity normaliser with a blank before the text is compiled")
        self.pieces = pieces
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = [s for _, s, _ in pieces]
        byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte = [byte[i] for i in range(256)]
        self.bytes = set(self.byte)
        self.left, self.right = list(range(len(pieces))), list(range(len(pieces)))
        self.merged: dict[tuple[int, int], int] = {}
        arcs: dict[str, int] = {}
        self.inside: set[str] = set()
        for p, i in self.id.items():
            self.inside.update(p[k : k + 2] for k in range(len(p) - 1))
            for k in range(1, len(p)):  # any two pieces that make up a third can merge
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    self.merged[a, b] = i
        for p, i in self.id.items():
            if len(p) > 1:
                parts = self.merge(p)
                if parts[-1][0] != [i]:
                    continue  # no text ever gives this piece
                self.left[i], self.right[i] = parts[-2][0] if len(parts) > 1 else (i, i)
            for k in range(1, len(p)):
                arcs.setdefault(p[:k], -1)
            arcs[p] = i
        self.arcs = arcs
        self.longest = max(map(len, self.id))
        self.allowed: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shown = [b"" if t not in (NORMAL, BYTE) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(BLANK, " ").encode() for p, _, t in pieces]
        self.shown = shown

    def merge(self, text: str) -> list[tuple[list[int]]]:
        """The ids of text after each step of merging by priority, last two states only (used to compile)."""
        ids = [self.id[c] for c in text]
        states = [(ids,)]
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                m = self.merged.get((ids[k], ids[k + 1]))
                if m is not None and (best is None or self.score[m] > self.score[best[1]]):
                    best = k, m
            if best is None:
                break
            ids = [*ids[: best[0]], best[1], *ids[best[0] + 2 :]]
            states = [states[-1], (ids,)]
        return states

    def follows(self, a: int, b: int) -> bool:
        """Whether merging what a and b are made of gives a and b again.

        Merges are undone, the one made last first. As long as pieces x | y meet
        at the border, they must not merge before the merge that swallows one of them.
        """
        x, y = a, b
        due, right = -np.inf, False  # the score of the next merge at the border, and whether it is to its right
        while True:
            m = self.merged.get((x, y))
            if m is not None and (self.score[m] > due or right and self.score[m] == due):
                return False
            x_whole, y_whole = self.left[x] == x, self.left[y] == y
            if x_whole and y_whole:
                return True
            # of the two merges that made x and y the later one: lower score, or same score and further right
            if y_whole or not x_whole and self.score[x] < self.score[y]:
                due, right, x = self.score[x], False, self.right[x]
            else:
                due, right, y = self.score[y], True, self.left[y]

    def path(self, part: str) -> list[int]:
        """The shortest path through the composition of a part with lexicon and grammar."""
        n = len(part)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        arcs, allowed, longest = self.arcs, self.allowed, self.longest
        for i in range(n):
            a = last[i]
            if i and a == -1:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                b = arcs.get(part[i:j])
                if b is None:
                    break
                if b < 0:
                    continue
                if i:
                    ok = allowed.get((a, b))
                    if ok is None:
                        if len(allowed) > 2_000_000:
                            allowed.clear()
                        ok = allowed[a, b] = self.follows(a, b)
                    if not ok:
                        continue
                last[j], back[j] = b, i
        out, j = [], n
        while j:
            out.append(last[j])
            j = back[j]
        return out[::-1]

    def _part(self, part: str) -> bytes:
        if part in self.id or part[0] in self.id:
            return struct.pack(f"<{len(x := self.path(part))}H", *x)
        return b"".join(struct.pack("<H", self.byte[c]) for c in part.encode("utf-8", "replace"))

    def _compose(self, text: str) -> bytes:
        """Ids of a normalised text, cut where no piece can cross."""
        out, a, inside, parts = [], 0, self.inside, self.parts
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in inside:
                part = text[a:k]
                a = k
                got = parts.get(part)
                if got is None:
                    got = self._part(part)
                    if len(part) <= LONGEST:
                        if len(parts) > PARTS:
                            parts.clear()
                        parts[part] = got
                out.append(got)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids of a text."""
        if not text:
            return b""
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self._compose, re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK))))
        words, known = text.split(" "), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > WORDS:
            known.clear()
        own = {w: self._compose(BLANK + w) for w in set(words) if w not in known}
        out = b"".join([own[w] if w in own else known[w] for w in words])
        known.update((w, x) for w, x in own.items() if len(w) <= LONGEST)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), "<u2").tolist()

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        out = b"".join([shown[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes (fallback), ids_crc32, round_trip of every row (see the module's text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        fallback = np.zeros(len(t.pieces), bool)
        fallback[t.byte] = True
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 250):
                b = whole_batch.slice(a, 250)
                ids, same, n_bytes = [], [], []
                for x in b["text"]:
                    text = x.as_py()
                    got = np.frombuffer(t.ids(text), "<u2")
                    ids.append(got.astype("<i4"))
                    n_bytes.append(int(fallback[got].sum()))
                    same.append(t.decode(got.tolist()) == text)
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))
                n, crc = pa.array(np.diff(at).astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"], flat, n, pa.array(n_bytes, pa.int64()), crc, pa.array(same)], ["doc_id", "ids", "n_tokens", "n_bytes", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with the text of the column ids as `text`."""

    @F.pandas_udf("string")
    def text(ids):
        t = transducer(path)
        return ids.map(lambda x: "" if x is None else t.decode(x.tolist()))

    return tokens.withColumn("text", text("ids"))
