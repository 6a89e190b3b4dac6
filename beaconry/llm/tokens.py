"""Token ids of whole texts with a public vocabulary whose tokens never span white space.

Two bounded tables spare the tokenizer most of the work: runs between white
space, and below them the pieces (words, single digits, runs of signs) into
which the vocabulary's own expression cuts lower-cased Latin text. Only pieces
that are new go to the tokenizer, many at once; each of them ends in the one
token that closes a word. Other texts go to the tokenizer as they are.

Runs are looked up by numpy, all those of many texts at once, in a table with
open addressing. A run is known by its length, its first eight bytes and a 64-bit
hash, so only longer ones could ever be taken for each other, by one chance in
2**64 for two that begin alike.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

RUNS, PIECES, LONGEST, POOL = 1_400_000, 600_000, 40, 1 << 24
_LATIN = "a-z\xdf-\xf6\xf8-\xff"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
#: Beyond these characters the tokenizer's own notion of letters, case and white space decides.
_ODD = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]")


#: Bytes of runs: what isn't white space. Texts with other white space or control characters are _ODD.
_RUN = np.arange(256) > 32
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Table:
    """Runs by (hash, first bytes, length), each with the place and number of its ids in a pool."""

    def __init__(self, slots: int = 1 << 21):
        self.mask = slots - 1
        self.hash, self.head = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.length, self.at, self.n = (np.zeros(slots, np.int32) for _ in range(3))
        self.pool = np.zeros(1 << 20, "<u2")
        self.clear()

    def clear(self) -> None:
        self.hash[:] = 0
        self.held = self.used = 0

    def find(self, h: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each run's slot, -1 where it isn't held."""
        out = np.full(len(h), -1, np.int64)
        slot = (h & np.uint64(self.mask)).view(np.int64)
        left = np.arange(len(h))
        while len(left):
            own = self.hash[slot]
            hit = (own == h[left]) & (self.head[slot] == head[left]) & (self.length[slot] == length[left])
            out[left[hit]] = slot[hit]
            on = (own != 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, head: np.ndarray, length: np.ndarray, ids: list[bytes]) -> None:
        """Adds runs that aren't held, no two of them alike."""
        n = np.array([len(x) // 2 for x in ids], np.int64)
        new = np.frombuffer(b"".join(ids), "<u2")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        self.held += len(h)
        slot, left = (h & np.uint64(self.mask)).view(np.int64), np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.hash[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            own = left[free[first]]
            self.hash[taken], self.head[taken], self.length[taken] = h[own], head[own], length[own]
            self.at[taken], self.n[taken] = at[own], n[own]
            on = np.ones(len(left), bool)
            on[free[first]] = False
            left, slot = left[on], (slot[on] + 1) & self.mask


class WordIds:
    """many(texts): the ids of each text, as unsigned 16-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = _Table()
        self.pieces: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _learn(self, new: list[str]) -> None:
        ids = self._encode(" ".join(new))
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary doesn't close each word with one token")
        data, at = ids.tobytes(), 0
        for word, e in zip(new, ends.tolist()):
            self.pieces[word] = data[2 * at : 2 * e]
            at = e

    def _of(self, runs: list[str]) -> list[bytes]:
        """The ids of some runs."""
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        pieces, cut = self.pieces, [_PIECE.findall(w.lower()) for w in runs]
        unknown = list({p for c in cut for p in c if p not in pieces})
        if unknown:
            self._learn(unknown)
        out = [b"".join([pieces[p] for p in c]) for c in cut]
        for p in unknown:
            if len(p) > LONGEST:  # such pieces hardly come again
                del pieces[p]
        return out

    def many(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if _ODD.search(t) or any(s in t for s in self.special)]
        if odd:
            out = self.many([t if i not in set(odd) else "" for i, t in enumerate(texts)]) if len(odd) < len(texts) else [None] * len(texts)
            for i in odd:
                out[i] = self._encode(texts[i])
            return out
        from beaconry.llm.textvec import Words

        w, table = Words(texts, _RUN), self.table
        length, n = w.end - w.start, len(w.hash)
        if not n:
            return [np.zeros(0, "<u2")] * len(texts)
        h = np.maximum(w.hash, np.uint64(1))
        data = np.concatenate([w.data, np.zeros(8, np.uint8)])
        head = np.lib.stride_tricks.as_strided(data, (len(w.data), 8), (1, 1))[w.start].view("<u8")[:, 0] & _HEADS[np.minimum(length, 8)]
        if table.held > RUNS or table.used > POOL:
            table.clear()
        slot = table.find(h, head, length)
        while len(lost := np.flatnonzero(slot < 0)):
            lost = lost[np.unique(h[lost], return_index=True)[1]]  # of two runs with one hash the second has its turn later
            runs = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[lost].tolist(), w.end[lost].tolist())]
            if table.held + len(lost) > (table.mask + 1) * 3 // 4:  # more new runs in one text than the table has room for
                table.__init__(2 * (table.mask + 1))
                slot[:] = -1
                continue
            table.add(h[lost], head[lost], length[lost], self._of(runs))
            again = np.flatnonzero(slot < 0)
            slot[again] = table.find(h[again], head[again], length[again])
        times = table.n[slot].astype(np.int64)
        ends = np.cumsum(times)
        ids = table.pool[np.arange(ends[-1]) + np.repeat(table.at[slot] - (ends - times), times)]
        ends = np.concatenate([[0], ends])[w.first].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0].tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
