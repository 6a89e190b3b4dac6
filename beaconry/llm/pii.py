"""Personal data: fixed kinds, and identifiers found by bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of
fixed expressions that pass a check; they are also the seeds. Then:

1. Seeds induce lexical patterns: the word right before a seed (at most three
   characters between). A pattern needs SUPPORT different seeds.
2. Candidates are tokens with at least DIGITS digits outside base spans; the
   graph has an edge for each (pattern, instance) with its count. How often a
   pattern's word occurs at all is counted over the whole corpus.
3. Spark scores the graph in ROUNDS rounds: a pattern's confidence is the
   scored share of all occurrences of its word, an instance's score the mean
   confidence over its occurrences; seeds have score 1.
4. Candidates in contexts of patterns with confidence CONFIDENT and more, whose
   instance scores as much, are added as spans of kind `id`.

Texts are read twice and never shuffled; edges and counts are aggregated before
each join, so a frequent word is one row a task. The graph is cut down to
patterns that seeds support before it is scored.

Defined results: a null text counts as empty and has no spans; rows that repeat
an id are scored on their own; without seeds there are no patterns and nothing
is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise, whole

SUPPORT, DIGITS, ROUNDS, CONFIDENT = 3, 4, 3, 0.5
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPACE = re.compile(r"\s")
_NOT_DIGIT = re.compile("[^0-9]")
_BEFORE = re.compile("([0-9A-Za-z\x80-\U0010ffff]{1,64})[^0-9A-Za-z\x80-\U0010ffff]{1,3}\\Z")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|#$%&*="
LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += LUHN[d] if k % 2 else d
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and (not p or int(p) < 256)


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL. Only around an @ is anything tried, so long words cost nothing."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), ordered."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() > 11 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with DIGITS digits and more, less their punctuation, that no base span touches."""
    out, k = [], 0
    spans = sorted((a, b) for a, _, b in base)
    for d in _digit_tokens(text):
        a, b = d
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if any(x < b and a < y for x, y in spans[max(0, k - 3) : k + 4]):
            continue
        if len(_NOT_DIGIT.sub("", text[a:b])) >= DIGITS:
            out.append((a, b))
    return out


def _digit_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit."""
    at = 0
    while m := _DIGIT.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        e = _SPACE.search(text, m.end())
        at = e.start() if e else len(text)
        yield a, at


def _pattern(text: str, start: int) -> str:
    m = _BEFORE.search(text[max(0, start - 70) : start].lower())
    return m[1] if m else ""


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from beaconry.llm.textvec import Words

    edge = pa.list_(pa.struct([("p", pa.int64()), ("i", pa.int64())]))
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("p", pa.int64()), ("i", pa.int64())]))

    def numbers(words: list[str]) -> np.ndarray:
        """Each word's hash; 0 where there is none."""
        w = Words(words)
        out = np.zeros(len(words), np.uint64)
        some = w.first[1:] > w.first[:-1]
        out[some] = w.hash[w.first[:-1][some]]
        return out.view(np.int64)

    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 500):
            b = whole_batch.slice(at, 500)
            counts, hashes, spans, seen, own = [], [], [], [], []
            names: list[str] = []
            keys: list[int] = []
            for x in b["text"]:
                text = x.as_py()
                base = base_spans(text)
                told = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                counts.append([sum(k == n for _, k, _ in base) for n in range(4)])
                spans.append(",".join(told))
                hashes.append(hashlib.sha256(spans[-1].encode()).hexdigest())
                more = candidates(text, base) if _DIGIT.search(text) else []
                for s, e in [(s, e) for s, _, e in base] + more:
                    names.append(_pattern(text, s))
                    keys.append(int.from_bytes(hashlib.blake2b(text[s:e].lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                seen.append(len(base))
                own.append(more)
            p = numbers(names).tolist()
            k = 0
            edges, found = [], []
            for n, more in zip(seen, own):
                edges.append([{"p": p[j], "i": keys[j]} for j in range(k, k + n) if p[j]])
                k += n
                found.append([{"a": s, "b": e, "p": p[k + j], "i": keys[k + j]} for j, (s, e) in enumerate(more)])
                k += len(more)
            c = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b["uid"], b["doc_id"], *(pa.array(c[:, n]) for n in range(4)), pa.array(hashes), pa.array(spans), pa.array(edges, edge), pa.array(found, span)],
                ["uid", "doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "base", "seeds", "found"],
            )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word's hash, times), summed up in part."""
    from beaconry.llm.linear import chunks
    from beaconry.llm.textvec import Words

    def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["p", "total"])

    held, size = [], 0
    for b in batches:
        for _, part in chunks(b["text"].to_pylist()):
            held.append(Words([t.lower() for t in part]).hash)
            size += len(held[-1])
            if size > 2_000_000:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def score(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(p, conf) and (i, score) from edges(p, i, seed, n) and totals(p, total)."""
    reliable = edges.select("p", "i", "n", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    for k in range(rounds):
        patterns = reliable.groupBy("p").agg(F.sum(F.col("n") * F.col("score")).alias("own")).join(totals, "p")
        patterns = materialise(patterns.select("p", F.least(F.lit(1.0), F.col("own") / F.greatest("total", F.lit(1))).alias("conf")), f"patterns-{k}")
        scored = edges.join(patterns, "p").groupBy("i").agg(F.max("seed").alias("seed"), (F.sum(F.col("n") * F.col("conf")) / F.sum("n")).alias("mean"))
        scores = materialise(scored.select("i", F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("score")), f"instances-{k}")
        reliable = edges.select("p", "i", "n").join(scores, "i")
    return patterns, scores


def extract(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans, n_id of every row (see the module's text)."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    schema = "uid long, doc_id long, " + ", ".join(f"n_{x} long" for x in KINDS) + ", base_sha256 string, base string, seeds array<struct<p:long,i:long>>, found array<struct<a:long,b:long,p:long,i:long>>"
    rows = materialise(texts.mapInArrow(_find, schema), "pii")
    seeds = rows.select(F.explode("seeds").alias("x")).select("x.p", "x.i", F.lit(True).alias("seed"))
    others = rows.select(F.explode("found").alias("x")).select("x.p", "x.i", F.lit(False).alias("seed")).filter("p <> 0")
    edges = seeds.union(others).groupBy("p", "i", "seed").agg(F.count("*").alias("n"))
    edges = materialise(edges, "pii-edges")
    strong = edges.filter("seed").groupBy("p").agg(F.count("*").alias("k")).filter(F.col("k") >= support).select("p")
    edges = materialise(edges.join(strong, "p", "left_semi"), "pii-graph")
    totals = texts.select("text").mapInArrow(_word_counts, "p long, total long").join(edges.select("p").distinct(), "p", "left_semi").groupBy("p").agg(F.sum("total").alias("total"))
    patterns, scores = score(edges, materialise(totals, "pii-totals"), rounds)
    spans = rows.filter(F.size("found") > 0).select("uid", F.explode("found").alias("x")).select("uid", "x.*")
    spans = spans.join(patterns.filter(F.col("conf") >= confident), "p").join(scores.filter(F.col("score") >= confident), "i")
    added = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("a", F.lit(len(KINDS)).alias("k"), "b"))).alias("more"))
    # Base spans as (start, kind's number, end) again, so that both kinds sort together.
    listed = F.array(*map(F.lit, (*KINDS, "id")))
    base = F.when(F.col("base") == "", F.array().cast("array<struct<a:long,k:int,b:long>>")).otherwise(
        F.transform(
            F.split("base", ","),
            lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), (F.array_position(listed, F.split(s, ":")[0]) - 1).cast("int").alias("k"), F.split(s, ":")[2].cast("long").alias("b")),
        )
    )
    both = F.array_sort(F.concat(base, F.col("more")))
    text = F.array_join(F.transform(both, lambda x: F.concat_ws(":", F.element_at(listed, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")
    out = rows.drop("seeds", "found").join(added, "uid", "left")
    return out.select(
        "doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_id")
    )
