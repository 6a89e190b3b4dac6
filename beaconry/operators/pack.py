"""Budgeted capsules: the answer of a task, packed greedily by utility a token, one task a group."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry import rules

PINNED = set("recent-change exact-name explicit-file".split())
HIT = "id string, name string, kind string, file string, name_line int, sl int, el int, sig string, reason array<string>, conf string, score double, rank int"
CAPSULE = "task_id {key}, query string, confidence string, handles array<string>, hits array<string>, dirs array<string>, files array<string>, entries array<string>, changed array<string>, unresolved array<string>, next array<string>, tokens long, truncated boolean, text string, json string"


def estimate(text: str) -> int:
    return max(1, -(-len(text) // 4))


def render(c: dict) -> str:
    """A capsule as text."""
    out = [f"task {c['query']} [{c['confidence']}]"]
    for title, rows in (("areas", c["dirs"]), ("hits", [f"{h['handle']} {h['kind']} {h['name']} {h['file']}:{h['line']} {h['sig']} ({', '.join(h['reason'])})" for h in c["hits"]])):
        if rows:
            out += [title, *(f"  {r}" for r in rows)]
    for title in ("files", "entries", "changed", "unresolved", "next"):
        if c[title]:
            out.append(f"{title}: {', '.join(c[title])}")
    return "\n".join(out)


def cost(c: dict) -> int:
    """The larger of both renderings, so that either fits."""
    return max(estimate(render(c)), estimate(json.dumps(c)))


def greedy(query: str, confidence: str, hits: list[dict], dirs: list[dict], changed: list[str], unresolved: list[str], budget: int, seen: set[str] = frozenset(), novelty: float = 1.0) -> dict:
    """The capsule of one task; hits and dirs in rank order."""
    for i, h in enumerate(hits):
        h["handle"], h["sig"], h["score"] = f"src-{i + 1:02d}", h["sig"][:100], int(h["score"] * 100 + 0.5) / 100
    pin = lambda h: bool(PINNED & set(h["reason"]))
    worth = lambda h: h["score"] * rules.CONFIDENCE.get(h["conf"], 0.5)
    c = {"query": query, "confidence": confidence, "hits": [], "dirs": [], "files": [], "entries": [], "changed": [], "unresolved": [], "next": [], "truncated": False}
    pick, files = [], set()
    for h in sorted(hits, key=lambda h: not pin(h)):
        size = estimate(f"{h['handle']} {h['kind']} {h['name']} {h['file']}:{h['line']} {h['sig']} {','.join(h['reason'])}")
        known = 0.15 if f"{h['file']}:{h['line']}" in seen else 1
        again = novelty if h["file"] in files else 1
        files.add(h["file"])
        pick.append((10.0 if pin(h) else worth(h) * known * again, size, "hits", h))
    for i, d in enumerate(dirs):
        pick.append((float(max(1, len(hits) - i)), estimate(d["text"]), "dirs", d["text"]))
    if dirs:
        c["dirs"].append(dirs[0]["text"])
    if hits:
        c["hits"].append(hits[0])
    for _, size, lane, x in sorted(pick, key=lambda p: (-p[0] / p[1], -p[0])):
        if x not in c[lane] and cost(c) + size <= budget:
            c[lane].append(x)
    total: dict[str, float] = {}
    for h in c["hits"]:
        total[h["file"]] = total.get(h["file"], 0) + h["score"]
    c["files"] = sorted(total, key=lambda f: -total[f])[:8]
    c["entries"] = [f"{h['file']}:{h['line']}" for h in hits if h["kind"] == "entry" and h in c["hits"]][:5]
    c["next"] = [f"expand {h['handle']}" for h in c["hits"][:3]] + [f"impact {h['name']}" for h in c["hits"][:3]]
    c["changed"], c["unresolved"], c["dirs"] = sorted(changed)[:8], list(unresolved), c["dirs"][:3]
    while cost(c) > budget:
        c["truncated"] = True
        lane = next((x for x in ("next", "entries", "unresolved", "changed", "dirs") if c[x]), None)
        if lane:
            c[lane].pop()
        elif any(not pin(h) for h in c["hits"]):
            c["hits"].remove(min((h for h in c["hits"] if not pin(h)), key=worth))
        elif c["hits"]:
            c["hits"].pop()
        elif c["files"]:
            c["files"].pop()
        else:
            break
    return c


def capsules(tasks: DataFrame, hits: DataFrame, gate: DataFrame, dirs: DataFrame | None = None, changed: DataFrame | None = None, unresolved: DataFrame | None = None, seen: DataFrame | None = None, budget: int = 1200, most: int = 400) -> DataFrame:
    """A capsule row for each task. A group is one task's ranked hits, of which `most` can fit the budget at the very most."""
    key = dict(tasks.dtypes)["task_id"]
    h = hits.filter(F.col("rank") <= most).select("task_id", F.struct("rank", "name", "kind", "file", F.col("name_line").alias("line"), "sl", "el", F.coalesce("sig", F.lit("")).alias("sig"), "reason", "conf", "score").alias("h"))
    rows = h.groupBy("task_id").agg(F.to_json(F.array_sort(F.collect_list("h"))).alias("hits"))
    t = tasks.select("task_id", F.col("text").alias("query")).join(rows, "task_id", "left").join(gate, "task_id", "left")
    lists = {"dirs": dirs, "changed": changed, "unresolved": unresolved, "seen": seen}
    for name, df in lists.items():
        if df is None:
            t = t.withColumn(name, F.array().cast("array<string>"))
        else:
            col = df.columns[-1]
            first = df.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "task_id"]))), lambda x: x[col].cast("string")).alias(name))
            t = t.join(first, "task_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            own = json.loads(r.hits) if isinstance(r.hits, str) else []
            c = greedy(r.query, r.confidence or "empty", own, [{"text": x} for x in r.dirs], list(r.changed), list(r.unresolved), budget, set(r.seen))
            told = [h["handle"] for h in c["hits"]]
            labels = [f"{h['file']}:{h['line']} {h['name']}" for h in c["hits"]]
            out.append([r.task_id, c["query"], c["confidence"], told, labels, c["dirs"], c["files"], c["entries"], c["changed"], c["unresolved"], c["next"], cost(c), c["truncated"], render(c), json.dumps(c)])
        return pd.DataFrame(out, columns=[x.split()[0] for x in CAPSULE.format(key=key).split(", ")])

    return t.groupBy("task_id").applyInPandas(run, CAPSULE.format(key=key))


def prefix(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """rows up to which the running sum of sizes stays within the budget: the set-parallel cousin of greedy()."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def savings(hits: DataFrame, sizes: DataFrame, used: DataFrame, files: int = 4, each: int = 4_000, total: int = 12_000) -> DataFrame:
    """task_id, cold, capsule, saved, pct, spans: what reading the first files of an answer would cost against its capsule."""
    first = hits.groupBy("task_id", "file").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("task_id").orderBy("rank")
    first = first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= files).join(sizes, "file")
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("n", F.least("chars", F.lit(each))).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    first = first.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), total - F.col("before")))).filter("n > 0")
    cold = first.groupBy("task_id").agg(F.ceil(F.sum("n") / 4).cast("long").alias("cold"), F.count("*").alias("spans"))
    j = cold.join(used.select("task_id", F.col("tokens").alias("capsule")), "task_id")
    saved = F.greatest(F.lit(0), F.col("cold") - F.col("capsule")).cast("long")
    return j.select("task_id", "cold", "capsule", saved.alias("saved"), F.round(saved * 100.0 / F.col("cold"), 6).alias("pct"), "spans")
