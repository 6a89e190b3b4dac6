"""Stateful streams, and their batch forms.

Every function takes a streaming or a batch DataFrame unless it says otherwise.
Event time is `ts`; lateness is the watermark's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files as they come, with their hash."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder).withColumn("sha256", F.sha2(F.col("content"), 256))


def upsert(into: str, key: str = "path") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the newest row of each key, in a Parquet folder a batch; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc("modificationTime"))
        batch.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").write.mode("overwrite").parquet(f"{into}/epoch={epoch}")

    return write


def latest(spark: SparkSession, into: str, key: str = "path") -> DataFrame:
    """What the upserts amount to: the row of the last batch of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("epoch"))
    return spark.read.parquet(into).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def dedupe(prompts: DataFrame, key: str = "key", within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first prompt of each key in a while."""
    if prompts.isStreaming:
        return prompts.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    w = Window.partitionBy(key).orderBy(ts)
    return prompts.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def dedupe_key(task, tree, changed):
    """Twelve hex digits of a task, a tree and its changed files."""
    return F.substring(F.sha2(F.concat_ws("\0", task, tree, F.array_join(F.array_sort(changed), "\0")), 256), 1, 12)


def totals(events: DataFrame, session: str, value: str) -> DataFrame:
    """session, n, total."""
    return events.groupBy(session).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))


def windowed(events: DataFrame, width: str, kind: str, value: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """start, kind, n, total by tumbling windows, with a watermark on streams."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def novelty(shown: DataFrame, session: str = "session", item: str = "item", tree: str = "tree", ts: str = "ts") -> DataFrame:
    """Batch: rows with new, false where the session has shown the item before under the same tree."""
    return shown.withColumn("new", F.row_number().over(Window.partitionBy(session, tree, item).orderBy(ts)) == 1)


def novelty_stream(shown: DataFrame, session: str = "session") -> DataFrame:
    """Streaming novelty (session, item, tree): a state row a session holds the tree and the items shown; another tree resets it."""
    import pandas as pd

    def run(key, batches, state):
        tree, items = state.get if state.exists else ("", [])
        items, out = set(items), []
        for pdf in batches:
            for r in pdf.itertuples():
                if r.tree != tree:
                    tree, items = r.tree, set()
                out.append((key[0], r.item, r.tree, r.item not in items))
                items.add(r.item)
        state.update((tree, sorted(items)))
        yield pd.DataFrame(out, columns=["session", "item", "tree", "new"])

    return shown.groupBy(session).applyInPandasWithState(run, "session string, item string, tree string, new boolean", "tree string, items array<string>", "append", "NoTimeout")


def stale(edits: DataFrame, builds: str = "build", edit: str = "edit", key: str = "repo", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Batch: key, stale: edits since the last build."""
    w = Window.partitionBy(key)
    last = F.max(F.when(F.col(kind) == builds, F.col(ts))).over(w)
    e = edits.withColumn("last", last)
    return e.groupBy(key).agg(F.sum(((F.col(kind) == edit) & (F.col("last").isNull() | (F.col(ts) > F.col("last")))).cast("long")).alias("stale"))


def affinity(prompts: DataFrame, vocabulary: DataFrame, least: int = 40) -> DataFrame:
    """Prompts of `least` characters and more that share a word of three characters and more with the corpus (term)."""
    from beaconry import rules

    word = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")))
    held = prompts.filter(F.length("text") >= least).select("prompt_id", word.alias("term")).filter((F.length("term") >= 3) & ~F.col("term").isin(*sorted(rules.STOP_WORDS)))
    return prompts.join(held.join(vocabulary.select("term").distinct(), "term", "left_semi").select("prompt_id").distinct(), "prompt_id", "left_semi")
