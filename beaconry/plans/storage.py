"""Written intermediate tables: they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            found = tempfile.mkdtemp(prefix="beaconry-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared(df.sparkSession)}/beaconry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def few_broadcasts(spark: SparkSession, most: int = 1 << 20):
    """Within it, Spark broadcasts tables of at most `most` bytes by itself (or fewer, as it was set).

    The driver builds every broadcast table, and repetitive columns of a Parquet
    file or a shuffle are ten and more times larger there than on disk.
    """
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in old.items():
        m = re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", (v or "").strip().lower())
        spark.conf.set(n, str(min(most, int(m[1]) * units[m[2]]) if m else most))
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
