"""Sources and sinks: file trees, version control text, overlays, tasks, snapshots, vectors."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry import rules

MAX_HASHED = 1 << 20
OVERLAY = "version int, symbols array<struct<id:string,file:string,name:string,kind:string,line:int,endLine:int,sig:string,doc:string>>, edges array<struct<`from`:string,`to`:string,kind:string,at:string>>"
SCIP = "relativePath string, occurrences array<struct<symbol:string,range:array<int>,enclosingRange:array<int>,symbolRoles:int>>, symbols array<struct<symbol:string,kind:int,documentation:array<string>,relationships:array<struct<symbol:string,isImplementation:boolean,isReference:boolean>>>>"
TASKS = "tasks array<struct<id:string,repo:string,query:string,type:string,topK:int,expectedFiles:array<string>,expectedSymbols:array<string>,changed:array<string>>>"


def find_root(start: str, up: int = 40) -> str:
    """The nearest parent with a .git, or start itself."""
    at = os.path.abspath(start)
    for _ in range(up):
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    return os.path.abspath(start)


def inside(root: str, path: str) -> bool:
    """Whether path stays below root, by its name and by its real place."""
    real, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    return not os.path.relpath(os.path.join(root, path), root).startswith("..") and (real == base or real.startswith(base + os.sep))


def _ignored(patterns: list[str], rel: str, is_dir: bool) -> bool:
    """The last pattern that matches decides; ! takes back, / anchors, a final / is for directories."""
    hit = False
    for p in patterns:
        keep, q = p.startswith("!"), p.lstrip("!")
        only_dir, q = q.endswith("/"), q.rstrip("/")
        if only_dir and not is_dir:
            continue
        names = [rel] if "/" in q else [rel, os.path.basename(rel)]
        if any(fnmatch.fnmatchcase(n, q.lstrip("/")) for n in names):
            hit = not keep
    return hit


def walk(root: str, ignore: tuple[str, ...] = (), gitignore: bool = True) -> list[str]:
    """Relative paths below root in order: ignore files of each directory hold below it, links only inside root, each real directory once."""

    def read(path: str) -> list[str]:
        try:
            with open(path, encoding="utf8") as f:
                return [x.rstrip() for x in f if x.strip() and not x.startswith("#")]
        except OSError:
            return []

    top = [*rules.DEFAULT_IGNORES, *ignore, *(read(os.path.join(root, ".git/info/exclude")) if gitignore else [])]
    out, real = [], set()

    def visit(rel: str, layers: list[tuple[str, list[str]]]) -> None:
        here = os.path.join(root, rel)
        if os.path.realpath(here) in real or not inside(root, rel or "."):
            return
        real.add(os.path.realpath(here))
        layers = [*layers, (rel, read(os.path.join(here, ".gitignore")))] if gitignore else layers
        for name in sorted(os.listdir(here)):
            path = f"{rel}/{name}" if rel else name
            is_dir = os.path.isdir(os.path.join(root, path))
            if any(_ignored(pats, os.path.relpath(path, base) if base else path, is_dir) for base, pats in layers):
                continue
            if is_dir:
                visit(path, layers)
            elif os.path.isfile(os.path.join(root, path)) and inside(root, path):
                out.append(path)

    visit("", [("", top)])
    return out


SCANNED = "path string, content binary, length long, mtime_ms long"


def scan(spark: SparkSession, root: str, **how) -> DataFrame:
    """path, content, length, mtime_ms of a tree's files; names come from walk(), bytes from Spark's binary reader.

    That reader passes over names that begin with a dot or an underscore (so also
    __init__.py); those are read by tasks of their own, from the same tree.
    """
    root = os.path.abspath(root)
    names = walk(root, **how)
    skipped = [p for p in names if re.search(r"(^|/)[._]", p)]
    seen = [os.path.join(root, p) for p in names if p not in set(skipped)]
    out = spark.createDataFrame([], SCANNED)
    if seen:
        df = spark.read.format("binaryFile").load(seen)
        rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(root)}/", "")
        out = df.select(rel.alias("path"), "content", "length", F.unix_millis("modificationTime").alias("mtime_ms"))
    if skipped:

        def read(batches):
            import pyarrow as pa

            for b in batches:
                for p in b["path"].to_pylist():
                    full = os.path.join(root, p)
                    with open(full, "rb") as f:
                        data = f.read()
                    yield pa.RecordBatch.from_pydict({"path": [p], "content": pa.array([data], pa.binary()), "length": [len(data)], "mtime_ms": [int(os.stat(full).st_mtime * 1000)]})

        out = out.union(spark.createDataFrame([(p,) for p in skipped], "path string").mapInArrow(read, SCANNED))
    return out


def decode(files: DataFrame) -> DataFrame:
    """path, text."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """path, sha256 of files up to MAX_HASHED bytes."""
    return files.filter(F.octet_length(content) <= MAX_HASHED).select("path", F.sha2(F.col(content), 256).alias("sha256"))


def fingerprint(found: DataFrame) -> DataFrame:
    """tree: twelve hex digits over the ordered manifest, folded in two steps so that no task holds all of it at once."""
    part = found.withColumn("p", F.substring(F.sha2("path", 256), 1, 2)).groupBy("p").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws("\0", x["path"], x["sha256"], F.lit(""))), ""), 256).alias("h"))
    return part.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256), 1, 12).alias("tree"))


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """path, change (added, removed, edited) between two manifests."""
    j = new.join(old.withColumnRenamed("sha256", "old"), "path", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("old")))
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("sha256").isNull(), "removed").otherwise("edited").alias("change"))


def status(lines: DataFrame, line: str = "value") -> DataFrame:
    """file: the paths of captured `status --porcelain` lines, both sides of renames, without quotes."""
    rest = F.split(F.substring(F.col(line), F.lit(4), F.length(line)), " -> ")
    return lines.filter(F.length(line) > 3).select(F.explode(rest).alias("file")).select(F.regexp_replace("file", '^"|"$', "").alias("file")).distinct()


def log(text: DataFrame, value: str = "value") -> DataFrame:
    """commit_seq, file, file_pos from a captured log with NUL-separated blocks of file names."""
    block = text.select(F.posexplode(F.split(value, "\0")).alias("commit_seq", "block"))
    names = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~x.contains(" -> "))
    return block.select("commit_seq", F.posexplode(names).alias("file_pos", "file"))


def overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of version 1 overlay files."""
    raw = spark.read.schema(OVERLAY).json(path, multiLine=True).filter("version = 1")
    s = raw.select(F.explode("symbols").alias("s")).select("s.id", "s.file", "s.name", "s.kind", "s.line", F.col("s.endLine").alias("end_line"), "s.sig", "s.doc")
    e = raw.select(F.explode("edges").alias("e"))
    at = F.coalesce("e.at", F.concat(F.split(F.col("e.from"), "::")[0], F.lit(":1")))
    e = e.select(F.col("e.from").alias("src"), F.nullif(F.col("e.to"), F.lit("")).alias("dst"), F.col("e.kind").alias("kind"), F.regexp_extract(at, "^(.*):", 1).alias("at_file"), F.substring_index(at, ":", -1).try_cast("int").alias("at_line"))
    return s, e


def scip(spark: SparkSession, path: str) -> DataFrame:
    """documents of a JSON-shaped SCIP index."""
    return spark.read.schema(f"documents array<struct<{SCIP.replace(' string', ':string', 1).replace('occurrences array', 'occurrences:array').replace('symbols array', 'symbols:array')}>>").json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id, text and expectations from a JSON task file."""
    return spark.read.schema(TASKS).json(path, multiLine=True).select(F.explode("tasks").alias("t")).select(F.col("t.id").alias("task_id"), F.col("t.query").alias("text"), "t.repo", "t.type", "t.topK", "t.expectedFiles", "t.expectedSymbols", "t.changed")


def write_snapshot(df: DataFrame, root: str, name: str, snapshot: str, version: int = 1) -> str:
    """Writes a table under its schema version and snapshot; readers see it whole or not at all (the commit protocol's marker file)."""
    path = f"{root}/v{version}/{name}/snapshot={snapshot}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, name: str, snapshot: str, version: int = 1) -> DataFrame | None:
    """The table, or None where that version or snapshot isn't there."""
    try:
        return spark.read.parquet(f"{root}/v{version}/{name}/snapshot={snapshot}")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def prune_vectors(vectors: DataFrame, live: DataFrame, key: str = "content_hash") -> DataFrame:
    """Vectors whose content is still there."""
    return vectors.join(live.select(key).distinct(), key, "left_semi")


def missing_vectors(live: DataFrame, vectors: DataFrame, key: str = "content_hash") -> DataFrame:
    """Contents that need a vector."""
    return live.join(vectors.select(key), key, "left_anti").dropDuplicates([key])


def synthetic(spark: SparkSession, modules: int = 100, symbols: int = 20) -> DataFrame:
    """path, text of a generated corpus, the same for the same numbers."""
    body = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(symbols - 1)), lambda k: F.concat(F.lit("def handler_"), F.hex(F.xxhash64("id", k)), F.lit("(value):\n    return helper_"), F.pmod(F.xxhash64(k, "id"), F.lit(97)).cast("string"), F.lit("(value)\n"))),
        "\n",
    )
    return spark.range(modules).select(F.format_string("code/m%05d.py", "id").alias("path"), body.alias("text"))


def read_lines(files: DataFrame, wanted: DataFrame, around: int = 2, most: int = 200) -> DataFrame:
    """task_id, file, from, to, lines: spans (file, sl, el) with `around` more lines on both sides."""
    src = files.select(F.col("path").alias("file"), F.split("text", "\n").alias("all"))
    j = wanted.join(src, "file").withColumn("from", F.greatest(F.lit(1), F.col("sl") - around)).withColumn("to", F.least(F.size("all"), F.col("el") + around, F.col("from") + most - 1))
    return j.select("task_id", "file", "from", "to", F.slice("all", F.col("from"), F.greatest(F.lit(0), F.col("to") - F.col("from") + 1)).alias("lines"))


def handle(c):
    """(file, line) of a "file:line" handle."""
    return F.struct(F.regexp_extract(c, r"^(.*):\d+$", 1).alias("file"), F.substring_index(c, ":", -1).try_cast("int").alias("line"))


def overview(symbols: DataFrame, docs: DataFrame, most: int = 6) -> DataFrame:
    """dir, files, rank: the directories with most files."""
    from beaconry.functions import text as T

    d = symbols.select("file").union(docs.select("file")).distinct().groupBy(T.dirname(F.col("file")).alias("dir")).agg(F.count("*").alias("files"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files"), "dir"))).filter(F.col("rank") <= most)
