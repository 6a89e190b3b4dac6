"""The engine: a corpus of tables, and the queries over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators import bm25, docs, extract, graph, pack, rank
from beaconry.plans.storage import few_broadcasts, written
from beaconry.sources import tree


@dataclass
class Corpus:
    """Facts of a tree."""

    symbols: DataFrame
    edges: DataFrame
    imports: DataFrame
    docs: DataFrame
    sections: DataFrame
    links: DataFrame
    files: DataFrame
    manifest: DataFrame
    vectors: DataFrame | None = None
    options: dict = field(default_factory=dict)


def build(files: DataFrame, overlay: tuple[DataFrame, DataFrame] | None = None) -> Corpus:
    """files: path, content. Python goes through the syntax tree, other known languages through lines, prose into sections."""
    with few_broadcasts(files.sparkSession):
        return _build(files, overlay)


def _build(files: DataFrame, overlay: tuple[DataFrame, DataFrame] | None) -> Corpus:
    text = tree.decode(files)
    code = text.filter(extract.T.language(F.col("path")).isNotNull())
    s1, e1, i1 = extract.by_tree(code)
    s2, i2 = extract.by_lines(code.filter(~F.col("path").endswith(".py")))
    art = extract.artifacts(text)
    symbols = s1.unionByName(s2).drop("lang").unionByName(art).dropDuplicates(["id"])
    symbols = extract.runtime_strings(symbols, text).withColumn("seq", F.dense_rank().over(extract.Window.orderBy("file", "sl", "id")).cast("long"))
    imports = i1.unionByName(i2).withColumn("seq", F.col("at_line").cast("long"))
    edges = e1.withColumn("seq", F.dense_rank().over(extract.Window.orderBy("at_file", "at_line", "src", "name", "kind")).cast("long"))
    symbols, imports = written(symbols, "symbols"), written(imports, "imports")
    edges = graph.resolve(written(edges, "edges"), symbols, imports)
    if overlay is not None:
        symbols = graph.overlay_symbols(symbols, overlay[0])
        edges = graph.overlay_edges(edges, overlay[1], symbols)
        symbols = written(symbols, "symbols")
    found = written(docs.extract(files), "docs")
    secs = written(docs.split(found), "sections")
    return Corpus(symbols, written(edges, "edges"), imports, found, secs, docs.code_links(secs, symbols), text, tree.manifest(files))


def observe(c: Corpus, tasks: DataFrame, budget: int = 1200, changed: DataFrame | None = None, cochanged: DataFrame | None = None, semantic: DataFrame | None = None, lanes: tuple[str, ...] = ("bm25", "docs", "files", "semantic"), seen: DataFrame | None = None) -> DataFrame:
    """A capsule for each of many tasks (task_id, text)."""
    with few_broadcasts(tasks.sparkSession):
        names = c.files.select(F.col("path").alias("file"))
        explicit = rank.explicit_files(tasks, names)
        tasks, explicit = written(tasks, "tasks"), written(explicit, "explicit")
        # Hits are read several times in each lane, so every lane's result is a table; a task has a few hundred of them.
        lex = written(rank.lexical(tasks, c.symbols, c.edges, changed, explicit, cochanged), "lexical")
        hits = written(rank.combine(lex, rank.propagate(lex.select("task_id", "id", "base"), c.edges), c.symbols, tasks, explicit), "hits")
        if "bm25" in lanes:
            rows = c.symbols.select("id", F.concat_ws(" ", "name", "sig", "doc", "file").alias("body"))
            sym = written(bm25.search(rows, tasks, "id", "body", "task_id", "text", stem=True), "bm25")
            no = sym.limit(0).select("task_id", F.lit("").alias("file"), F.lit(1).alias("line"), F.lit(0.0).alias("bm25"), F.lit(0).cast("long").alias("coverage"))
            found = no
            if "docs" in lanes:
                secs = c.sections.select(F.concat_ws("#", "file", F.col("sec_idx").cast("string")).alias("key"), F.concat_ws(" ", "text", "file").alias("body"), "file", "line")
                best = bm25.search(secs, tasks, "key", "body", "task_id", "text", stem=True).join(secs.select("key", "file", "line"), "key")
                best = best.groupBy("task_id", "file").agg(F.min_by("line", "rank").alias("line"), F.max("score").alias("bm25"))
                held = c.docs.select("file", F.explode(rank.T.meaningful(F.col("text"))).alias("term")).join(rank.task_terms(tasks).distinct(), "term").groupBy("task_id", "file").agg(F.count("*").alias("coverage"))
                found = best.join(held, ["task_id", "file"], "left").fillna(0, ["coverage"])
            hits = written(rank.fuse_bm25(hits, c.symbols, written(found, "bm25"), sym, tasks, lex), "hits")
        if "files" in lanes:
            content = rank.symbol_terms(c.symbols).join(c.symbols.select("id", "file"), "id").select("file", "term").union(c.docs.select("file", F.explode(rank.T.meaningful(F.col("text"))).alias("term"))).distinct()
            hits = written(rank.fuse_files(hits, written(rank.rank_files(tasks, names, content), "files")), "hits")
        gate = written(rank.confidence(hits, tasks), "gate")
        if "semantic" in lanes and semantic is not None:
            open_ = gate.filter(F.col("confidence").isin("weak", "empty")).select("task_id")
            info = c.symbols.select("id", "file", "name", "kind", "sig", "sl", "el", "name_line", "conf")
            hits = written(rank.fuse_semantic(hits, semantic.join(open_, "task_id", "left_semi"), info, tasks), "hits")
        cards = graph.dir_cards(c.symbols, c.docs)
        top = graph.rank_dirs(cards, hits).select("task_id", "k", graph.render_card().alias("card"))
        top, unresolved = written(top, "dirs"), written(rank.unresolved_terms(tasks, hits), "unresolved")
        told = None if changed is None else tasks.select("task_id").crossJoin(changed.select("file").orderBy("file").limit(8))
    return pack.capsules(tasks, hits, gate, top, told, unresolved, seen, budget)


@dataclass
class Config:
    """What a session sets once."""

    budget: int = 1200
    hook_budget: int = 600
    map_budget: int = 400
    depth: int = 3
    semantic: bool = False
    model: str = ""


def expand(c: Corpus, handles: DataFrame) -> DataFrame:
    """task_id, file, from, to, lines of "file:line" handles (task_id, handle): two lines more on both sides; a document gives its section."""
    at = handles.select("task_id", tree.handle(F.col("handle")).alias("h")).select("task_id", "h.file", F.col("h.line").alias("sl"), F.col("h.line").alias("el")).filter("file <> '' AND sl IS NOT NULL")
    secs = c.sections.select("file", F.col("line").alias("lo"), F.col("end_line").alias("hi"), "text")
    doc = at.join(secs, "file").filter("lo <= sl AND sl <= hi").groupBy("task_id", "file", "sl").agg(F.min_by(F.struct("lo", "hi", "text"), "lo").alias("s"))
    doc = doc.select("task_id", "file", F.col("s.lo").alias("from"), F.col("s.hi").alias("to"), F.split("s.text", "\n").alias("lines"))
    code = tree.read_lines(c.files, at.join(c.docs.select("file"), "file", "left_anti"))
    return code.unionByName(doc)


def read(c: Corpus, wanted: DataFrame) -> DataFrame:
    """file, text: a document's extracted text, else the file's own."""
    own = c.files.select(F.col("path").alias("file"), F.col("text").alias("raw")).join(wanted.select("file").distinct(), "file", "left_semi")
    return own.join(c.docs.select("file", F.col("text").alias("doc")), "file", "left").select("file", F.coalesce("doc", "raw").alias("text"))


def related(c: Corpus, names: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(trails, impact) of symbols given by id or by a name that only one symbol has: names has task_id, name."""
    found = written(graph.find_symbol(c.symbols, names).filter("NOT ambiguous").select("task_id", "id"), "found")
    return graph.follow(c.edges, found, depth), graph.impact(c.edges, c.symbols, found, c.links)


def counted(df: DataFrame, name: str):
    """(df, metrics): how many rows pass, and how many tasks were answered in part, without another pass; read metrics.get after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.sum("tokens").alias("tokens")), seen
