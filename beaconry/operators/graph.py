"""Property-graph operators over symbols(id, file, name, ..., seq) and edges(src, dst, name, kind, conf, at_file, at_line, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry import rules
from beaconry.functions import text as T

SURFACE, ENTRIES, CARDS = 3, 2, 3


def resolve(edges: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """edges with dst and conf filled in, in three tiers.

    1. a symbol of that name in the same file: exact if it is the only one, else the first, resolved
    2. an alias that the file imports: of the symbols of that name the one in the
       imported module's file, else in a file of the module's base name, else the first
    3. a name that only one symbol of all files has
    Each tier is an equal-key join against an aggregated side, so a frequent name is one row.
    """
    local = symbols.groupBy(F.col("file").alias("at_file"), "name").agg(F.min_by("id", "seq").alias("l_id"), F.count("*").alias("l_n"))
    alias = imports.groupBy(F.col("file").alias("at_file"), F.col("local").alias("name")).agg(F.max_by("module", "seq").alias("module"))
    bare = F.regexp_replace("file", r"\.[^./]+$", "")
    glob = symbols.groupBy("name").agg(F.min_by("id", "seq").alias("g_id"), F.min_by("file", "seq").alias("g_file"), F.count("*").alias("g_n"))
    by_path = symbols.groupBy("name", bare.alias("m_path")).agg(F.min_by("id", "seq").alias("p_id"))
    by_base = symbols.groupBy("name", T.basename(bare).alias("m_base")).agg(F.min_by("id", "seq").alias("b_id"))
    e = edges.join(local, ["at_file", "name"], "left").join(alias, ["at_file", "name"], "left").join(glob, "name", "left")
    e = e.withColumn("m_path", T.module_path(F.col("at_file"), F.col("module"))).withColumn("m_base", T.basename(F.col("module")))
    e = e.join(by_path, ["name", "m_path"], "left").join(by_base, ["name", "m_base"], "left")
    bound = F.col("module").isNotNull()
    only = (F.col("g_n") == 1) & (F.col("g_file") != F.col("at_file"))
    dst = F.coalesce("dst", "l_id", F.when(bound, F.coalesce("p_id", "b_id", "g_id")), F.when(~bound & only, F.col("g_id")))
    conf = (
        F.when(F.col("dst").isNotNull(), F.col("conf")).when(F.col("l_n") == 1, "exact").when(F.col("l_n") > 1, "resolved")
        .when(bound & F.col("g_id").isNotNull(), "resolved").when(bound, "heuristic").when(only, "resolved").otherwise(F.col("conf"))
    )
    return e.select("src", dst.alias("dst"), "name", "kind", conf.alias("conf"), "at_file", "at_line", "seq")


def overlay_symbols(symbols: DataFrame, over: DataFrame) -> DataFrame:
    """Upsert by id: matches become exact, take the overlay's end line and signature; others are added. Applying it twice changes nothing."""
    o = over.dropDuplicates(["id"]).select("id", *(F.col(c).alias(f"o_{c}") for c in ("file", "name", "kind", "line", "end_line", "sig", "doc")), F.lit(True).alias("o_in"))
    j = symbols.withColumn("s_in", F.lit(True)).join(o, "id", "full_outer")
    new = F.col("s_in").isNull()
    pick = {
        "file": F.coalesce("file", "o_file"), "kind": F.coalesce("kind", "o_kind", F.lit("type")), "name": F.coalesce("name", "o_name"), "sig": F.coalesce(F.nullif("o_sig", F.lit("")), "sig", F.lit("")),
        "sl": F.coalesce("sl", "o_line"), "el": F.coalesce("o_end_line", "el", "o_line"), "name_line": F.coalesce("name_line", "o_line"), "exported": F.coalesce("exported", F.lit(True)),
        "test": F.coalesce("test", F.lit(False)), "doc": F.coalesce(F.when(new, F.col("o_doc")).otherwise(F.col("doc")), F.lit("")), "conf": F.when(F.col("o_in"), "exact").otherwise(F.col("conf")),
    }
    return j.select("id", *(pick.get(c, F.col(c)).alias(c) for c in symbols.columns if c != "id"))


def overlay_edges(edges: DataFrame, over: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges keyed by (src, dst, kind, at): known ones become exact, new ones are added once; unknown end points are dropped."""
    known = ids.select("id").distinct()
    o = over.join(known.select(F.col("id").alias("src")), "src", "left_semi")
    loose = o.filter("dst IS NULL")
    o = o.filter("dst IS NOT NULL").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select(*o.columns).unionByName(loose)
    key = ["src", "dst", "kind", "at_file", "at_line"]
    o = o.dropDuplicates(key)
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    mark = o.select(*key).withColumn("hit", F.lit(True))
    kept = edges.join(mark, same(edges, mark), "left").select(*(edges[c] for c in edges.columns if c != "conf"), F.when(F.col("hit") & edges["dst"].isNotNull(), "exact").otherwise(edges["conf"]).alias("conf"))
    new = o.join(edges.select(*key), same(o, edges), "left_anti").withColumn("name", F.coalesce(F.nullif(F.get(F.split("dst", "::"), 1), F.lit("")), "dst", F.lit("")))
    new = new.withColumn("conf", F.when(F.col("dst").isNotNull(), "exact").otherwise("heuristic")).withColumn("seq", F.lit(None).cast(dict(edges.dtypes)["seq"]))
    return kept.unionByName(new.select(*kept.columns))


def adjacency(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """a, b, dir (out or in) and the edge's columns: each resolved edge from both of its ends."""
    e = edges.filter("dst IS NOT NULL AND src IS NOT NULL")
    e = e.filter(F.col("kind").isin(*kinds)) if kinds else e
    rest = [c for c in e.columns if c not in ("src", "dst")]
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("out").alias("dir"), *rest)
    return out.unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("in").alias("dir"), *rest))


def find_symbol(symbols: DataFrame, names: DataFrame, task: str = "task_id") -> DataFrame:
    """task, id, file, line, ambiguous: an id wins; a bare name gives all that have it."""
    by_id = names.join(symbols, names["name"] == symbols["id"]).select(task, "id", "file", "name_line", F.lit(0).alias("tier"))
    by_name = names.join(symbols.withColumnRenamed("name", "s_name"), F.col("name") == F.col("s_name")).select(task, "id", "file", "name_line", F.lit(1).alias("tier"))
    w = Window.partitionBy(task)
    both = by_id.union(by_name).withColumn("best", F.min("tier").over(w)).filter("tier = best")
    return both.select(task, "id", "file", F.col("name_line").alias("line"), (F.count("*").over(w) > 1).alias("ambiguous"))


def follow(edges: DataFrame, start: DataFrame, depth: int = 3, trails: int = 8, kinds: list[str] | None = None, task: str = "task_id") -> DataFrame:
    """task, hop, node, path: breadth-first walks over edges in both directions, many tasks at once.

    start: task, id. A node is visited while a further hop follows, so the last
    hop may reach seen nodes; parallel edges give trails of their own. At most
    `trails` a task, in the order of hops, trails, direction and edges. One join a hop.
    """
    adj = adjacency(edges, kinds).withColumn("d", F.when(F.col("dir") == "out", 0).otherwise(1))
    frontier = start.select(task, F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("ord"))
    seen = frontier.select(task, "node")
    out = None
    for hop in range(1, depth + 1):
        step = frontier.join(adj, frontier["node"] == adj["a"]).select(task, F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.concat("ord", F.array(F.col("d").cast("long"), F.col("seq").cast("long"))).alias("ord"))
        step = step.join(seen.distinct(), [task, "node"], "left_anti")
        rank = Window.partitionBy(task).orderBy("ord")
        step = step.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= trails).withColumn("hop", F.lit(hop))
        out = step if out is None else out.unionByName(step)
        first = Window.partitionBy(task, "node").orderBy("ord")
        frontier = step.withColumn("f", F.row_number().over(first)).select(task, "node", "path", "ord")
        seen = seen.union(frontier.select(task, "node"))
    order = Window.partitionBy(task).orderBy("hop", "ord")
    return out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= trails).select(task, "k", "hop", "node", "path")


def connect(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 12) -> DataFrame:
    """a, b, kind: the edges at which the regions around the seeds meet, each unordered pair once.

    seeds: id, seed (its number). Regions grow hop by hop; a node belongs to the
    smallest seed that reaches it first.
    """
    e = edges.filter("dst IS NOT NULL AND src IS NOT NULL")
    adj = adjacency(e).select("a", "b")
    label = seeds.groupBy(F.col("id").alias("node")).agg(F.min("seed").alias("seed")).withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        new = label.filter(F.col("hop") == hop - 1).join(adj, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("seed").alias("seed"))
        label = label.unionByName(new.join(label.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
    s = label.select(F.col("node").alias("src"), F.col("seed").alias("s1"), F.col("hop").alias("h1"))
    d = label.select(F.col("node").alias("dst"), F.col("seed").alias("s2"), F.col("hop").alias("h2"))
    meet = e.join(s, "src").join(d, "dst").filter("s1 <> s2").filter(F.least("h1", "h2") < depth)
    pair = meet.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min_by(F.struct("src", "dst", "kind"), "seq").alias("e"), F.min(F.least("h1", "h2")).alias("hop"))
    return pair.orderBy("hop", "lo", "hi").limit(most).select(F.col("e.src").alias("a"), F.col("e.dst").alias("b"), F.col("e.kind").alias("kind"))


def impact(edges: DataFrame, symbols: DataFrame, targets: DataFrame, links: DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """task, role, name, other, kind, at_file, at_line, conf: callers, callees, relations, tests and documentation of targets(task, id)."""
    names = symbols.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    cols = [task, "role", "name", "other", "kind", "at_file", "at_line", "conf"]
    role_in = F.when(F.col("kind").isin("call", "ref"), "caller").when(F.col("kind") == "test", "test").otherwise("relation")
    into = targets.join(edges, targets["id"] == edges["dst"]).withColumn("role", role_in).withColumn("other", F.col("src"))
    role_out = F.when(F.col("kind").isin("call", "ref"), "callee").when(F.col("kind").isin("inherit", "implement", "contain"), "relation")
    from_ = targets.join(edges, targets["id"] == edges["src"]).withColumn("role", role_out).filter("role IS NOT NULL").withColumn("other", F.col("dst"))
    both = into.select(*cols).union(from_.select(*cols))
    if links is not None:
        said = targets.join(links.filter("kind = 'symbol'"), targets["id"] == links["target"])
        rank = Window.partitionBy(task).orderBy("doc", "section")
        said = said.withColumn("k", F.row_number().over(rank)).filter("k <= 6")
        both = both.union(said.select(task, F.lit("documented_by"), "mention", "doc", F.lit("doc"), "doc", F.col("section").cast("int"), F.lit("heuristic")))
    return both.join(names, "other", "left").select(*cols, "other_name")


def blast_radius(edges: DataFrame, symbols: DataFrame, files: DataFrame, cap: int = 8) -> DataFrame:
    """file, k, label, more: who outside a file uses what it defines; `more` counts what lies beyond the cap."""
    own = symbols.select(F.col("id").alias("dst"), F.col("file").alias("d_file"))
    src = symbols.select(F.col("id").alias("src"), F.col("file").alias("s_file"), F.col("name").alias("s_name"))
    e = edges.join(own, "dst").join(files.select(F.col("file").alias("d_file")).distinct(), "d_file", "left_semi").join(src, "src", "left")
    e = e.filter(~F.col("d_file").eqNullSafe(F.col("s_file")))
    name = F.coalesce("s_name", "name")
    e = e.select(F.col("d_file").alias("file"), F.concat(name, F.lit(" via "), F.col("kind"), F.lit(" ("), F.coalesce(T.basename(F.col("s_file")), F.lit("")), F.lit(")")).alias("label"), "seq")
    e = e.groupBy("file", "label").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("file")
    e = e.withColumn("k", F.row_number().over(w.orderBy("seq", "label"))).withColumn("n", F.count("*").over(w))
    return e.filter(F.col("k") <= cap).select("file", "k", "label", F.greatest(F.lit(0), F.col("n") - cap).alias("more"))


def dir_cards(symbols: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """dir, files, lang, surface, entries, tests of every directory; documents only add files."""
    s = symbols.select(T.dirname(F.col("file")).alias("dir"), "file", "name", "kind", "exported", "test")
    if docs is not None:
        none = docs.select(T.dirname(F.col("file")).alias("dir"), "file", F.lit(None).cast("string").alias("name"), F.lit("doc").alias("kind"), F.lit(False).alias("exported"), F.lit(False).alias("test"))
        s = s.unionByName(none)
    ext = F.substring_index("file", ".", -1)
    out = s.groupBy("dir").agg(F.countDistinct("file").alias("files"), F.array_sort(F.collect_set(F.when(F.length(ext) <= 4, ext))).alias("langs"), F.sum(F.col("test").cast("long")).alias("tests"))

    def first(rows: DataFrame, value: str, most: int, to: str) -> DataFrame:
        """dir and its first different values in order; a directory's other values never come together."""
        rows = rows.filter(F.col(value).isNotNull()).select("dir", value).distinct()
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("dir").orderBy(value))).filter(F.col("k") <= most)
        return rows.groupBy("dir").agg(F.array_sort(F.collect_list(value)).alias(to))

    surface = first(s.filter(F.col("exported") & ~F.col("kind").isin("import", "test")), "name", SURFACE, "surface")
    out = out.join(surface, "dir", "left").join(first(s.filter("kind = 'entry'"), "file", ENTRIES, "entries"), "dir", "left")
    lang, none = F.array_join("langs", "/"), F.array().cast("array<string>")
    return out.select("dir", "files", F.when(lang == "", "text").otherwise(lang).alias("lang"), F.coalesce("surface", none).alias("surface"), F.coalesce("entries", none).alias("entries"), "tests")


def rank_dirs(cards: DataFrame, hits: DataFrame, semantic: DataFrame | None = None, task: str = "task_id", most: int = CARDS) -> DataFrame:
    """task, k and the card: directories by summed hit scores; semantic ones (task, dir, sim), if any, first."""
    score = hits.groupBy(task, T.dirname(F.col("file")).alias("dir")).agg(F.sum("score").alias("score")).withColumn("tier", F.lit(1))
    if semantic is not None:
        score = score.unionByName(semantic.select(task, "dir", F.col("sim").alias("score"), F.lit(0).alias("tier")))
    score = score.join(cards.select("dir"), "dir", "left_semi")
    first = Window.partitionBy(task, "dir").orderBy("tier", F.desc("score"))
    score = score.withColumn("f", F.row_number().over(first)).filter("f = 1")
    order = Window.partitionBy(task).orderBy("tier", F.desc(F.round("score", 9)), "dir")
    return score.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select(task, "k", "dir", "score").join(cards, "dir")


def render_card():
    """A directory card as text."""
    tests = F.when(F.col("tests") > 0, F.concat(F.lit(", tests: "), F.col("tests").cast("string"))).otherwise("")
    head = F.concat(F.col("dir"), F.lit("/ files: "), F.col("files").cast("string"), F.lit(", "), F.col("lang"), tests)
    return F.concat_ws("\n", head, F.when(F.size("surface") > 0, F.concat(F.lit("  public "), F.array_join("surface", ", "))), F.when(F.size("entries") > 0, F.concat(F.lit("  entry "), F.array_join("entries", ", "))))


def map_dir(symbols: DataFrame, edges: DataFrame, dir_: str, files: int = 12, each: int = 5, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(file, k, id, name, line, truncated), (file, kind, label) of a directory; "." means root files only."""
    inside = ~F.col("file").contains("/") if dir_ == "." else F.col("file").startswith(dir_.rstrip("/") + "/")
    s = symbols.filter((F.col("kind") != "import") & inside).withColumn("f", F.dense_rank().over(Window.orderBy("file")))
    s = s.withColumn("n_files", F.max("f").over(Window.partitionBy()))
    shown = s.filter(F.col("f") <= files).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("name_line", "id")))
    block = shown.filter(F.col("k") <= each).select("file", "k", "id", "name", F.col("name_line").alias("line"), (F.col("n_files") > files).alias("truncated"))
    e = edges.filter((F.col("kind") == "call") & F.col("dst").isNotNull() | (F.col("kind") == "test")).join(shown.select(F.col("id").alias("src"), "file"), "src")
    to = F.when(F.col("kind") == "call", F.concat(F.lit(" -> "), F.coalesce(F.get(F.split("dst", "::"), 1), "dst"))).otherwise("")
    e = e.select("file", "kind", F.concat("name", to, F.lit(" ("), "at_file", F.lit(":"), F.col("at_line").cast("string"), F.lit(")")).alias("label"), "seq")
    e = e.groupBy("file", "kind", "label").agg(F.min("seq").alias("seq")).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("seq", "label")))
    return block, e.filter(F.col("k") <= most).select("file", F.when(F.col("kind") == "call", "calls").otherwise("tests_out").alias("kind"), "label")


def cochange(commits: DataFrame, most: int = 80, files: int = 12, last: int = 20) -> DataFrame:
    """a, b, n: files that changed together, over the last commits; counting stops at the `most`-th different pair."""
    c = commits.filter((F.col("file_pos") < files) & (F.col("commit_seq") < last)).select("commit_seq", "file", "file_pos")
    d = c.select("commit_seq", F.col("file").alias("file2"), F.col("file_pos").alias("pos2"))
    pairs = c.join(d, "commit_seq").filter("file_pos < pos2").select(F.least("file", "file2").alias("a"), F.greatest("file", "file2").alias("b"), F.struct("commit_seq", "file_pos", "pos2").alias("at"))
    first = pairs.groupBy("a", "b").agg(F.min("at").alias("at"))
    cut = first.orderBy("at").limit(most).agg(F.max("at").alias("cut"), F.count("*").alias("k"))
    kept = pairs.crossJoin(F.broadcast(cut)).filter((F.col("at") <= F.col("cut")) | (F.col("k") < most))
    return kept.groupBy("a", "b").agg(F.count("*").alias("n"))


def scip_overlay(documents: DataFrame, definition: int = rules.SCIP_DEFINITION, reference: int = rules.SCIP_REFERENCE) -> tuple[DataFrame, DataFrame]:
    """(overlay symbols, overlay edges) from documents(relativePath, occurrences, symbols).

    A reference belongs to the first definition that contains it, else to the
    nearest one before it in the document.
    """
    occ = documents.select(F.col("relativePath").alias("file"), F.explode("occurrences").alias("o")).select("file", "o.symbol", F.col("o.range").alias("r"), F.col("o.enclosingRange").alias("er"), F.col("o.symbolRoles").alias("roles"))
    at = lambda r, i: F.try_element_at(r, F.lit(i + 1))
    end = lambda r: F.when(F.size(r) >= 4, at(r, 2)).otherwise(at(r, 0))
    end_char = lambda r: F.when(F.size(r) >= 4, at(r, 3)).otherwise(at(r, 2))
    occ = occ.withColumn("er", F.when(F.size("er") > 0, F.col("er")).otherwise(F.col("r")))
    d = occ.filter(F.col("roles").bitwiseAND(definition) != 0).withColumn("name", T.moniker_name(F.col("symbol"))).filter("name <> ''")
    d = d.select("file", "symbol", "name", (at(F.col("r"), 0) + 1).alias("line"), at(F.col("er"), 0).alias("sl"), at(F.col("er"), 1).alias("sc"), end(F.col("er")).alias("el"), end_char(F.col("er")).alias("ec"))
    d = d.withColumn("id", F.concat_ws("::", "file", "name", F.col("line").cast("string")))
    info = documents.select(F.explode("symbols").alias("i")).select("i.symbol", F.array_join("i.documentation", " ").alias("doc"), "i.relationships")
    symbols = d.join(info, "symbol", "left").select("id", "file", "name", F.lit("type").alias("kind"), "line", (F.col("el") + 1).alias("end_line"), F.lit("").alias("sig"), F.coalesce("doc", F.lit("")).alias("doc"))
    r = occ.filter(F.col("roles").bitwiseAND(reference) != 0).select("file", F.col("symbol").alias("to"), at(F.col("r"), 0).alias("rl"), at(F.col("r"), 1).alias("rc"), F.monotonically_increasing_id().alias("rid"))
    before = (F.col("rl") > F.col("sl")) | ((F.col("rl") == F.col("sl")) & (F.col("rc") >= F.col("sc")))
    inside = (F.col("rl") < F.col("el")) | ((F.col("rl") == F.col("el")) & (F.col("rc") < F.greatest("ec", F.col("sc") + 1)))
    j = r.join(d.select("file", F.col("id").alias("src"), "sl", "sc", "el", "ec"), "file").filter(before)
    pick = F.when(inside, F.struct(F.lit(1).alias("t"), (-F.col("sl")).alias("x"), (-F.col("sc")).alias("y"))).otherwise(F.struct(F.lit(0).alias("t"), F.col("sl").alias("x"), F.col("sc").alias("y")))
    best = j.groupBy("rid", "file", "to", "rl").agg(F.max_by("src", pick).alias("src"))
    ids = d.select(F.col("symbol").alias("to"), F.col("id").alias("dst"))
    refs = best.join(ids, "to", "left").filter("dst IS NULL OR dst <> src").select("src", "dst", F.lit("ref").alias("kind"), F.col("file").alias("at_file"), (F.col("rl") + 1).alias("at_line"))
    rel = info.select("symbol", F.explode("relationships").alias("x")).join(d.select("symbol", F.col("id").alias("src"), "file"), "symbol").withColumn("to", F.col("x.symbol")).join(ids, "to", "left")
    rels = rel.select("src", "dst", F.when(F.col("x.isImplementation"), "implement").otherwise("ref").alias("kind"), F.col("file").alias("at_file"), F.lit(1).alias("at_line"))
    return symbols, refs.unionByName(rels)
