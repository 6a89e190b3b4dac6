"""Operators on small hand-made tables, with the numbers worked out by hand or by another engine."""

import json
import sqlite3
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from beaconry import registry, rules
from beaconry.functions import porter
from beaconry.functions import text as T
from beaconry.operators import bm25, docs, evaluate, extract, graph, intervals, pack, rank
from beaconry.plans import engine
from beaconry.sources import tree
from beaconry.streaming import sessions

SYMBOL = "id string, file string, name string, kind string, sig string, doc string, sl int, el int, name_line int, exported boolean, test boolean, conf string, seq long"
EDGE = "src string, dst string, name string, kind string, conf string, at_file string, at_line int, seq long"


def sym(id_, file="a.py", name=None, kind="function", line=1, test=False, sig="", doc="", exported=True, seq=0):
    return (id_, file, name or id_, kind, sig, doc, line, line, line, exported, test, "exact", seq)


@pytest.fixture(scope="session")
def one(spark):
    """The value of an expression over one text."""
    return lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_terms(one):
    assert one(T.terms, "getUserName in src/store_test.go") == ["store_test.go", "getusername", "in", "src", "store", "test", "go", "get", "user", "name"]
    assert one(T.meaningful, "the Keep a x9") == ["keep", "x9"]
    assert one(lambda c: T.expand(T.meaningful(c)), "kept values") == ["kept", "keep", "values", "value"]
    assert one(T.token_estimate, "abcde") == 2 and one(T.token_estimate, "") == 1


def test_paths(one):
    assert one(T.dirname, "a/b/c.py") == "a/b" and one(T.dirname, "c.py") == "." and one(T.basename, "a/c.py") == "c.py"
    assert one(T.language, "x/y.TS") is None and one(T.language, "y.tsx") == "ts" and one(T.language, "y.scala") == "scala"
    assert one(T.is_test_file, "a/testing.py") is False and one(T.is_test_file, "a/x_test.go") is True and one(T.is_test_file, "tests/a.c") is True
    assert one(lambda c: T.module_path(F.lit("a/b/c.ts"), c), "../x/./y.js") == "a/x/y"
    assert one(T.moniker_name, "scip-go gomod pkg 1.0 `a/b`/Store#Put().") == "Put"


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalizations", "gener"), ("oscillators", "oscil"), ("keeping", "keep")])
def test_porter(word, want):
    assert porter.stem(word) == want


def test_bm25_is_that_of_a_full_text_engine(spark):
    rows = [(1, "keep the session store keep"), (2, "the quick brown fox keeps jumping over stores"), (3, "nothing here"), (4, "a session is kept in the store of sessions"), (5, "café store"), (6, "brown bread")]
    got = bm25.search(spark.createDataFrame(rows, "k int, text string"), spark.createDataFrame([(1, "session store keeping")], "task int, q string"), "k", "text", "task", "q", stem=True)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", rows)
    want = db.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH '\"session\" OR \"store\" OR \"keeping\"' ORDER BY 2 DESC").fetchall()
    assert [(r.k, r.score) for r in got.orderBy("rank").collect()] == [(k, pytest.approx(s, abs=2e-6)) for k, s in want]
    post = bm25.postings(spark.createDataFrame(rows, "k int, text string"), "k", "text")
    assert [(r.k, r.f) for r in bm25.phrase(post, ["brown", "fox"], "k").collect()] == [(2, 1)]


def test_html(one):
    html = "<h2>Tom &amp; Jerry &#65;&#x42; &#99999999; &unknown;</h2><!-- no --><script>x</script><p>See <a href=\"javascript:alert(1)\">bad</a> and <a href='/ok?a=1&amp;b=2'><b>good</b></a></p><pre>\n a &lt; b \n</pre><ul><li>one<li>two</ul>"
    text = one(docs.markdown, html)
    assert text.startswith("## Tom & Jerry AB &#99999999; &unknown;") and "bad and [good](/ok?a=1&b=2)" in text and "```\na < b\n```" in text and "- one\n- two" in text and "javascript" not in text and "no" not in text.split()
    assert one(docs.decode_entities, "&amp;lt; &amp;#65;") == "&lt; &#65;"
    assert one(docs.clean, "  a \t\r\n\n\n\nb ") == "a\n\nb"
    assert one(docs.rtf, r"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Keep \b archives\b0  for\par ten days.}") == "Keep archives for\nten days."


def test_sections(one):
    body = "word " * 20
    text = f"short\n# First\n{body}\n\nrest of it is long enough to stay here\n## Second\n{body}"
    got = [(s.line, s.end_line, s.text[:8]) for s in one(docs.sections, text)]
    assert got == [(1, 3, "# First\n"), (5, 5, "rest of "), (6, 7, "## Secon")]
    assert one(docs.sections, "") == [] and one(docs.sections, "tiny") == []
    assert len(one(docs.sections, "\n".join(["x" * 100] * 100))) == 3


def test_doc_links(spark):
    secs = spark.createDataFrame([("d.md", 0, "The StoreSession function in src/store.go keeps StoreSession"), ("d.md", 1, "nothing")], "file string, sec_idx int, text string")
    s = spark.createDataFrame([sym("src/store.go::StoreSession::3", "src/store.go", "StoreSession", seq=1), sym("x", "src/b.go", "ab", seq=2)], SYMBOL)
    got = {(r.section, r.kind, r.target) for r in docs.code_links(secs, s).collect()}
    assert got == {(0, "path", "src/store.go"), (0, "symbol", "src/store.go::StoreSession::3")}


def test_all_documents_get_links(spark):
    secs = spark.createDataFrame([(f"d{i:03}.md", 0, "uses Store1 Store2") for i in range(100)], "file string, sec_idx int, text string")
    s = spark.createDataFrame([sym(f"a::Store{k}", "a.go", f"Store{k}", seq=k) for k in (1, 2)], SYMBOL)
    assert {(r.doc, r.target) for r in docs.code_links(secs, s).collect()} == {(f"d{i:03}.md", f"a::Store{k}") for i in range(100) for k in (1, 2)}
    assert [(r.doc, r.mention) for r in docs.code_links(secs, s, total=3).collect()] == [("d000.md", "Store1"), ("d000.md", "Store2"), ("d001.md", "Store1")]


def test_all_artifacts_are_found(spark):
    files = spark.createDataFrame([("a.py", "".join(f'os.getenv("KEY_{i}")\n' for i in range(300)))], "path string, text string")
    assert extract.artifacts(files).count() == 300 and [r.name for r in extract.artifacts(files, most=2).collect()] == ["KEY_0", "KEY_1"]


def test_a_corpus_keeps_all_links_and_artifacts(spark):
    rows = [("a.py", "import os\n\ndef begin_all():\n    return [" + "".join(f'\n        os.getenv("KEY_{i}"),' for i in range(250)) + "\n    ]\n")]
    rows += [(f"d{i:02}.md", "# Guide\nCall the function begin_all first, as every one of these documents says.\n") for i in range(80)]
    c = engine.build(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows], "path string, content binary"))
    assert c.links.filter("mention = 'begin_all'").select("doc").distinct().count() == 80
    assert c.symbols.filter("kind = 'config'").count() == 250


def test_line_extractor(spark):
    go = 'package main\n\nimport "fmt"\n// Put stores\n// a value.\nfunc Put(k string) error {\n\treturn nil\n}\ntype Store = int\nconst Limit = 3\nclass Box:\nif x {\n'
    s, i = extract.by_lines(spark.createDataFrame([("cmd/main.go", go)], "path string, text string"))
    got = {(r.kind, r.name, r.sl, r.sig, r.doc) for r in s.collect()}
    assert ("function", "Put", 6, "func Put(k string) error", "Put stores a value.") in got and ("type", "Store", 9, "type Store = int", "") in got and ("class", "Box", 11, "class Box", "") in got
    assert [(r.module, r.local, r.at_line) for r in i.collect()] == [("fmt", "fmt", 3)] and ("const", "Limit", 10, "const Limit = 3", "") in got


def test_python_facts(spark):
    src = 'from os import path as p\nLIMIT = 3\n\n@app.get("/items")\ndef items():\n    """All of them."""\n    return load()\n\nclass Box(Base):\n    def put(self):\n        self.items()\n'
    s, e, i = extract.by_tree(spark.createDataFrame([("api.py", src), ("bad.py", "def (")], "path string, text string"))
    names = {(r.kind, r.name) for r in s.collect()}
    assert {("const", "LIMIT"), ("function", "items"), ("route", "GET /items"), ("class", "Box"), ("method", "put"), ("import", "p")} <= names
    assert {(r.src, r.name, r.kind) for r in e.collect()} == {("api.py::items::4", "load", "call"), ("api.py::items::4", "get", "call"), ("api.py::Box::9", "Base", "inherit"), ("api.py::put::10", "items", "call")}
    assert [(r.module, r.local) for r in i.collect()] == [("os", "p")]


def test_artifacts_and_strings(spark):
    files = spark.createDataFrame([("a.py", 'def f():\n    return os.getenv("API_KEY") + "a message" + \'a message\' + config.get("db.host")\n')], "path string, text string")
    got = {(r.name, r.doc, r.sl) for r in extract.artifacts(files).collect()}
    assert got == {("API_KEY", "environment variable", 2), ("db.host", "configuration key", 2)}
    s = spark.createDataFrame([sym("a.py::f::1", name="f"), sym("i", kind="import")], SYMBOL)
    got = {r.id: r.strings for r in extract.runtime_strings(s, files).collect()}
    assert got == {"a.py::f::1": ["API_KEY", "a message", "db.host"], "i": None}


def graph_tables(spark):
    s = spark.createDataFrame([sym(x, f"{x}.py", x, seq=i) for i, x in enumerate("abcde")], SYMBOL)
    e = [("a", "b", "b", "call"), ("b", "c", "c", "call"), ("c", "d", "d", "test"), ("e", "a", "a", "ref"), ("a", None, "z", "call")]
    return s, spark.createDataFrame([(*x, "resolved", f"{x[0]}.py", 1, i) for i, x in enumerate(e)], EDGE)


def test_resolution(spark):
    s = spark.createDataFrame([sym("1", "a/m.ts", "run", seq=1), sym("2", "a/m.ts", "run", seq=2), sym("3", "a/u.ts", "util", seq=3), sym("4", "b/u.ts", "util", seq=4), sym("5", "c.ts", "only", seq=5)], SYMBOL)
    i = spark.createDataFrame([("x/k.ts", "../b/u", "util", 1), ("x/k.ts", "gone", "ghost", 2)], "file string, module string, local string, seq long")
    names = [("a/m.ts", "run"), ("x/k.ts", "util"), ("x/k.ts", "ghost"), ("x/k.ts", "only"), ("a/u.ts", "util"), ("q.ts", "util")]
    e = spark.createDataFrame([("s", None, n, "call", "heuristic", f, 1, k) for k, (f, n) in enumerate(names)], EDGE)
    got = [(r.dst, r.conf) for r in graph.resolve(e, s, i).orderBy("seq").collect()]
    assert got == [("1", "resolved"), ("4", "resolved"), (None, "heuristic"), ("5", "resolved"), ("3", "exact"), (None, "heuristic")]


def test_follow_connect_impact(spark):
    s, e = graph_tables(spark)
    start = spark.createDataFrame([(1, "a")], "task_id int, id string")
    got = [(r.hop, r.path) for r in graph.follow(e, start, 2).orderBy("k").collect()]
    assert got == [(1, ["a", "b"]), (1, ["a", "e"]), (2, ["a", "b", "c"])]
    seeds = spark.createDataFrame([("a", 0), ("c", 1)], "id string, seed int")
    assert {(r.a, r.b) for r in graph.connect(e, seeds).collect()} == {("b", "c")}
    got = {(r.role, r.other, r.other_name) for r in graph.impact(e, s, start).collect()}
    assert got == {("callee", "b", "b"), ("callee", None, None), ("caller", "e", "e")}
    got = graph.blast_radius(e, s, spark.createDataFrame([("a.py",)], "file string")).collect()
    assert [(r.label, r.more) for r in got] == [("e via ref (e.py)", 0)]
    names = spark.createDataFrame([(1, "a"), (2, "nope")], "task_id int, name string")
    assert [(r.task_id, r.id, r.ambiguous) for r in graph.find_symbol(s, names).collect()] == [(1, "a", False)]
    block, calls = graph.map_dir(s, e, ".")
    assert block.count() == 5 and {r.label for r in calls.filter("kind = 'tests_out'").collect()} == {"d (c.py:1)"}


def test_overlay_is_idempotent(spark):
    s, e = graph_tables(spark)
    o = spark.createDataFrame([("a", "a.py", "a", "function", 1, 9, "sig", ""), ("n", "n.py", "n", None, 4, None, "", "doc")], "id string, file string, name string, kind string, line int, end_line int, sig string, doc string")
    once = graph.overlay_symbols(s, o)
    twice = graph.overlay_symbols(once, o)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    got = {r.id: (r.conf, r.el, r.kind) for r in once.collect()}
    assert got["a"] == ("exact", 9, "function") and got["n"] == ("exact", 4, "type") and len(got) == 6
    oe = spark.createDataFrame([("a", "b", "call", "a.py", 1), ("a", "n", "ref", "a.py", 2), ("a", "ghost", "ref", "a.py", 3)], "src string, dst string, kind string, at_file string, at_line int")
    merged = graph.overlay_edges(e, oe, once)
    again = graph.overlay_edges(merged, oe, once)
    assert merged.count() == again.count() == e.count() + 1 and merged.filter("src = 'a' AND dst = 'b'").first().conf == "exact"


def test_scip(spark, tmp_path):
    doc = {"relativePath": "a.go", "occurrences": [{"symbol": "x a/Put().", "range": [2, 5, 8], "enclosingRange": [2, 0, 9, 1], "symbolRoles": 4}, {"symbol": "x a/Get().", "range": [12, 5, 8], "enclosingRange": [], "symbolRoles": 4}, {"symbol": "x a/Get().", "range": [5, 2, 5], "enclosingRange": [], "symbolRoles": 16}, {"symbol": "x a/Put().", "range": [15, 1, 3], "enclosingRange": [], "symbolRoles": 16}], "symbols": [{"symbol": "x a/Put().", "kind": 17, "documentation": ["puts"], "relationships": [{"symbol": "x a/Get().", "isImplementation": True, "isReference": False}]}]}
    (tmp_path / "i.json").write_text(json.dumps({"documents": [doc]}))
    s, e = graph.scip_overlay(tree.scip(spark, str(tmp_path / "i.json")))
    assert {(r.id, r.end_line, r.doc) for r in s.collect()} == {("a.go::Put::3", 10, "puts"), ("a.go::Get::13", 13, "")}
    assert {(r.src, r.dst, r.kind) for r in e.collect()} == {("a.go::Put::3", "a.go::Get::13", "ref"), ("a.go::Get::13", "a.go::Put::3", "ref"), ("a.go::Put::3", "a.go::Get::13", "implement")}


def test_dir_cards(spark):
    s = spark.createDataFrame([sym("1", "src/a.go", "Put"), sym("2", "src/b.go", "main", "entry"), sym("3", "src/b_test.go", "TestPut", test=True, exported=False)], SYMBOL)
    d = spark.createDataFrame([("docs/a.md",)], "file string")
    c = graph.dir_cards(s, d)
    got = {r.dir: (r.files, r.lang, r.surface, r.entries, r.tests) for r in c.collect()}
    assert got == {"src": (3, "go", ["Put", "main"], ["src/b.go"], 1), "docs": (1, "md", [], [], 0)}
    hits = spark.createDataFrame([(1, "docs/a.md", 1.0), (1, "src/a.go", 2.0)], "task_id int, file string, score double")
    sem = spark.createDataFrame([(1, "docs", 0.4)], "task_id int, dir string, sim double")
    assert [r.dir for r in graph.rank_dirs(c, hits).orderBy("k").collect()] == ["src", "docs"] and graph.rank_dirs(c, hits, sem).orderBy("k").first().dir == "docs"


def test_cochange_stops_at_the_nth_pair(spark):
    c = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "b", 0), (1, "a", 1), (1, "d", 2)], "commit_seq int, file string, file_pos int")
    assert {(r.a, r.b): r.n for r in graph.cochange(c).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("b", "d"): 1, ("a", "d"): 1}
    assert {(r.a, r.b): r.n for r in graph.cochange(c, most=2).collect()} == {("a", "b"): 1, ("a", "c"): 1}


def test_lexical_score_and_relations(spark):
    s = spark.createDataFrame([sym("1", "src/store.py", "put_value", sig="def put_value(k)"), sym("2", "src/other.py", "helper"), sym("3", "tests/test_store.py", "test_put_value", test=True), sym("4", "src/store.py", "store", "import")], SYMBOL)
    e = spark.createDataFrame([("1", "2", "helper", "call", "exact", "src/store.py", 2, 0)], EDGE)
    tasks = spark.createDataFrame([("t", "put value in store"), ("p", "test_put_value fails"), ("x", "zebra")], "task_id string, text string")
    lex = rank.lexical(tasks, s, e)
    got = {(r.task_id, r.id): (round(r.base, 6), r.reason) for r in lex.collect()}
    # put, value: 2 * 2; store in the path: 1.5; exported 0.2; one edge 0.04
    assert got["t", "1"] == (5.74, ["identifier-match", "path-match"])
    assert got["p", "3"][0] == pytest.approx(2 * 4 + 6 + 1.5 * 1 + 0.6 + 0.2) and "test-name-pin" in got["p", "3"][1]
    assert not any(k[0] == "x" for k in got)
    added = {(r.task_id, r.id): r.added for r in rank.propagate(lex.select("task_id", "id", "base"), e).collect()}
    assert added["t", "2"] == pytest.approx(5.74 * 0.8 * 0.5)
    hits = rank.combine(lex, rank.propagate(lex.select("task_id", "id", "base"), e), s, tasks)
    got = {(r.task_id, r.id): round(r.score, 6) for r in hits.collect()}
    assert got["t", "2"] == 0.4 and got["t", "1"] == 5.74  # a symbol without a base is capped at 0.4
    gate = {r.task_id: r.confidence for r in rank.confidence(hits, tasks).collect()}
    assert gate == {"t": "strong", "p": "strong", "x": "empty"}
    assert {(r.task_id, r.term) for r in rank.unresolved_terms(tasks, hits).collect() if r.task_id == "x"} == {("x", "zebra")}


def facts(spark, sf):
    """Parts (id: brand, base, number, name) and distinct line items (src, dst, name, kind)."""
    parts = {f"p{r.p_partkey}": (r.p_brand, r.p_size / 10.0, r.p_partkey, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    return parts, {(f"p{r.l_partkey}", f"s{r.l_suppkey}", r.l_returnflag, "call" if r.l_linestatus == "F" else "ref") for r in lines}


def test_every_part_is_a_seed(spark, sf):
    parts, edges = facts(spark, sf)
    weight = {"call": 0.8, "ref": 0.3}
    g = [(s, t, weight[k]) for s, t, _, k in edges] + [(t, s, 0.3) for s, t in {(s, t) for s, t, n, _ in edges if n == "R"}]
    out = defaultdict(list)
    for s, t, w in g:
        out[s].append((t, w))
    want = defaultdict(float)
    for seed, (brand, base, _, _) in parts.items():
        for mid, w in out[seed] if base > 0 else []:
            want[brand, mid] += base * w * 0.5
            fan = max(1, len(out[mid]) - sum(t == seed for t, _ in out[mid]))
            for t, w2 in out[mid]:
                if t != seed:
                    want[brand, t] += base * w * w2 * 0.15 / fan
    got = {(r.task_id, r.id): r.added for r in registry.QUERIES["propagate_2hop_all"](spark, sf).collect()}
    assert {b for b, _ in got} == {p[0] for p in parts.values()} and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_every_part_gives_reasons(spark, sf):
    parts, edges = facts(spark, sf)
    score, want = defaultdict(float), set()
    for _, src, kind, dst in sorted({(parts[s][2], s, k, t) for s, t, _, k in edges}):
        brand, base, _, name = parts[src]
        x = base * {"call": 0.8, "ref": 0.3}[kind] * 0.5
        if base > 0 and x > 0.1 * score[brand, dst]:
            want.add((brand, dst, f"relation-to-{name}"))
        score[brand, dst] += x
    rows = registry.QUERIES["relation_reason_all"](spark, sf).collect()
    assert len(rows) == len(want) and {(r.task_id, r.id, r.reason) for r in rows} == want


def test_negative_scopes_and_changes(spark):
    s = spark.createDataFrame([sym("1", "src/a.py", "parse"), sym("2", "tests/a.py", "parse", test=True)], SYMBOL)
    e = spark.createDataFrame([], EDGE)
    tasks = spark.createDataFrame([("n", "parse excluding tests"), ("r", "what changed recently")], "task_id string, text string")
    changed = spark.createDataFrame([("src/a.py",)], "file string")
    got = {(r.task_id, r.id): round(r.base, 4) for r in rank.lexical(tasks, s, e, changed).collect()}
    assert got["n", "1"] == pytest.approx(3.4) and got["n", "2"] == round((2 + 1.5 + 0.6 + 0.2) * 0.05, 4) and got["r", "1"] == 1.4 and ("r", "2") not in got


def test_file_lane_and_semantics(spark):
    files = spark.createDataFrame([("LICENSE",), ("src/go.mod",), ("src/store.go",)], "file string")
    tasks = spark.createDataFrame([("a", "the LICENSE"), ("b", "store.go please")], "task_id string, text string")
    content = spark.createDataFrame([("src/store.go", "please")], "file string, term string")
    r = {(x.task_id, x.file): (x.score, x.named) for x in rank.rank_files(tasks, files, content).collect()}
    assert r["a", "LICENSE"] == (2.5, True) and r["b", "src/store.go"] == (2 * 3 + 0.75, True)
    hits = spark.createDataFrame([("a", "s", "x/y.go", "y", "function", "", 1, 1, 1, "exact", 3.0, ["path-match"], 1)], "task_id string, id string, file string, name string, kind string, sig string, sl int, el int, name_line int, conf string, score double, reason array<string>, rank int")
    fused = rank.fuse_files(hits, rank.rank_files(tasks, files, content)).filter("task_id = 'a'").orderBy("rank").collect()
    assert [(x.id, round(x.score, 3)) for x in fused] == [("file::LICENSE", 4.025), ("s", 3.0)]
    sem = spark.createDataFrame([("a", "n", 0.5), ("a", "s", 0.4)], "task_id string, id string, sim double")
    info = hits.select(F.lit("n").alias("id"), "file", "name", "kind", "sig", "sl", "el", "name_line", "conf")
    got = [(x.id, round(x.score, 3)) for x in rank.fuse_semantic(hits, sem, info, tasks).orderBy("rank").collect()]
    assert got == [("s", 3.4), ("n", 2.5)]


def test_explicit_files(spark):
    files = spark.createDataFrame([("src/store.go",), ("a/store.go",), ("b.py",)], "file string")
    tasks = spark.createDataFrame([("1", "look at `src/store.go:12`"), ("2", "only b.py"), ("3", "store")], "task_id string, text string")
    assert {(r.task_id, r.file) for r in rank.explicit_files(tasks, files).collect()} == {("1", "src/store.go"), ("1", "a/store.go"), ("2", "b.py")}


def test_capsules_fit_their_budget():
    hits = [{"name": f"f{i}", "kind": "entry" if i == 1 else "function", "file": f"src/{i}.go", "line": i, "sl": i, "el": i, "sig": "func f()", "reason": ["exact-name"] if i == 3 else ["path-match"], "conf": "exact", "score": 9.0 - i} for i in range(30)]
    for budget in (60, 150, 400, 4000):
        c = pack.greedy("find f", "strong", [dict(h) for h in hits], [{"text": "src/ files: 30"}], ["x.go"], ["find"], budget)
        assert pack.cost(c) <= budget or not c["hits"]
    assert c["hits"][0]["handle"] == "src-01" and not c["truncated"] and len(c["hits"]) == 30 and c["entries"] == ["src/1.go:1"]
    few = pack.greedy("find f", "strong", [dict(h) for h in hits], [], [], [], 260)
    assert any(h["name"] == "f3" for h in few["hits"])


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)], "task_id int, file string, rank int")
    want = spark.createDataFrame([(1, "b"), (1, "q"), (2, "a")], "task_id int, file string")
    assert {r.task_id: (r.recall, r.rr) for r in evaluate.recall(hits, want).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    v = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "g int, v double")
    assert {r.g: r.v for r in evaluate.percentile(v, "g", "v", 0.95).collect()} == {0: 18.0, 1: 19.0}
    m = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4)], "k int, m double")
    assert [r.regressed for r in evaluate.verdict(m, "k", ["m"]).orderBy("k").collect()] == [False, True, False]
    h = spark.createDataFrame([(1, "a", 1, 9)], "task_id int, file string, sl int, el int")
    w = spark.createDataFrame([(1, "a", 2, 3), (1, "a", 8, 12)], "task_id int, file string, sl int, el int")
    assert [(r.found, r.total) for r in evaluate.evidence(h, w).collect()] == [(1, 2)]


def test_intervals(spark):
    p = spark.createDataFrame([("k", 5), ("k", 25)], "k string, at long")
    s = spark.createDataFrame([("k", 1, 10, "x"), ("k", 4, 30, "y")], "k string, lo long, hi long, name string")
    assert {(r.at, r.name) for r in intervals.containing(p, s, "k", "at", "lo", "hi", 7).collect()} == {(5, "x"), (5, "y"), (25, "y")}
    right = spark.createDataFrame([("k", 5, 1), ("k", 6, 2)], "k string, at long, v int")
    assert {(r.at, r.v) for r in intervals.as_of(p, right, "k", "at", "v").collect()} == {(5, 1), (25, 2)}


def test_tree_scan(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    for name, text in {"a.py": "x = 1\n", "src/__init__.py": "", "b.log": "no", "src/c.go": "package c", "src/d.gen.go": "no", "src/sub/e.md": "# E", "node_modules/f.js": "no", ".gitignore": "*.log\n", "src/.gitignore": "*.gen.go\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "src/loop").symlink_to(tmp_path / "src")
    (tmp_path / "out").symlink_to("/etc")
    assert tree.walk(str(tmp_path)) == [".gitignore", "a.py", "src/.gitignore", "src/__init__.py", "src/c.go", "src/sub/e.md"]
    files = tree.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == set(tree.walk(str(tmp_path)))
    before = tree.manifest(files).collect()
    (tmp_path / "a.py").write_text("x = 2\n")
    change = tree.diff(tree.manifest(tree.scan(spark, str(tmp_path))), spark.createDataFrame(before)).collect()
    assert [(r.path, r.change) for r in change] == [("a.py", "edited")]
    assert len(tree.fingerprint(spark.createDataFrame(before)).first().tree) == 12
    path = tree.write_snapshot(spark.createDataFrame(before), str(tmp_path / "snap"), "manifest", "s1")
    assert tree.read_snapshot(spark, str(tmp_path / "snap"), "manifest", "s1").count() == 6 and path.endswith("snapshot=s1")
    assert tree.read_snapshot(spark, str(tmp_path / "snap"), "manifest", "s2") is None


def test_captured_text(spark):
    s = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ('?? "b c.py"',)], "value string")
    assert {r.file for r in tree.status(s).collect()} == {"a.py", "old.py", "new.py", "b c.py"}
    log = spark.createDataFrame([("\0\na.py\nb.py\n\0\nc.py\n",)], "value string")
    assert {(r.commit_seq, r.file, r.file_pos) for r in tree.log(log).collect()} == {(1, "a.py", 0), (1, "b.py", 1), (2, "c.py", 0)}


def test_overlay_file(spark, tmp_path):
    (tmp_path / "facts.json").write_text(json.dumps({"version": 1, "symbols": [{"id": "a", "file": "a.py", "name": "a", "kind": "type", "line": 1}], "edges": [{"from": "a.py::a::1", "to": "", "kind": "ref", "at": "a.py:7"}]}))
    s, e = tree.overlay(spark, str(tmp_path / "facts.json"))
    assert s.count() == 1 and [(r.src, r.dst, r.at_file, r.at_line) for r in e.collect()] == [("a.py::a::1", None, "a.py", 7)]
    (tmp_path / "facts.json").write_text(json.dumps({"version": 2, "symbols": []}))
    assert tree.overlay(spark, str(tmp_path / "facts.json"))[0].count() == 0


def test_streams(spark, tmp_path):
    rows = [("u", "a", "t1"), ("u", "a", "t1"), ("u", "b", "t1"), ("u", "a", "t2"), ("v", "a", "t1")]
    spark.createDataFrame(rows, "session string, item string, tree string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, item string, tree string").json(str(tmp_path / "in"))
    q = sessions.novelty_stream(stream).writeStream.format("memory").queryName("novel").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT session, item, tree, sum(CAST(new AS INT)) AS n FROM novel GROUP BY ALL ORDER BY ALL").collect() == [("u", "a", "t1", 1), ("u", "a", "t2", 1), ("u", "b", "t1", 1), ("v", "a", "t1", 1)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("one")
    files = sessions.new_files(spark, str(tmp_path / "src"))
    q = files.writeStream.foreachBatch(sessions.upsert(str(tmp_path / "facts"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "src/b.txt").write_text("two")
    q.processAllAvailable()
    q.stop()
    assert {r.path.rsplit("/", 1)[1] for r in sessions.latest(spark, str(tmp_path / "facts")).collect()} == {"a.txt", "b.txt"}


def test_observe_end_to_end(spark):
    files = {
        "src/store.py": "import os\n\ndef put_session(key):\n    \"\"\"Store a session.\"\"\"\n    return check_key(key)\n\ndef check_key(key):\n    return os.getenv(\"SESSION_SECRET\")\n",
        "src/main.py": "from store import put_session\n\ndef main():\n    put_session(1)\n",
        "docs/guide.md": "# Sessions\nThe put_session function keeps a session until it expires, as told here.\n",
    }
    rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    c = engine.build(rows)
    assert {(r.src, r.dst) for r in c.edges.filter("dst IS NOT NULL").collect()} >= {("src/store.py::put_session::3", "src/store.py::check_key::7"), ("src/main.py::main::3", "src/main.py::put_session::1")}
    assert c.symbols.filter("name = 'SESSION_SECRET' AND kind = 'config'").count() == 1 and c.links.filter("mention = 'put_session'").count() == 1
    tasks = spark.createDataFrame([("a", "put_session"), ("b", "zebra quantum"), ("c", "session guide documentation")], "task_id string, text string")
    got = {r.task_id: r for r in engine.observe(c, tasks, budget=400).collect()}
    assert got["a"].hits[0].startswith("src/store.py:3 put_session") and got["a"].confidence == "strong" and got["a"].tokens <= 400
    assert got["b"].confidence == "empty" and got["b"].hits == [] and "zebra" in got["b"].unresolved
    assert any(h.startswith("docs/guide.md") for h in got["c"].hits)


def test_every_rule_table_is_whole():
    assert len(rules.STOP_WORDS) > 90 and len(rules.BASE_OF) > 80
    assert len(rules.TEST_FILES) == len(rules.ENTRY_FILES) == 18 and len(rules.EDGE_WEIGHTS) == 7


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - {"lexical_score", "propagate_2hop"}))
def test_against_duckdb(spark, sf, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = db.execute(registry.ORACLE[name])
    cols = [x[0] for x in found.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect()) == want


def test_navigation_of_a_corpus(spark):
    rows = [("a.py", "def one():\n    return two()\n\n\ndef two():\n    return 2\n"), ("g.md", "# Guide\nUse the function one to begin, then read on about two.\n")]
    c = engine.build(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows], "path string, content binary"))
    got = {r.file: (r["from"], r["to"]) for r in engine.expand(c, spark.createDataFrame([(1, "a.py:2"), (2, "g.md:2"), (3, "nothing")], "task_id int, handle string")).collect()}
    assert got == {"a.py": (1, 4), "g.md": (1, 2)}
    assert engine.read(c, spark.createDataFrame([("g.md",)], "file string")).first().text.startswith("# Guide")
    trails, found = engine.related(c, spark.createDataFrame([(1, "two")], "task_id int, name string"))
    assert [r.path for r in trails.collect()] == [["a.py::two::5", "a.py::one::1"]] and {(r.role, r.other_name) for r in found.filter("role = 'caller'").collect()} == {("caller", "one")}
    df, seen = engine.counted(engine.observe(c, spark.createDataFrame([("x", "two")], "task_id string, text string")), "capsules")
    assert df.count() == 1 and seen.get["rows"] == 1
