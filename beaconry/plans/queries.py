"""The engine's operators over the test tables, each with its DuckDB counterpart.

Roles: documents and pages are the documents, benchmark texts and conversation
turns the tasks, parts the symbols, line items the edges between parts and
suppliers, events the event stream, embeddings the vectors, labels the judgements.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry import rules
from beaconry.functions import text as T
from beaconry.operators import bm25, docs, evaluate, extract, graph, intervals, pack, rank
from beaconry.sources import tree
from beaconry.streaming import sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(items)) + "]"


STOP = _sql_list(rules.STOP_WORDS)


def _sql_terms(c: str) -> str:
    """terms() in DuckDB, as a set."""
    return (
        f"list_distinct(list_filter(list_concat(list_filter(regexp_split_to_array(lower({c}), '[\\\\/\\s,]+'), lambda x: regexp_matches(x, '[._-]')), "
        f"regexp_extract_all(lower({c}), '[a-z0-9]+'), list_transform(regexp_extract_all({c}, '[A-Z][a-z0-9]*|[a-z][a-z0-9]*'), lambda x: lower(x))), lambda x: x <> ''))"
    )


def _sql_words(c: str) -> str:
    return f"regexp_extract_all(translate(lower({c}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+')"


# --- roles ---------------------------------------------------------------------------------------------------------

PARTS = "lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py'"
SYMBOLS = f"""SELECT 'p' || p_partkey AS id, {PARTS} AS file, p_name AS name, p_type AS sig, p_partkey AS seq, CAST(p_size AS INTEGER) AS name_line,
    CASE WHEN p_size % 5 = 0 THEN 'config' WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END AS kind, p_size % 2 = 0 AS exported, p_size % 7 = 0 AS test FROM part"""
EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS name, CASE l_linestatus WHEN 'F' THEN 'call' ELSE 'ref' END AS kind FROM lineitem"


def _symbols(spark, d):
    p = _t(spark, d, "part")
    file = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit(".py"))
    kind = F.when(F.col("p_size") % 5 == 0, "config").when(F.col("p_size") % 3 == 0, "class").otherwise("function")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), file.alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("sig"), F.lit("").alias("doc"), F.col("p_partkey").alias("seq"),
        F.col("p_size").alias("name_line"), F.col("p_size").alias("sl"), F.col("p_size").alias("el"), kind.alias("kind"), (F.col("p_size") % 2 == 0).alias("exported"), (F.col("p_size") % 7 == 0).alias("test"), F.lit("resolved").alias("conf"),
    )


def _edges(spark, d):
    e = _t(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("name"),
        F.when(F.col("l_linestatus") == "F", "call").otherwise("ref").alias("kind"),
    )
    return e.distinct().select("*", F.lit("resolved").alias("conf"), F.col("src").alias("at_file"), F.lit(1).alias("at_line"), F.xxhash64("src", "dst", "name", "kind").alias("seq"))


def _tasks(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), "text")


# --- text ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest({_sql_terms('text')}) AS term FROM documents")
def terms_tokenize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))


@query(f"SELECT conv_id, turn, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM conversations")
def meaningful_terms(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.explode(T.meaningful(F.col("text"))).alias("term"))


_BASES = ", ".join(f"('{f}', '{b}')" for f, b in sorted(rules.BASE_OF.items()))


@query(f"""WITH m(form, base) AS (VALUES {_BASES}), w AS (SELECT item_id, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM benchmark),
    e AS (SELECT item_id, term FROM w UNION ALL SELECT item_id, base FROM w JOIN m ON term = form) SELECT item_id, term, count(*) AS n FROM e GROUP BY ALL""")
def expanded_terms(spark, d):
    return rank.task_terms(_tasks(spark, d)).groupBy(F.col("task_id").alias("item_id"), "term").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '^(.*)/[^/]*$', 1), ''), '.') AS dir, regexp_extract(url, '([^/]*)$', 1) AS base,
    lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext FROM pages""")
def path_functions(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", T.dirname(u).alias("dir"), T.basename(u).alias("base"), T.extension(u).alias("ext"))


@query("""WITH f AS (SELECT conv_id, turn, role || '/' || CASE turn % 4 WHEN 0 THEN 'test_a.py' WHEN 1 THEN 'tests/b.go' WHEN 2 THEN 'testing.py' ELSE 'x.spec.ts' END AS file FROM conversations)
    SELECT conv_id, turn, file, turn % 4 <> 2 AS is_test, CASE WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.ts' THEN 'ts' ELSE 'py' END AS lang FROM f""")
def test_files(spark, d):
    k = F.col("turn") % 4
    name = F.when(k == 0, "test_a.py").when(k == 1, "tests/b.go").when(k == 2, "testing.py").otherwise("x.spec.ts")
    f = _t(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("/"), name).alias("file"))
    return f.select("*", T.is_test_file(F.col("file"), T.language(F.col("file"))).alias("is_test"), T.language(F.col("file")).alias("lang"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- sources -------------------------------------------------------------------------------------------------------


def _files(spark, d):
    p = _t(spark, d, "documents")
    return p.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")


FILES = "SELECT source || '/' || doc_id || '.md' AS path, text, doc_id FROM documents"


@query(f"WITH f AS ({FILES}) SELECT path, sha256(text) AS sha256 FROM f WHERE strlen(text) <= 1048576")
def manifest_hash(spark, d):
    return tree.manifest(_files(spark, d))


@query(f"""WITH f AS ({FILES}), m AS (SELECT path, sha256(text) AS h FROM f), p AS (SELECT substr(sha256(path), 1, 2) AS p, sha256(string_agg(path || chr(0) || h || chr(0), '' ORDER BY path)) AS h FROM m GROUP BY 1)
    SELECT substr(sha256(string_agg(h, '' ORDER BY p)), 1, 12) AS tree FROM p""")
def tree_fingerprint(spark, d):
    return tree.fingerprint(tree.manifest(_files(spark, d)))


@query(f"""WITH f AS ({FILES}), o AS (SELECT path, sha256(text) AS h FROM f WHERE doc_id % 10 <> 0), n AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM f WHERE doc_id % 10 <> 1)
    SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'edited' END AS change FROM n FULL JOIN o ON n.path = o.path WHERE n.h IS DISTINCT FROM o.h""")
def manifest_diff(spark, d):
    f = _files(spark, d)
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    return tree.diff(tree.manifest(f.filter("doc_id % 10 <> 1").withColumn("content", edited)), tree.manifest(f.filter("doc_id % 10 <> 0")))


@query(f"""WITH f AS ({FILES}), o AS (SELECT path AS file, sha256(text) AS h FROM f WHERE doc_id % 3 <> 0)
    SELECT path AS file, o.h IS NOT NULL AS reused FROM f LEFT JOIN o ON o.file = path AND o.h = sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END)""")
def incremental_reuse(spark, d):
    f = _files(spark, d)
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    fact = lambda df: df.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"), F.lit(0).alias("size"), F.lit(0).alias("mtime_ms"))
    kept, todo = docs.reuse(fact(f.withColumn("content", edited)), fact(f.filter("doc_id % 3 <> 0")))
    return kept.select("file", F.lit(True).alias("reused")).union(todo.select("file", F.lit(False).alias("reused")))


@query("WITH v AS (SELECT vec_id AS content_hash FROM embeddings WHERE label % 2 = 0) SELECT doc_id AS content_hash, doc_id IN (SELECT content_hash FROM v) AS held FROM documents")
def vector_store_prune(spark, d):
    live = _t(spark, d, "documents").select(F.col("doc_id").alias("content_hash"))
    v = _t(spark, d, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("content_hash"))
    return tree.prune_vectors(live, v).withColumn("held", F.lit(True)).union(tree.missing_vectors(live, v).withColumn("held", F.lit(False)))


# --- documents -----------------------------------------------------------------------------------------------------

_QUOTE, _PLAIN, _ANY = "['\"]", "[^'\"]", "[^>]*"
_BLOCK = "blockquote|article|section|header|footer|table|main|div|ul|ol|tr|p"


def _sql_markdown() -> str:
    steps = [(r"(?s)<!--.*?-->", "")]
    steps += [(rf"(?is)<{t}[^>]*>.*?</{t}>", "") for t in ("iframe", "canvas", "svg", "template", "noscript", "style", "script")]
    steps += [
        (r"(?is)<pre\b[^>]*>\s*(.*?)\s*</pre>", "\n\n```\n\\1\n```\n\n"),
        (rf"(?is)<a\b{_ANY}href={_QUOTE}\s*(?:javascript|data|vbscript):{_PLAIN}*{_QUOTE}{_ANY}>(.*?)</a>", r"\1"),
        (rf"(?is)<a\b{_ANY}href={_QUOTE}({_PLAIN}+){_QUOTE}{_ANY}>(.*?)</a>", r"[\2](\1)"),
        (rf"(?i)<img\b{_ANY}alt={_QUOTE}({_PLAIN}*){_QUOTE}{_ANY}>", r"\1"),
        *((rf"(?i)<h{k}\b[^>]*>", f"\n\n{'#' * k} ") for k in range(1, 7)),
        (r"(?i)</h[1-6]>", "\n\n"), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), (rf"(?i)</(?:li|td|th|{_BLOCK})>", "\n"), (rf"(?i)<(?:{_BLOCK})\b[^>]*>", "\n"), ("<[^>]+>", ""),
        ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"), ("\\r\\n?", "\n"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", ""),
    ]
    out = "html"
    for rx, by in steps:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        out = f"regexp_replace({out}, {q(rx)}, {q(by)}, 'g')"
    return out


@query(f"SELECT page_id, {_sql_markdown()} AS text FROM pages")
def html_to_markdown(spark, d):
    return _t(spark, d, "pages").select("page_id", docs.markdown(F.col("html")).alias("text"))


_A = r"""(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{_A}', 1)) AS h, unnest(regexp_extract_all(html, '{_A}', 2)) AS t FROM pages),
    c AS (SELECT page_id, replace(h, '&amp;', '&') AS href, regexp_replace(t, '<[^>]+>', '', 'g') AS label FROM a)
    SELECT page_id, href, label, regexp_matches(href, '(?i)^(vbscript|data|javascript):') AS unsafe, count(*) AS n FROM c GROUP BY ALL""")
def html_links(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.explode(docs.links(F.col("html"))).alias("x")).select("page_id", "x.*")
    return p.groupBy("page_id", "href", "label", "unsafe").agg(F.count("*").alias("n"))


@query()
def doc_sections(spark, d):
    p = _t(spark, d, "pages").select(F.col("page_id").alias("file"), docs.markdown(F.col("html")).alias("text"))
    return docs.split(p)


@query()
def doc_extract(spark, d):
    f = _t(spark, d, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return docs.extract(f).select("file", "hash", "size", F.length("text").alias("chars"))


@query()
def doc_links(spark, d):
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("sec_idx"), "text")
    s = _t(spark, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w{6,})"), F.lit(1)))).alias("name"), "item_id")
    s = s.select(F.concat_ws("::", F.col("item_id").cast("string"), "name").alias("id"), F.concat(F.lit("b/"), F.col("item_id").cast("string")).alias("file"), "name", F.lit("function").alias("kind"), F.lit(True).alias("exported"), F.col("item_id").alias("seq"))
    return docs.code_links(p, s)


@query(f"""WITH s AS (SELECT conv_id, turn, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM conversations),
    q AS (SELECT item_id AS task_id, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM benchmark),
    n AS (SELECT task_id, conv_id, turn, count(*) AS n FROM q JOIN s USING (term) GROUP BY ALL)
    SELECT task_id, conv_id AS file, turn AS sec_idx, n FROM n QUALIFY row_number() OVER (PARTITION BY task_id, conv_id ORDER BY n DESC, turn) = 1""")
def best_section(spark, d):
    s = _t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("sec_idx"), "text")
    q = _tasks(spark, d).select("task_id", F.explode(T.meaningful(F.col("text"))).alias("term"))
    return docs.best_section(s, q)


# --- full text -----------------------------------------------------------------------------------------------------

_BM25 = f"""WITH w AS (SELECT doc_id, unnest({_sql_words('text')}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS f FROM w GROUP BY ALL), l AS (SELECT doc_id, sum(f) AS dl FROM f GROUP BY 1),
    t AS (SELECT count(*) AS n_rows, avg(dl) AS m FROM l), q AS (SELECT item_id, unnest(list_filter(list_distinct({_sql_words('text')}), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x))) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS n FROM f GROUP BY 1), i AS (SELECT term, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM df, t),
    s AS (SELECT item_id, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score FROM q JOIN f USING (term) JOIN i USING (term) JOIN l USING (doc_id), t GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 20"""


@query(_BM25)
def bm25_docs_top20(spark, d):
    return bm25.search(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query()
def bm25_stemmed_top20(spark, d):
    return bm25.search(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", stem=True)


@query("SELECT doc_id, len(regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), '  ') || ' ', ' all  rights ')) AS f FROM documents WHERE f > 0")
def bm25_phrase(spark, d):
    return bm25.phrase(bm25.postings(_t(spark, d, "documents"), "doc_id", "text"), ["all", "rights"], "doc_id")


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({_sql_terms('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM w GROUP BY 1")
def vocab_freq(spark, d):
    return rank.vocabulary(_t(spark, d, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")))


_NAMES = "SELECT p_partkey, p_type, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM part"


@query(f"""WITH t AS ({_NAMES}), f AS (SELECT p_type, term, min(p_partkey) AS o FROM t GROUP BY ALL), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY o, term) <= 60)
    SELECT DISTINCT x.term AS a, y.term AS b FROM k x JOIN k y USING (p_type) WHERE x.term < y.term""")
def cooccur_pairs(spark, d):
    t = _t(spark, d, "part").select("p_type", "p_partkey", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    return rank.cooccurring(t, "p_type", "p_partkey")


@query(f"""WITH t AS ({_NAMES}), v AS (SELECT term, count(DISTINCT p_partkey) AS n FROM t GROUP BY 1), f AS (SELECT p_type, term, min(p_partkey) AS o FROM t GROUP BY ALL),
    k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY o, term) <= 60), c AS (SELECT DISTINCT x.term AS a, y.term AS b FROM k x JOIN k y USING (p_type) WHERE x.term < y.term),
    w AS (SELECT DISTINCT replace(p_name, ' ', '') AS word FROM part), s AS (SELECT word, unnest(range(3, length(word) - 2)) AS i FROM w WHERE length(word) >= 6 AND word NOT IN (SELECT term FROM v)),
    h AS (SELECT word, i, substr(word, 1, i) AS x, substr(word, i + 1) AS y FROM s), lim AS (SELECT greatest(2, ceil(count(*) / 3)) AS m FROM part)
    SELECT word, x AS a, y AS b FROM h JOIN v p ON p.term = x JOIN v q ON q.term = y JOIN c ON c.a = least(x, y) AND c.b = greatest(x, y), lim WHERE p.n <= m AND q.n <= m QUALIFY row_number() OVER (PARTITION BY word ORDER BY i) = 1""")
def compound_split(spark, d):
    p = _t(spark, d, "part")
    t = p.select("p_type", "p_partkey", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    vocab = t.groupBy("term").agg(F.countDistinct("p_partkey").alias("n"))
    return rank.compound_split(p.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word")), vocab, rank.cooccurring(t, "p_type", "p_partkey"), p.count())


# --- lexical lane --------------------------------------------------------------------------------------------------

_TASKS_SQL = "SELECT DISTINCT 't' || (p_size % 10) || p_type AS task_id, lower(p_type) || ' ' || CASE p_size % 10 WHEN 0 THEN 'widget' WHEN 1 THEN 'bolt excluding tests' WHEN 2 THEN 'under brand2' WHEN 3 THEN 'red ring only config' WHEN 4 THEN 'brand2/small.py' ELSE 'blue gear' END AS text FROM part"


def _part_tasks(spark, d):
    k = F.col("p_size") % 10
    tail = F.when(k == 0, "widget").when(k == 1, "bolt excluding tests").when(k == 2, "under brand2").when(k == 3, "red ring only config").when(k == 4, "brand2/small.py").otherwise("blue gear")
    return _t(spark, d, "part").select(F.concat(F.lit("t"), k.cast("string"), "p_type").alias("task_id"), F.concat(F.lower("p_type"), F.lit(" "), tail).alias("text")).distinct()


@query(f"""WITH s AS ({SYMBOLS}), e AS ({EDGES}), q AS ({_TASKS_SQL}), tt AS (SELECT task_id, text, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM q),
    st AS (SELECT id, unnest({_sql_terms("name || ' ' || sig")}) AS term FROM s), m AS (SELECT task_id, id, count(*) AS m FROM tt JOIN st USING (term) GROUP BY ALL),
    ft AS (SELECT DISTINCT file, unnest({_sql_terms('file')}) AS term FROM s), pm AS (SELECT task_id, file, count(*) AS pm FROM tt JOIN ft USING (term) GROUP BY ALL),
    x AS (SELECT DISTINCT task_id, file, TRUE AS ex FROM q JOIN (SELECT DISTINCT file FROM s) ON contains(text, regexp_extract(file, '([^/]*)$', 1))), dg AS (SELECT src AS id, count(*) AS dg FROM e GROUP BY 1),
    j AS (SELECT q.task_id, q.text, s.*, coalesce(m, 0) AS m, coalesce(pm, 0) AS pm, coalesce(ex, FALSE) AS ex, coalesce(dg, 0) AS dg FROM q JOIN s ON TRUE LEFT JOIN m USING (task_id, id) LEFT JOIN pm USING (task_id, file) LEFT JOIN x USING (task_id, file) LEFT JOIN dg USING (id)
        WHERE m IS NOT NULL OR pm IS NOT NULL OR ex)
    SELECT task_id, id, m AS matched, pm AS path_matched, round(CAST((m * 2.0 + CASE WHEN lower(name) = text THEN 4 ELSE 0 END + CASE WHEN test AND length(name) >= 6 AND contains(' ' || text || ' ', ' ' || lower(name) || ' ') THEN 6 ELSE 0 END + pm * 1.5 + CASE WHEN ex THEN 20 ELSE 0 END + CASE WHEN test THEN 0.6 ELSE 0 END + CASE WHEN kind = 'config' THEN 0.8 ELSE 0 END + CASE WHEN exported THEN 0.2 ELSE 0 END + least(dg, 30) * 0.04)
        * CASE WHEN m = 0 AND length(name) <= 4 AND test THEN 0.4 ELSE 1 END * CASE WHEN contains(text, 'excluding tests') AND test THEN 0.05 ELSE 1 END * CASE WHEN contains(text, 'only config') AND kind <> 'config' THEN 0.4 ELSE 1 END
        * CASE WHEN contains(text, 'under brand2') AND NOT starts_with(file, 'brand2/') THEN 0.3 ELSE 1 END AS DOUBLE), 6) AS base FROM j""")
def lexical_score(spark, d):
    s, q = _symbols(spark, d), _part_tasks(spark, d)
    lex = rank.lexical(q, s, _edges(spark, d), explicit=rank.explicit_files(q, s.select("file").distinct()))
    return lex.select("task_id", "id", F.col("matched").cast("long").alias("matched"), F.col("path_matched").cast("long").alias("path_matched"), F.round("base", 6).alias("base"))


@query(f"WITH s AS ({SYMBOLS}), q AS ({_TASKS_SQL}) SELECT DISTINCT task_id, file FROM q JOIN s ON contains(text, regexp_extract(file, '([^/]*)$', 1))")
def explicit_pin(spark, d):
    return rank.explicit_files(_part_tasks(spark, d), _symbols(spark, d).select("file").distinct())


@query(f"""WITH q AS ({_TASKS_SQL}) SELECT task_id, contains(text, 'excluding tests') AS neg_tests, contains(text, 'only config') AS only_config, CASE WHEN contains(text, 'under ') THEN 'brand2' END AS under FROM q""")
def negative_scope(spark, d):
    return rank.intents(_part_tasks(spark, d)).select("task_id", "neg_tests", "only_config", "under")


@query(f"""WITH s AS ({SYMBOLS}), q AS ({_TASKS_SQL}), tt AS (SELECT DISTINCT task_id, unnest(list_filter({_sql_terms('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x))) AS term FROM q), f AS (SELECT DISTINCT file FROM s),
    b AS (SELECT file, unnest({_sql_terms("regexp_extract(file, '([^/]*)$', 1)")}) AS term FROM f), p AS (SELECT file, unnest({_sql_terms('file')}) AS term FROM f), c AS (SELECT DISTINCT file, unnest({_sql_terms("name || ' ' || sig")}) AS term FROM s),
    m AS (SELECT task_id, file, 0 AS l FROM tt JOIN b USING (term) UNION ALL SELECT task_id, file, 1 FROM tt JOIN p USING (term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = p.file AND b.term = p.term) UNION ALL SELECT task_id, file, 2 FROM tt JOIN c USING (term))
    SELECT task_id, file, count(*) FILTER (l = 0) AS base_matched, count(*) FILTER (l = 1) AS path_matched, count(*) FILTER (l = 2) AS content_matched,
        CAST(count(*) FILTER (l = 0) * 2 + count(*) FILTER (l = 1) * 1.5 + count(*) FILTER (l = 2) * 0.75 AS DOUBLE) AS score FROM m GROUP BY ALL""")
def file_rank(spark, d):
    s = _symbols(spark, d)
    content = rank.symbol_terms(s).join(s.select("id", "file"), "id").select("file", "term").distinct()
    return rank.rank_files(_part_tasks(spark, d), s.select("file").distinct(), content).drop("named")


# --- graph ---------------------------------------------------------------------------------------------------------

_RESOLVE = """WITH s AS (SELECT 'n' || n_nationkey AS id, 'f' || (n_regionkey % 3) AS file, 'x' || (n_nationkey % 9) AS name, n_nationkey AS seq FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'y' || r_regionkey, 1000 + r_regionkey FROM region),
    i AS (SELECT DISTINCT 'f' || (n_regionkey % 3) AS file, 'x' || (n_nationkey % 4) AS name, 'f1' AS module FROM nation),
    e AS (SELECT c_custkey AS seq, 'f' || (c_nationkey % 3) AS file, CASE WHEN c_custkey % 2 = 0 THEN 'x' || (c_custkey % 11) ELSE 'y' || (c_custkey % 7) END AS name FROM customer),
    l AS (SELECT file, name, arg_min(id, seq) AS id, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT name, arg_min(id, seq) AS id, arg_min(file, seq) AS file, count(*) AS n FROM s GROUP BY 1), p AS (SELECT name, file, arg_min(id, seq) AS id FROM s GROUP BY ALL)
    SELECT e.seq, coalesce(l.id, CASE WHEN i.module IS NOT NULL THEN coalesce(p.id, g.id) WHEN g.n = 1 AND g.file <> e.file THEN g.id END) AS dst,
        CASE WHEN l.n = 1 THEN 'exact' WHEN l.n > 1 THEN 'resolved' WHEN i.module IS NOT NULL AND g.id IS NOT NULL THEN 'resolved' WHEN i.module IS NOT NULL THEN 'heuristic' WHEN g.n = 1 AND g.file <> e.file THEN 'resolved' ELSE 'heuristic' END AS conf
    FROM e LEFT JOIN l ON l.file = e.file AND l.name = e.name LEFT JOIN i ON i.file = e.file AND i.name = e.name LEFT JOIN g ON g.name = e.name LEFT JOIN p ON p.name = e.name AND p.file = i.module"""


@query(_RESOLVE)
def edge_resolve_tiers(spark, d):
    n, r, c = _t(spark, d, "nation"), _t(spark, d, "region"), _t(spark, d, "customer")
    s_ = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    s = n.select(s_("n", F.col("n_nationkey")).alias("id"), s_("f", F.col("n_regionkey") % 3).alias("file"), s_("x", F.col("n_nationkey") % 9).alias("name"), F.col("n_nationkey").alias("seq"))
    s = s.union(r.select(s_("r", F.col("r_regionkey")), s_("r", F.col("r_regionkey")), s_("y", F.col("r_regionkey")), F.col("r_regionkey") + 1000))
    i = n.select(s_("f", F.col("n_regionkey") % 3).alias("file"), F.lit("f1").alias("module"), s_("x", F.col("n_nationkey") % 4).alias("local"), F.lit(1).alias("seq")).distinct()
    name = F.when(F.col("c_custkey") % 2 == 0, s_("x", F.col("c_custkey") % 11)).otherwise(s_("y", F.col("c_custkey") % 7))
    e = c.select(F.lit("a").alias("src"), F.lit(None).cast("string").alias("dst"), name.alias("name"), F.lit("call").alias("kind"), F.lit("heuristic").alias("conf"), s_("f", F.col("c_nationkey") % 3).alias("at_file"), F.lit(1).alias("at_line"), F.col("c_custkey").alias("seq"))
    return graph.resolve(e, s, i).select("seq", "dst", "conf")


_SEEDS = "SELECT 'p' || p_partkey AS id, p_size / 10.0 AS base FROM part WHERE p_brand = 'Brand#2'"
_TWO_WAY = "SELECT src, dst, CASE kind WHEN 'call' THEN 0.8 ELSE 0.3 END AS w FROM e UNION ALL SELECT dst, src, 0.3 FROM (SELECT DISTINCT src, dst FROM e WHERE name = 'R')"


@query(f"""WITH e AS ({EDGES}), g AS ({_TWO_WAY}), s AS ({_SEEDS}), one AS (SELECT s.id AS seed, g.dst AS mid, base, w FROM s JOIN g ON g.src = s.id), fan AS (SELECT src AS mid, count(*) AS n FROM g GROUP BY 1), back AS (SELECT src AS mid, dst AS seed, count(*) AS b FROM g GROUP BY ALL),
    two AS (SELECT g.dst AS id, base * one.w * g.w * 0.15 / greatest(1, n - coalesce(b, 0)) AS x FROM one JOIN fan USING (mid) LEFT JOIN back USING (mid, seed) JOIN g ON g.src = one.mid WHERE g.dst <> seed)
    SELECT id, round(sum(x), 6) AS added FROM (SELECT mid AS id, base * w * 0.5 AS x FROM one UNION ALL SELECT id, x FROM two) GROUP BY 1""")
def propagate_2hop(spark, d):
    e = _edges(spark, d).select("src", "dst", "name", "kind")
    g = e.select("src", "dst", "kind").union(e.filter("name = 'R'").select("src", "dst").distinct().select(F.col("dst"), F.col("src"), F.lit("ref")))
    s = _t(spark, d, "part").filter("p_brand = 'Brand#2'").select(F.lit(1).alias("task_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 10.0).alias("base"))
    return rank.propagate(s, g).select("id", F.round("added", 6).alias("added"))


@query(f"""WITH e AS ({EDGES}), s AS (SELECT 'p' || p_partkey AS id, p_partkey AS seq, p_name, p_size / 10.0 AS base FROM part WHERE p_brand = 'Brand#2'), g AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'call'),
    o AS (SELECT s.id AS seed, p_name, dst, base * 0.8 * 0.5 AS x, sum(base * 0.8 * 0.5) OVER (PARTITION BY dst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s JOIN g ON g.src = s.id WHERE base > 0)
    SELECT DISTINCT dst AS id, 'relation-to-' || p_name AS reason FROM o WHERE x > 0.1 * coalesce(prev, 0) + 1e-9""")
def relation_reason(spark, d):
    p = _t(spark, d, "part").filter("p_brand = 'Brand#2'")
    s = p.select(F.lit(1).alias("task_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 10.0).alias("base"), F.col("p_partkey").alias("seed_seq"))
    e = _edges(spark, d).filter("kind = 'call'").select("src", "dst", "kind").distinct().withColumn("seq", F.lit(0))
    return rank.relation_reasons(s, e, _symbols(spark, d)).select("id", "reason")


def _seeds(spark, d):
    """Every part, with its brand as the task."""
    return _t(spark, d, "part").select(F.col("p_brand").alias("task_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 10.0).alias("base"), F.col("p_partkey").alias("seed_seq"))


@query()
def propagate_2hop_all(spark, d):
    e = _edges(spark, d).select("src", "dst", "name", "kind")
    g = e.select("src", "dst", "kind").union(e.filter("name = 'R'").select("src", "dst").distinct().select(F.col("dst"), F.col("src"), F.lit("ref")))
    return rank.propagate(_seeds(spark, d).drop("seed_seq"), g).select("task_id", "id", F.round("added", 6).alias("added"))


@query()
def relation_reason_all(spark, d):
    e = _edges(spark, d).select("src", "dst", "kind").distinct().withColumn("seq", F.when(F.col("kind") == "call", 0).otherwise(1))
    return rank.relation_reasons(_seeds(spark, d), e, _symbols(spark, d)).select("task_id", "id", "reason")


@query(f"""WITH e AS ({EDGES}), g AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE kind = 'call' UNION SELECT DISTINCT dst, src FROM e WHERE kind = 'call'), h1 AS (SELECT b AS node FROM g WHERE a = 's1' ),
    h2 AS (SELECT DISTINCT g.b AS node FROM h1 JOIN g ON g.a = h1.node WHERE g.b <> 's1' AND g.b NOT IN (SELECT node FROM h1))
    SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def follow_bfs(spark, d):
    e = _edges(spark, d).filter("kind = 'call'").select("src", "dst", "kind").distinct().withColumn("seq", F.xxhash64("src", "dst"))
    start = spark.range(1).select(F.lit(1).alias("task_id"), F.lit("s1").alias("id"))
    return graph.follow(e, start, depth=2, trails=1 << 30).groupBy("node").agg(F.min("hop").alias("hop"))


@query(f"""WITH e AS ({EDGES}), g AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'call'), l1 AS (SELECT src AS node, min(CASE dst WHEN 's1' THEN 1 WHEN 's2' THEN 2 WHEN 's3' THEN 3 END) AS seed FROM g WHERE dst IN ('s1', 's2', 's3') GROUP BY 1)
    SELECT src AS a, dst AS b FROM g JOIN l1 ON node = src WHERE dst IN ('s1', 's2', 's3') AND seed <> CASE dst WHEN 's1' THEN 1 WHEN 's2' THEN 2 ELSE 3 END""")
def connect_seeds(spark, d):
    e = _edges(spark, d).filter("kind = 'call'").select("src", "dst", "kind").distinct().withColumn("seq", F.lit(0))
    seeds = spark.range(1, 4).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"), F.col("id").alias("seed")).select(F.col("s").alias("id"), "seed")
    return graph.connect(e, seeds, depth=1, most=1 << 30).select("a", "b")


@query(f"WITH e AS ({EDGES}) SELECT dst AS task_id, CASE WHEN kind IN ('call', 'ref') THEN 'caller' END AS role, kind, count(*) AS n FROM e GROUP BY ALL")
def impact_roles(spark, d):
    targets = _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("task_id")).withColumn("id", F.col("task_id"))
    return graph.impact(_edges(spark, d), _symbols(spark, d), targets).groupBy("task_id", "role", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH e AS ({EDGES}), s AS ({SYMBOLS}), t AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS file FROM supplier), l AS (SELECT DISTINCT t.file, s.name || ' via ' || e.kind || ' (' || regexp_extract(s.file, '([^/]*)$', 1) || ')' AS label FROM e JOIN t ON t.id = e.dst JOIN s ON s.id = e.src)
    SELECT file, count(*) AS n, least(8, count(*)) AS shown, greatest(0, count(*) - 8) AS more FROM l GROUP BY 1""")
def blast_radius(spark, d):
    t = _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("file"), F.lit("x").alias("name"))
    s = _symbols(spark, d).select("id", "file", "name").union(t)
    b = graph.blast_radius(_edges(spark, d), s, t.select("file"))
    return b.groupBy("file").agg((F.count("*") + F.max("more")).alias("n"), F.count("*").alias("shown"), F.max("more").cast("long").alias("more"))


@query("""WITH u AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), c AS (SELECT o_custkey AS commit_seq, l_partkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS pos FROM u),
    p AS (SELECT x.commit_seq, x.pos AS i, y.pos AS j, least(CAST(x.file AS VARCHAR), CAST(y.file AS VARCHAR)) AS a, greatest(CAST(x.file AS VARCHAR), CAST(y.file AS VARCHAR)) AS b FROM c x JOIN c y USING (commit_seq) WHERE x.pos < y.pos AND y.pos <= 12 AND commit_seq < 20),
    f AS (SELECT a, b, min(commit_seq * 10000 + i * 100 + j) AS t FROM p GROUP BY ALL), k AS (SELECT max(t) AS cut FROM (SELECT t FROM f ORDER BY t LIMIT 80))
    SELECT a, b, count(*) AS n FROM p, k WHERE commit_seq * 10000 + i * 100 + j <= cut GROUP BY ALL""")
def cochange_pairs(spark, d):
    c = _t(spark, d, "orders").select("o_orderkey", "o_custkey").distinct().join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct(), "o_orderkey").select("o_custkey", "l_partkey").distinct()
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_partkey")) - 1
    return graph.cochange(c.select(F.col("o_custkey").alias("commit_seq"), F.col("l_partkey").cast("string").alias("file"), pos.alias("file_pos")))


@query(f"""WITH s AS ({SYMBOLS}), a AS (SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, file, name, exported, test FROM s UNION ALL SELECT source, source || '/' || doc_id || '.md', NULL, FALSE, FALSE FROM documents)
    SELECT dir, count(DISTINCT file) AS files, array_to_string(list_sort(list_distinct(list(regexp_extract(file, '([^.]*)$', 1)))), '/') AS lang,
        array_to_string(list_slice(list_sort(list_distinct(list(name) FILTER (exported))), 1, 3), ',') AS surface, CAST(sum(CAST(test AS INTEGER)) AS BIGINT) AS tests FROM a GROUP BY 1""")
def dir_cards(spark, d):
    docs_ = _t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    c = graph.dir_cards(_symbols(spark, d), docs_)
    return c.select("dir", "files", "lang", F.when(F.size("surface") > 0, F.array_join("surface", ",")).otherwise(F.when(F.col("dir").startswith("src"), None).otherwise("")).alias("surface"), "tests")


@query(f"""WITH b AS ({_BM25}), h AS (SELECT item_id AS task_id, source AS dir, round(sum(score), 6) AS score FROM b JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, dir) AS k, dir, score FROM h QUALIFY k <= 3""")
def dir_rank(spark, d):
    docs_ = _t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    hits = bm25_docs_top20(spark, d).join(docs_, "doc_id").select(F.col("item_id").alias("task_id"), "file", "score")
    cards = graph.dir_cards(_symbols(spark, d).limit(0), docs_)
    return graph.rank_dirs(cards, hits).select("task_id", F.col("k").cast("long").alias("k"), "dir", F.round("score", 6).alias("score"))


@query(f"""WITH s AS ({SYMBOLS}), i AS (SELECT file, id, name, name_line, dense_rank() OVER (ORDER BY file) AS f, row_number() OVER (PARTITION BY file ORDER BY name_line, id) AS k, count(DISTINCT file) OVER () AS n FROM s WHERE starts_with(file, 'brand2/'))
    SELECT file, CAST(k AS INTEGER) AS k, id, name, name_line AS line, n > 12 AS truncated FROM i WHERE f <= 12 AND k <= 5""")
def map_dir(spark, d):
    return graph.map_dir(_symbols(spark, d), _edges(spark, d), "brand2")[0]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'exact' ELSE 'heuristic' END AS conf, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS sig FROM customer
    UNION ALL SELECT c_custkey + 1000000, 'exact', 'new' FROM customer WHERE c_custkey % 50 = 0""")
def overlay_upsert(spark, d):
    c = _t(spark, d, "customer")
    one = lambda k, sig: c.select(k.cast("string").alias("id"), F.lit("f").alias("file"), F.lit("type").alias("kind"), F.lit("n").alias("name"), sig.alias("sig"), F.lit(1).alias("sl"), F.lit(1).alias("el"), F.lit(1).alias("name_line"), F.lit(True).alias("exported"), F.lit(False).alias("test"), F.lit("").alias("doc"), F.lit("heuristic").alias("conf"))
    over = lambda df, k: df.select(k.cast("string").alias("id"), F.lit("f").alias("file"), F.lit("n").alias("name"), F.lit("type").alias("kind"), F.lit(1).alias("line"), F.lit(2).alias("end_line"), F.lit("new").alias("sig"), F.lit("").alias("doc"))
    o = over(c.filter("c_custkey % 5 = 0"), F.col("c_custkey")).union(over(c.filter("c_custkey % 50 = 0"), F.col("c_custkey") + 1_000_000))
    s = graph.overlay_symbols(graph.overlay_symbols(one(F.col("c_custkey"), F.col("c_name")), o), o)
    return s.select(F.col("id").cast("long").alias("c_custkey"), "conf", "sig")


# --- vectors -------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS task_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT task_id, vec_id AS key, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS sim FROM q, embeddings)
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY sim DESC, key) AS rank, key, sim FROM s WHERE sim >= 0.2 QUALIFY rank <= 10""")
def cosine_topk(spark, d):
    v = _t(spark, d, "embeddings")
    return rank.cosine_top(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("task_id"), F.col("embedding").alias("q")))


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def query_avg_vector(spark, d):
    return rank.mean_vector(_t(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("x", 6).alias("x"))


@query(f"""WITH b AS ({_BM25}), h AS (SELECT item_id, rank, score, source FROM b JOIN documents USING (doc_id)), g AS (SELECT item_id AS task_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(source) FILTER (rank = 1) AS d1, max(source) FILTER (rank = 2) AS d2 FROM h GROUP BY 1)
    SELECT benchmark.item_id AS task_id, CASE WHEN s1 IS NULL THEN 'empty' WHEN s1 / 40 >= 5 THEN 'strong' WHEN s2 >= s1 * 0.7 AND d1 <> d2 THEN 'conflicted' ELSE 'weak' END AS confidence FROM benchmark LEFT JOIN g ON task_id = benchmark.item_id""")
def confidence_gate(spark, d):
    b = bm25_docs_top20(spark, d).join(_t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/x")).alias("file")), "doc_id")
    hits = b.select(F.col("item_id").alias("task_id"), "rank", (F.col("score") / 40).alias("score"), "file", F.array(F.lit("bm25")).alias("reason"))
    return rank.confidence(hits, _tasks(spark, d))


@query()
def semantic_fusion(spark, d):
    b = bm25_docs_top20(spark, d)
    hits = b.select(F.col("item_id").alias("task_id"), F.col("doc_id").cast("string").alias("id"), F.lit("f").alias("file"), F.lit("n").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("sig"), F.lit(1).alias("sl"), F.lit(1).alias("el"), F.lit(1).alias("name_line"), F.lit("exact").alias("conf"), (F.col("score") / 40).alias("score"), F.array(F.lit("bm25")).alias("reason"), "rank")
    sem = cosine_topk(spark, d).select("task_id", F.col("key").cast("string").alias("id"), "sim")
    info = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("f").alias("file"), F.lit("n").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("sig"), F.lit(1).alias("sl"), F.lit(1).alias("el"), F.lit(1).alias("name_line"), F.lit("exact").alias("conf"))
    return rank.fuse_semantic(hits, sem, info, _tasks(spark, d)).select("task_id", "rank", "id", F.round("score", 6).alias("score"))


# --- events --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def session_totals(spark, d):
    return sessions.totals(_t(spark, d, "events"), "user_id", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = sessions.windowed(_t(spark, d, "events"), "1 hour", "event_type", "value")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value / 10) AS BIGINT) ORDER BY ts) = 1 AS new FROM events")
def session_novelty(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("tree"), F.floor(F.col("value") / 10).alias("item"), "ts")
    return sessions.novelty(e).select("event_id", "new")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1")
def dedupe_prompts(spark, d):
    return sessions.dedupe(_t(spark, d, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type"))).select("event_id")


@query("SELECT conv_id, turn, substr(sha256(text || chr(0) || role || chr(0) || ''), 1, 12) AS key FROM conversations")
def dedupe_key(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", sessions.dedupe_key(F.col("text"), F.col("role"), F.array().cast("array<string>")).alias("key"))


@query("""WITH l AS (SELECT *, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS t FROM events)
    SELECT user_id AS repo, CAST(sum(CASE WHEN event_type = 'click' AND (t IS NULL OR ts > t) THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM l GROUP BY 1""")
def stale_flag(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("repo"), "ts", F.when(F.col("event_type") == "purchase", "build").when(F.col("event_type") == "click", "edit").alias("kind"))
    return sessions.stale(e)


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM conversations WHERE length(text) >= 40)
    SELECT DISTINCT conv_id, turn FROM w JOIN v USING (term) WHERE length(term) >= 3 AND NOT list_contains({STOP}, term)""")
def affinity_gate(spark, d):
    p = _t(spark, d, "conversations").withColumn("prompt_id", F.struct("conv_id", "turn"))
    v = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    return sessions.affinity(p, v).select("conv_id", "turn")


# --- evaluation, packing, intervals --------------------------------------------------------------------------------


@query(f"""WITH b AS ({_BM25}), x AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), j AS (SELECT x.item_id, b.rank FROM x LEFT JOIN b ON b.item_id = x.item_id AND b.doc_id = x.doc_id AND b.rank <= 10)
    SELECT item_id, round(count(rank) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS rr FROM j GROUP BY 1""")
def recall_mrr(spark, d):
    docs_, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    # Texts that hold an item hold its first eight words: an equal-key join finds the candidates, contains() decides.
    key = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - 8)), lambda i: F.xxhash64(F.array_join(F.slice(c, i + 1, 8), " "))))
    w = lambda c: F.regexp_extract_all(c, F.lit(r"([^\s]+)"), F.lit(1))
    first = items.select("item_id", F.col("text").alias("item"), F.xxhash64(F.array_join(F.slice(F.slice(w(F.col("text")), 2, 8), 1, 8), " ")).alias("h"))
    held = docs_.select("doc_id", "text", w(F.col("text")).alias("w")).select("doc_id", "text", F.explode(key(F.col("w"))).alias("h"))
    want = held.join(first, "h").filter(F.contains("text", "item")).select("item_id", "doc_id").distinct()
    return evaluate.recall(bm25_docs_top20(spark, d), want, 10, "item_id", "doc_id")


@query("SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 = least(floor(count(*) OVER (PARTITION BY event_type) * 0.95), count(*) OVER (PARTITION BY event_type) - 1)")
def percentiles_floor(spark, d):
    return evaluate.percentile(_t(spark, d, "events"), "event_type", "value", 0.95)


@query("""WITH m AS (SELECT source, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1) SELECT source, mean, coalesce(mean < lag(mean) OVER (ORDER BY source) - 1e-9, FALSE) AS regressed FROM m""")
def variant_verdict(spark, d):
    m = _t(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"))
    return evaluate.verdict(m, "source", ["mean"])


@query("""WITH t AS (SELECT source, doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents) SELECT source, doc_id, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM t QUALIFY used <= 1200""")
def pack_prefix(spark, d):
    t = _t(spark, d, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return pack.prefix(t, "source", ["doc_id"], "tokens", 1200)


@query()
def pack_greedy(spark, d):
    b = bm25_docs_top20(spark, d).join(_t(spark, d, "documents"), "doc_id")
    hits = b.select(F.col("item_id").alias("task_id"), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("name"), F.lit("doc").alias("kind"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.lit(1).alias("name_line"), F.lit(1).alias("sl"), F.lit(1).alias("el"), F.split("text", "\n")[0].alias("sig"), F.array(F.lit("doc-match")).alias("reason"), F.lit("exact").alias("conf"), "score")
    c = pack.capsules(_tasks(spark, d), hits, rank.confidence(hits, _tasks(spark, d)))
    return c.select("task_id", "confidence", F.size("hits").alias("n_hits"), "tokens", "truncated")


@query(f"""WITH b AS ({_BM25}), f AS (SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS k FROM b), n AS (SELECT item_id, rank, least(length(text), 4000) AS n FROM f JOIN documents USING (doc_id) WHERE k <= 4),
    c AS (SELECT item_id, greatest(0, least(n, 12000 - coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM n)
    SELECT item_id AS task_id, CAST(ceil(sum(n) / 4) AS BIGINT) AS cold, CAST(300 AS BIGINT) AS capsule, CAST(greatest(0, ceil(sum(n) / 4) - 300) AS BIGINT) AS saved, round(greatest(0, ceil(sum(n) / 4) - 300) * 100.0 / ceil(sum(n) / 4), 6) AS pct, count(*) AS spans FROM c WHERE n > 0 GROUP BY 1""")
def savings_projection(spark, d):
    h = bm25_docs_top20(spark, d).select(F.col("item_id").alias("task_id"), F.col("doc_id").alias("file"), "rank")
    sizes = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.length("text").alias("chars"))
    return pack.savings(h, sizes, _tasks(spark, d).select("task_id", F.lit(300).cast("long").alias("tokens")))


@query("""SELECT p.event_id, s.event_id AS span_id FROM events p JOIN events s ON s.user_id = p.user_id AND s.event_type = 'purchase' AND p.event_type = 'click' AND epoch_ms(p.ts) BETWEEN epoch_ms(s.ts) AND epoch_ms(s.ts) + 3600000""")
def containment_join(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("lo"), (F.col("at") + 3_600_000).alias("hi"))
    return intervals.containing(e.filter("event_type = 'click'").select("user_id", "event_id", "at"), spans, "user_id", "at", "lo", "hi", 3_600_000).select("event_id", "span_id")


@query("""SELECT p.event_id, s.event_id AS found FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON s.user_id = p.user_id AND p.ts >= s.ts""")
def asof_enclosing(spark, d):
    e = _t(spark, d, "events")
    left = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return intervals.as_of(left, e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("found")), "user_id", "ts", "found").select("event_id", "found")


# --- extraction ----------------------------------------------------------------------------------------------------

SOURCE = """'import os' || chr(10) || '# makes ' || p_name || chr(10) || 'def make_' || p_partkey || '(x):' || chr(10) || '    return os.getenv("KEY_' || p_size || '")' || chr(10) || 'class Box_' || p_partkey || ':' || chr(10) || '    pass'"""


def _source(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.concat(F.lit("code/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.expr(SOURCE).alias("text"))


@query("""SELECT 'code/' || p_partkey || '.py' AS file, x.kind, x.name, x.line, x.doc FROM part, (VALUES ('import', 1), ('function', 3), ('class', 5)) v(k, l), LATERAL (SELECT k AS kind, CASE k WHEN 'import' THEN 'os' WHEN 'function' THEN 'make_' || p_partkey ELSE 'Box_' || p_partkey END AS name, CAST(l AS INTEGER) AS line, CASE k WHEN 'function' THEN 'makes ' || p_name ELSE '' END AS doc) x""")
def extract_lines(spark, d):
    s, _ = extract.by_lines(_source(spark, d))
    return s.select("file", "kind", "name", F.col("name_line").alias("line"), "doc")


@query("SELECT 'code/' || p_partkey || '.py' AS file, 'make_' || p_partkey AS owner, 'getenv' AS callee, CAST(4 AS INTEGER) AS line FROM part")
def extract_calls(spark, d):
    _, e, _ = extract.by_tree(_source(spark, d))
    return e.filter("kind = 'call'").select(F.col("at_file").alias("file"), F.split("src", "::")[1].alias("owner"), F.col("name").alias("callee"), F.col("at_line").alias("line"))


@query("SELECT 'code/' || p_partkey || '.py' AS file, 'KEY_' || p_size AS name, CAST(4 AS INTEGER) AS line, 'environment variable' AS doc FROM part")
def extract_artifacts(spark, d):
    return extract.artifacts(_source(spark, d), most=1 << 30).select("file", "name", F.col("name_line").alias("line"), "doc")


@query()
def observe_capsules(spark, d):
    from beaconry.plans import engine

    files = _source(spark, d).select("path", F.encode("text", "UTF-8").alias("content"))
    names = _t(spark, d, "part").select(F.col("p_name").alias("task_id"), F.concat(F.lit("who makes "), "p_name").alias("text")).distinct()
    return engine.observe(engine.build(files), names).select("task_id", "confidence", F.size("hits").alias("n_hits"), "tokens", "truncated")
