"""Registered queries: each operator on virtual files of the corpus, with SQL that checks it."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions.paths import basename, dirname, suffix
from quarrymap.functions.python_source import python_structure
from quarrymap.functions.text import found, lines, truncated
from quarrymap.operators import context, diff, edges, extract, graph, score, summaries, walk
from quarrymap.plans import asking
from quarrymap.plans import views as V
from quarrymap.plans.views import table
from quarrymap.settings import EXCLUDED_DIRS, EXCLUDED_FILES, Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "Where does the source src3 text about thereading in french?"
IGNORE = ["logs/", "*u7*", "/src/view/*", "*.JS"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


# --- texts ----------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN text = '' THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) END AS line_count FROM documents")
def content_hash_lines(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("content_hash"), F.when(c == "", F.lit(0)).otherwise(F.size(lines(c))).cast("bigint").alias("line_count"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, substring(text, 1, 500) AS content_preview, CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || chr(10) || '[... truncated ...]' ELSE text END AS prompt_text FROM documents")
def preview_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("content_preview"), truncated(F.col("text"), 3000, summaries.PROMPT_CUT).alias("prompt_text"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:100]) AS line, unnest(range(1, least(len(string_split(text, chr(10))), 100) + 1)) AS i, string_split(text, chr(10)) AS all_lines FROM documents),
    s AS (SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, regexp_replace(all_lines[i + 1], '^\\s+|\\s+$', '', 'g') AS next FROM l)
    SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS headings FROM s WHERE (upper(line) = line AND lower(line) <> line AND length(line) > 3) OR starts_with(next, '===') GROUP BY doc_id"""
)
def text_headings(spark, d):
    rows = table(spark, d, "documents").select("doc_id", extract.text_headings(F.col("text")).alias("h")).where(F.size("h") > 0)
    return rows.select("doc_id", F.size("h").cast("bigint").alias("n"), F.array_join("h", "\n").alias("headings"))


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z0-9_]+)[\\s>]', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<([A-Za-z0-9_]+)[\\s>]', 1), 1) AS i FROM pages),
    f AS (SELECT page_id, tag, min(i) AS i FROM t WHERE tag <> 'xml' GROUP BY page_id, tag),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f)
    SELECT page_id, string_agg(tag, ' ' ORDER BY i) AS tags FROM r WHERE k <= 20 GROUP BY page_id"""
)
def html_tags20(spark, d):
    made = extract.document_structure(F.col("content"), "xml")["headings"]
    return V.page_files(spark, d).select("page_id", F.array_join(made, " ").alias("tags")).where("tags <> ''")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS ref FROM pages""")
def href_refs(spark, d):
    return V.page_files(spark, d).select("page_id", F.explode(found(F.col("content"), 'href="([^"]+)"')).alias("ref"))


@query("SELECT event_id, array_to_string(json_keys(props)[1:30], ',') AS headings FROM events WHERE json_keys(props) IS NOT NULL")
def props_json_keys(spark, d):
    made = extract.document_structure(F.col("props"), "json")["headings"]
    return table(spark, d, "events").select("event_id", F.array_join(made, ",").alias("headings"))


@query("SELECT c_custkey, 'name,\" segment\", balance' || chr(10) || c_name AS content, 'name|segment|balance' AS headings, '2 rows, 3 columns' AS key_sections FROM customer")
def csv_header(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('name," segment", balance\n'), "c_name").alias("content"))
    made = extract.document_structure(F.col("content"), "csv")
    return rows.select("c_custkey", "content", F.array_join(F.transform(made["headings"], lambda x: F.trim(x)), "|").alias("headings"), F.get(made["key_sections"], F.lit(0)).alias("key_sections"))


_MARKDOWN = "'# ' || p_name || chr(10) || '## Type ' || p_type || chr(10) || 'see [brand](brands/' || p_brand || '.md) and `parts/p' || p_partkey || '.py` or `x.y`' || chr(10) || '### deep'"


@query(
    f"""WITH m AS (SELECT p_partkey, {_MARKDOWN} AS c FROM part)
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(c, '(?m)^#+ +.+$'), lambda h: trim(h)), '|') AS headings,
      array_to_string(regexp_extract_all(c, '\\]\\(([^)]+)\\)', 1), '|') || '|' || array_to_string(list_filter(regexp_extract_all(c, '`([^`]*)`', 1), lambda r: contains(r, '/')), '|') AS refs,
      array_to_string(list_transform(regexp_extract_all(c, '(?m)^##? +.+$'), lambda h: ltrim(h, '# ')), '|') AS key_sections FROM m"""
)
def markdown_structure(spark, d):
    p = table(spark, d, "part")
    c = F.concat(F.lit("# "), "p_name", F.lit("\n## Type "), "p_type", F.lit("\nsee [brand](brands/"), "p_brand", F.lit(".md) and `parts/p"), F.col("p_partkey").cast("string"), F.lit(".py` or `x.y`\n### deep"))
    made = extract.document_structure(F.col("c"), "markdown")
    return p.select("p_partkey", c.alias("c")).select("p_partkey", *[F.array_join(made[k], "|").alias(a) for k, a in (("headings", "headings"), ("references", "refs"), ("key_sections", "key_sections"))])


@query(
    """WITH m AS (SELECT s_suppkey, '[core]' || chr(10) || 'name = ' || s_name || chr(10) || '[nation.' || s_nationkey || ']' || chr(10) || 'A_KEY=1' || chr(10) || 'top-key: 2' AS c FROM supplier)
    SELECT s_suppkey, array_to_string(regexp_extract_all(c, '(?m)^\\[[^\\]]+\\]'), '|') AS toml, array_to_string(regexp_extract_all(c, '(?m)^\\[([^\\]]+)\\]', 1), '|') AS ini,
      array_to_string(regexp_extract_all(c, '(?m)^([A-Z_][A-Z0-9_]*)=', 1), '|') AS env, array_to_string(regexp_extract_all(c, '(?m)^([A-Za-z0-9_][A-Za-z0-9_-]*):', 1), '|') AS yaml FROM m"""
)
def config_structure(spark, d):
    c = F.concat(F.lit("[core]\nname = "), "s_name", F.lit("\n[nation."), F.col("s_nationkey").cast("string"), F.lit("]\nA_KEY=1\ntop-key: 2"))
    made = lambda k: F.array_join(extract.document_structure(F.col("c"), k)["headings"], "|").alias(k)
    return table(spark, d, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", made("toml"), made("ini"), made("env"), made("yaml"))


_CODE = {
    "javascript": ("import {{a}} from './m{k}'; const b = require('lib{k}');\nexport default class C{k} {{}}\nexport const v{k} = 1\nfunction f{k}() {{}}", "import {{a}} from './m{k}'|./m{k},lib{k}|class C{k},v{k},function f{k}"),
    "java": ("import a.b{k};\npublic class C{k} {{ public static int m{k}() {{}} }}\ninterface I{k} {{}}", "import a.b{k}|a.b{k}|class C{k},interface I{k},method m{k}"),
    "go": ('import "x{k}"\nimport (\n  "y{k}"\n  "z"\n)\nfunc (r T) F{k}() {{}}\ntype S{k} struct {{}}', "|x{k},y{k},z|func F{k},type S{k}"),
    "c": ('#include <a{k}.h>\n#include "b.h"\nclass C{k} {{}};\ntypedef struct s{k} x;', "#include a{k}.h,#include b.h|a{k}.h,b.h|class C{k},struct s{k}"),
    "rust": ("use a::b{k};\npub async fn f{k}() {{}}\npub struct S{k};\npub enum E {{}}\npub trait T {{}}", "use a::b{k}|a::b{k}|fn f{k},struct S{k},enum E,trait T"),
    "ruby": ("require 'a{k}'\nrequire_relative \"b\"\nmodule M::N{k}\nclass C < D\ndef self.go?\nend", "|a{k},b|class C,module M::N{k},def go?"),
    "php": ("use App;\nrequire_once 'a{k}.php';\nclass C{k} {{}}\nfunction f{k} () {{}}", "|App,a{k}.php|class C{k},function f{k}"),
    "shell": ("source ./env{k}.sh\nf{k}() {{\n}}", "|./env{k}.sh|function f{k}"),
    "other": ("import x{k}\n  import y\nfunc f{k}\nclass C{k}", "import x{k}||function f{k},class C{k}"),
}


def _code_sql() -> str:
    rows = []
    for kind, (_, wanted) in _CODE.items():
        text = "'" + wanted.replace("'", "''").format(k="' || r_regionkey || '") + "'"
        rows.append(f"SELECT '{kind}' AS kind, r_regionkey, {text} AS structure FROM region")
    return " UNION ALL ".join(rows)


@query(_code_sql())
def code_structure(spark, d):
    """Imports, sources and exports of a small source of each language."""
    k, out = F.col("r_regionkey").cast("string"), None
    for kind, (source, _) in _CODE.items():
        parts = source.format(k="\0").split("\0")
        text = F.concat(*[x for i, p in enumerate(parts) for x in ([k] if i else []) + [F.lit(p)]])
        made = extract.code_structure(F.col("c"), kind)
        structure = F.concat_ws("|", *[F.array_join(made[f], ",") for f in ("imports", "import_sources", "exports")])
        one = table(spark, d, "region").select(F.lit(kind).alias("kind"), "r_regionkey", text.alias("c")).select("kind", "r_regionkey", structure.alias("structure"))
        out = one if out is None else out.union(one)
    return out


# --- walk -----------------------------------------------------------------------

_EXT = "lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))"
_TYPES = "MAP {'.py': 'python', '.md': 'markdown', '.js': 'javascript', '.yaml': 'yaml'}"
_WALKED = f"""SELECT relative_path, size_bytes, {_TYPES}[{_EXT}] AS file_type FROM (SELECT *, split_part(relative_path, '/', -1) AS name, string_split(relative_path, '/') AS parts FROM {V.TREE_PATHS})
  WHERE size_bytes BETWEEN 1 AND 1000000 AND name NOT IN ({_quoted(EXCLUDED_FILES)}) AND NOT list_has_any(parts[1:len(parts) - 1], [{_quoted(EXCLUDED_DIRS)}]) AND {_TYPES}[{_EXT}] IS NOT NULL"""


@query(f"SELECT relative_path, size_bytes, file_type FROM ({_WALKED})")
def walk_filter(spark, d):
    return walk.indexable(V.tree_paths(spark, d)).select("relative_path", "size_bytes", "file_type")


@query(f"SELECT file_type, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_WALKED}) GROUP BY file_type")
def type_counts(spark, d):
    return walk.indexable(V.tree_paths(spark, d)).groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(
    f"""SELECT relative_path FROM ({_WALKED}) WHERE NOT (list_contains(string_split(relative_path, '/'), 'logs') OR relative_path LIKE '%u7%' OR relative_path LIKE '/src/view/%' OR relative_path LIKE 'src/view/%' OR relative_path LIKE '%.JS')"""
)
def gitignore_filter(spark, d):
    return walk.indexable(V.tree_paths(spark, d), IGNORE).select("relative_path")


@query(
    f"""WITH p AS (SELECT string_split(relative_path, '/') AS parts FROM {V.TREE_PATHS})
    SELECT DISTINCT array_to_string(parts[1:i], '/') AS parent, parts[i + 1] AS name, CAST(i AS INTEGER) AS depth, i < len(parts) - 1 AS is_dir FROM (SELECT parts, unnest(range(0, len(parts))) AS i FROM p)"""
)
def tree_entries(spark, d):
    return walk.tree_entries(V.tree_paths(spark, d))


@query(f"SELECT relative_path, row_number() OVER (ORDER BY string_split(relative_path, '/')) - 1 AS walk_ord FROM (SELECT DISTINCT relative_path FROM {V.TREE_PATHS})")
def walk_order(spark, d):
    return walk.in_walk_order(V.tree_paths(spark, d).select("relative_path").distinct())


@query(f"SELECT relative_path, split_part(relative_path, '/', -1) AS name, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(split_part(relative_path, '/', -1), '^.+(\\.[^.]+)$', 1) AS ext FROM {V.TREE_PATHS}")
def path_parts(spark, d):
    p = F.col("relative_path")
    return V.tree_paths(spark, d).select("relative_path", basename(p).alias("name"), dirname(p).alias("folder"), suffix(basename(p)).alias("ext"))


# --- edges ----------------------------------------------------------------------

_SOURCES = f"WITH files AS MATERIALIZED (SELECT * FROM {V.SOURCE_FILES})"
_IMPORTS = """modules AS (SELECT path AS source, unnest(regexp_extract_all(content, '(?m)^import ([A-Za-z0-9_.]+)$', 1)) AS module FROM files WHERE category = 'code'),
cands AS (SELECT source, module, unnest(range(0, 11)) AS r, unnest([f || '.py', f || '/__init__.py', f || '.js', f || '.jsx', f || '.ts', f || '.tsx', f || '/index.js', f || '/index.ts', module, module || '.rb', f || '/main.go']) AS cand FROM (SELECT *, replace(module, '.', '/') AS f FROM modules)),
imports AS (SELECT source, arg_min(cand, r) AS target, 'imports' AS relation_type, 'import ' || module AS details FROM cands JOIN files ON cand = path GROUP BY source, module)"""
_REFERENCES = """refs AS (SELECT path AS source, unnest(regexp_extract_all(content, '[''"]([a-zA-Z0-9_/.-]+\\.(?:py|js|ts|json|yaml|yml|toml|md|css|html))[''"]', 1)) AS target FROM files),
reference AS (SELECT DISTINCT source, target, 'references' AS relation_type, 'references path ''' || target || '''' AS details FROM refs WHERE target <> source AND target IN (SELECT path FROM files)
  UNION ALL SELECT 'parts/README.md', t, 'references', 'references ' || t FROM (VALUES ('parts/p2.py'), ('parts/p3/index.js')) AS l(t))"""
_TESTS = """tests AS (SELECT t.path AS source, s.path AS target, 'tests' AS relation_type, 'test file for ' || s.path AS details FROM files t JOIN files s ON s.path = replace(t.path, '/test_p', '/p') WHERE t.path LIKE 'parts/test!_p%' ESCAPE '!')"""
_DOCUMENTS = """docs AS (SELECT 'parts/README.md' AS source, 'parts/__init__.py' AS target, 'documents' AS relation_type, 'README for parts' AS details)"""
_EDGES = f"{_SOURCES}, {_IMPORTS}, {_REFERENCES}, {_TESTS}, {_DOCUMENTS}, edges AS (SELECT source, target, relation_type, min(details) AS details FROM (SELECT * FROM imports UNION ALL SELECT * FROM reference UNION ALL SELECT * FROM tests UNION ALL SELECT * FROM docs) WHERE source <> target GROUP BY 1, 2, 3)"


@query(f"{_SOURCES}, {_IMPORTS} SELECT source AS path, module FROM modules")
def py_import_extract(spark, d):
    return V.analysed_sources(spark, d).where("category = 'code'").select("path", F.explode("import_sources").alias("module"))


def _edge_query(f):
    def run(spark, d):
        files = V.analysed_sources(spark, d)
        return edges.deduplicated(f(files, files.select("path"))).drop("pos")

    return run


for _name, _f, _with, _from in (("import_edges", edges.import_edges, _IMPORTS, "imports"), ("reference_edges", edges.reference_edges, _REFERENCES, "reference"), ("test_edges", edges.test_edges, _TESTS, "tests"), ("doc_edges", edges.document_edges, _DOCUMENTS, "docs")):
    QUERIES[_name] = _edge_query(_f)
    SQL[_name] = f"{_SOURCES}, {_with} SELECT source, target, relation_type, min(details) AS details FROM {_from} GROUP BY 1, 2, 3"


def _edges(spark, d, targets=None):
    return edges.all_edges(V.analysed_sources(spark, d), targets=targets).drop("pos")


@query(f"{_EDGES} SELECT * FROM edges")
def edges_dedup(spark, d):
    return _edges(spark, d)


@query(f"{_EDGES} SELECT relation_type, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges GROUP BY relation_type")
def edge_counts(spark, d):
    return _edges(spark, d).groupBy("relation_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


_TARGETS = "targets AS (SELECT path FROM files WHERE path LIKE 'parts/%/index.js')"


def _targets(spark, d):
    """All files of one kind."""
    return V.source_files(spark, d).where("path LIKE 'parts/%/index.js'").select("path")


@query(f"{_EDGES}, {_TARGETS} SELECT source, target, relation_type FROM edges WHERE source IN (SELECT path FROM targets) OR target IN (SELECT path FROM targets)")
def incident_edges(spark, d):
    targets = _targets(spark, d)
    return graph.incident(_edges(spark, d, targets), targets).select("source", "target", "relation_type")


_UNDIRECTED = "und AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges)"


@query(f"{_EDGES}, {_TARGETS}, {_UNDIRECTED} SELECT DISTINCT node AS path, other AS neighbour FROM und WHERE node IN (SELECT path FROM targets)")
def neighbors_1hop(spark, d):
    targets = _targets(spark, d)
    return graph.neighbours(_edges(spark, d, targets), targets)


@query(f"{_EDGES}, {_UNDIRECTED} SELECT DISTINCT node AS path, other AS neighbour FROM und")
def neighbors_all(spark, d):
    """The neighbourhood of every file."""
    return graph.neighbours(_edges(spark, d), V.source_files(spark, d).select("path"))


@query(f"{_EDGES}, {_TARGETS}, {_UNDIRECTED} SELECT DISTINCT other AS path FROM und WHERE node IN (SELECT path FROM targets) AND other NOT IN (SELECT path FROM targets)")
def connected_minus_selected(spark, d):
    targets = _targets(spark, d)
    return graph.connected(_edges(spark, d, targets), targets)


# --- snapshots ------------------------------------------------------------------


@query(
    f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM {V.SNAP_OLD} o FULL JOIN {V.SNAP_NEW} n ON o.path = n.path"""
)
def index_diff(spark, d):
    return diff.compared(*V.snapshots(spark, d))


@query(f"SELECT n.path, n.content_hash FROM {V.SNAP_NEW} n LEFT JOIN {V.SNAP_OLD} o ON o.path = n.path AND o.content_hash = n.content_hash WHERE o.path IS NULL")
def index_to_process(spark, d):
    return diff.to_process(*V.snapshots(spark, d))


@query(f"SELECT path FROM {V.SNAP_OLD} WHERE path NOT IN (SELECT path FROM {V.SNAP_NEW})")
def deleted_paths(spark, d):
    return diff.deleted(*V.snapshots(spark, d))


@query(
    f"""SELECT count(*) FILTER (o.path IS NULL OR o.content_hash <> n.content_hash) AS to_process, count(*) AS files, count(*) FILTER (o.path IS NULL OR o.content_hash <> n.content_hash) / greatest(1, count(*)) AS ratio
    FROM {V.SNAP_NEW} n LEFT JOIN {V.SNAP_OLD} o ON o.path = n.path"""
)
def change_ratio(spark, d):
    return diff.change_ratio(diff.compared(*V.snapshots(spark, d)))


# --- routing --------------------------------------------------------------------

_WORDS = "['where', 'does', 'source', 'src3', 'text', 'about', 'thereading', 'french']"
_SCORED = f"""SELECT path, node_ord, CAST(5 * len(list_filter({_WORDS}, lambda w: contains(lower(path), w)))
  + 3 * list_sum(list_transform(key_topics, lambda t: len(list_filter({_WORDS}, lambda w: contains(lower(t), w)))))
  + 2 * list_sum(list_transform(exports, lambda t: len(list_filter({_WORDS}, lambda w: contains(lower(t), w)))))
  + CASE WHEN contains(lower(path), 'main') OR contains(lower(path), 'index') OR contains(lower(path), '__init__') THEN 1 ELSE 0 END AS INTEGER) AS score FROM {V.DOC_NODES}"""


@query(f"SELECT path, score FROM ({_SCORED})")
def score_all(spark, d):
    return score.scored(V.doc_nodes(spark, d), F.lit(QUESTION)).select("path", "score")


@query(f"SELECT path, score FROM ({_SCORED}) ORDER BY score DESC, node_ord LIMIT 20")
def route_top20(spark, d):
    return score.best(V.doc_nodes(spark, d), F.lit(QUESTION), 20).select("path", "score")


@query("SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS words FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT item_id, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 3), lambda x: trim(lower(x), '?,.!')) AS w FROM benchmark))")
def question_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(score.question_words(F.col("text")), " ").alias("words"))


_NAMES = ["src1/en_1.txt", "docs/src2/en_2.txt.bak", "nowhere", "fr_"]


@query(
    f"""WITH names AS (SELECT unnest([{_quoted(_NAMES)}]) AS name), nodes AS (SELECT path, doc_id AS node_ord FROM {V.DOC_FILES})
    SELECT name, arg_min(path, CASE WHEN path = name THEN -1 ELSE node_ord END) AS path FROM names JOIN nodes ON contains(path, name) OR contains(name, path) GROUP BY name"""
)
def fuzzy_path_match(spark, d):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return score.fuzzy_paths(names, V.doc_files(spark, d).select("path", F.col("doc_id").alias("node_ord")))




@query("SELECT item_id, 'docs/src' || (item_id % 20) || '|b.py' AS files, 'item ' || item_id AS reasoning FROM benchmark")
def parse_route_response(spark, d):
    """Replies parsed as columns: names of all FILES: lines, the last REASONING:."""
    i = F.col("item_id").cast("string")
    reply = F.concat(F.lit('FILES: ["docs/src'), (F.col("item_id") % 20).cast("string"), F.lit('", "b.py"]\nReasoning: item '), i)
    return table(spark, d, "benchmark").select("item_id", reply.alias("reply")).select("item_id", F.array_join(context.route_names(F.col("reply")), "|").alias("files"), context.route_reason(F.col("reply")).alias("reasoning"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN substring(text, 1, 500) ELSE trim(text[1:20]) END AS summary, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'a|b ' || item_id END AS topics FROM (SELECT item_id, regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS text FROM benchmark)")
def parse_summary_response(spark, d):
    one = F.trim(F.get(lines(F.col("text")), F.lit(0)))
    reply = F.when(F.col("item_id") % 3 == 0, one).otherwise(F.concat(F.lit("summary: old\nSUMMARY: "), F.substring(one, 1, 20), F.lit("\nTopics: a, ,b "), F.col("item_id").cast("string")))
    made = table(spark, d, "benchmark").select("item_id", reply.alias("reply"))
    summary, topics = summaries.parsed_reply(F.col("reply"))
    return made.select("item_id", summary.alias("summary"), F.array_join(topics, "|").alias("topics"))


# --- summaries ------------------------------------------------------------------


def _analysed_docs(spark, d):
    return extract.analysed(V.doc_files(spark, d).withColumnRenamed("path", "relative_path")).withColumnRenamed("relative_path", "path")


@query("SELECT 'docs/' || source || '/' || lang || '_' || doc_id || '.txt' AS path, CASE WHEN text <> '' THEN 'Document file containing: ' || substring(text, 1, 200) ELSE 'Text file (0 lines).' END AS summary FROM documents")
def fallback_summary(spark, d):
    return _analysed_docs(spark, d).select("path", summaries.fallback_summary().alias("summary"))


@query(
    """WITH l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents), s AS (SELECT doc_id, source, lang, list_transform(a[1:100], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS a FROM l)
    SELECT 'docs/' || source || '/' || lang || '_' || doc_id || '.txt' AS path, array_to_string(list_concat(['text'], list_filter(a, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 3)[1:5]), '|') AS topics FROM s"""
)
def fallback_topics(spark, d):
    return _analysed_docs(spark, d).select("path", F.array_join(summaries.fallback_topics(), "|").alias("topics"))


_BATCHED = f"(SELECT path, n // 5 AS batch, CAST(n % 5 AS INTEGER) AS slot, size_bytes FROM (SELECT path, size_bytes, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS n FROM {V.DOC_FILES} WHERE size_bytes <= 2000))"


@query(f"SELECT path, CAST(batch AS BIGINT) AS batch, slot FROM {_BATCHED}")
def small_batches(spark, d):
    return summaries.batched(V.doc_files(spark, d)).where("batch IS NOT NULL").select("path", "batch", "slot")


@query(f"SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, string_agg(path, '|' ORDER BY slot) AS paths FROM {_BATCHED} GROUP BY batch")
def batch_prompt_files(spark, d):
    files = summaries.batched(_analysed_docs(spark, d))
    return summaries.batch_prompts(files).select("batch", "n", F.array_join("paths", "|").alias("paths"))


@query(f"SELECT '{summaries.PROJECT_HEAD}' || string_agg('- ' || path || ': ' || s, chr(10) ORDER BY doc_id) || '{summaries.PROJECT_TAIL}' AS prompt FROM (SELECT doc_id, path, substring(content, 1, 40) AS s FROM {V.DOC_FILES} ORDER BY doc_id LIMIT 50)")
def project_summary_input(spark, d):
    return summaries.project_prompt(V.doc_files(spark, d).select("path", F.substring("content", 1, 40).alias("summary"), F.col("doc_id").alias("node_ord")))


# --- context --------------------------------------------------------------------

_CUT = "chr(10) || chr(10) || '[... File truncated due to context limits. Showing first ' || {n} || ' chars ...]'"


@query(f"WITH f AS (SELECT path, content, 100000 // greatest(1, count(*) OVER ()) AS lim FROM {V.DOC_FILES}) SELECT path, CASE WHEN length(content) > lim THEN substring(content, 1, lim) || {_CUT.format(n='lim')} ELSE content END AS content FROM f")
def context_budget(spark, d):
    return context.budgeted(V.doc_files(spark, d).select("path", "content"), total_chars=100_000)


@query(
    f"""WITH routed AS (SELECT path, row_number() OVER (ORDER BY score DESC, node_ord) AS ord FROM ({_SCORED}) ORDER BY score DESC, node_ord LIMIT 20)
    SELECT string_agg('### File: ' || path || chr(10) || '```' || chr(10) || c || chr(10) || '```' || chr(10), chr(10) ORDER BY ord) AS context
    FROM (SELECT ord, path, CASE WHEN length(content) > 4000 THEN substring(content, 1, 4000) || {_CUT.format(n='4000')} ELSE content END AS c FROM routed JOIN {V.DOC_FILES} USING (path))"""
)
def answer_context(spark, d):
    """The context of the candidates for a question, best first."""
    best = score.best(V.doc_nodes(spark, d), F.lit(QUESTION), 20).select("path", F.struct((-F.col("score")).alias("s"), "node_ord").alias("ord"))
    texts = V.doc_files(spark, d).select("path", "content").join(F.broadcast(best), "path")  # twenty rows
    return context.assembled(context.budgeted(texts, each_chars=4000))


# --- the Python parser, prompts and replies -----------------------------------------


@query(
    f"""{_SOURCES}, m AS (SELECT path, string_agg('import ' || module, '|' ORDER BY i) AS imports FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^import ([A-Za-z0-9_.]+)$', 1)) AS module, generate_subscripts(regexp_extract_all(content, '(?m)^import ([A-Za-z0-9_.]+)$', 1), 1) AS i FROM files WHERE category = 'code') GROUP BY path)
    SELECT path, coalesce(imports, '') AS imports, '' AS exports, '' AS docstring FROM files LEFT JOIN m USING (path) WHERE category = 'code'"""
)
def ast_exports(spark, d):
    """Python structure by syntax tree, in Arrow batches."""
    made = V.source_files(spark, d).where("category = 'code'").select("path", python_structure("content").alias("s"))
    return made.select("path", F.array_join("s.imports", "|").alias("imports"), F.array_join("s.exports", "|").alias("exports"), "s.docstring")


@query("SELECT p_partkey, 'import a.b|import c|from  import d|from e' || p_partkey || ' import f, g|import deep' AS imports, 'a.b|c|e' || p_partkey || '|deep' AS sources, 'async def run(x, y, z, ...)|class C' || p_partkey || '|SIZE' || p_size AS exports, 'Part ' || p_name || '.' AS docstring FROM part")
def python_structures(spark, d):
    """Python sources by the index's own analysis: imports at any depth, exports at the top, docstring."""
    k, at = F.col("p_partkey").cast("string"), F.lit
    text = F.concat(at('"""Part '), "p_name", at('."""\nimport a.b, c\nfrom . import d\nfrom .e'), k, at(" import f, g\nasync def run(self, x, y, z, w):\n    import deep\nclass C"), k, at(": pass\nSIZE"), F.col("p_size").cast("string"), at(" = low = 1"))
    rows = table(spark, d, "part").select("p_partkey", F.lit("a.py").alias("relative_path"), text.alias("content"), F.lit("python").alias("file_type"), F.lit("code").alias("category"))
    made = extract.analysed(rows)
    return made.select("p_partkey", F.array_join("imports", "|").alias("imports"), F.array_join("import_sources", "|").alias("sources"), F.array_join("exports", "|").alias("exports"), "docstring")


@query("SELECT p_partkey, 'import a, b|from .m' || p_partkey || ' import x' AS imports, 'a|.m' || p_partkey AS sources, 'def f()|class C' || p_partkey AS exports, '' AS docstring FROM part")
def python_fallback(spark, d):
    """Python sources without a syntax tree, line by line."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import a, b\nfrom .m"), k, F.lit(" import x\ndef f(:\nclass C"), k, F.lit("\n"))
    made = table(spark, d, "part").select("p_partkey", python_structure(text).alias("s"))
    return made.select("p_partkey", F.array_join("s.imports", "|").alias("imports"), F.array_join("s.import_sources", "|").alias("sources"), F.array_join("s.exports", "|").alias("exports"), "s.docstring")


@query(
    """SELECT 'rel/a/m' || p_partkey || '.py' AS source, 'rel/top.py' AS target, 'imports' AS relation_type, 'from ..top import y' AS details FROM part
    UNION ALL SELECT 'rel/a/m' || p_partkey || '.py', 'rel/a/p' || p_partkey || '.py', 'imports', 'from .p' || p_partkey || ' import x' FROM part WHERE p_partkey % 2 = 0"""
)
def relative_import_edges(spark, d):
    """Relative imports, whose dots only sources without a syntax tree keep."""
    parts, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    modules = parts.select(F.concat(F.lit("rel/a/m"), k, F.lit(".py")).alias("relative_path"), F.concat(F.lit("from .p"), k, F.lit(" import x\nfrom ..top import y\ndef broken(:\n")).alias("content"))
    named = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("rel/a/p"), k, F.lit(".py")).alias("relative_path"), F.lit("").alias("content"))
    files = modules.union(named).union(spark.createDataFrame([("rel/top.py", "")], "relative_path string, content string")).withColumns({"file_type": F.lit("python"), "category": F.lit("code")})
    known = extract.analysed(files).withColumnRenamed("relative_path", "path")
    return edges.deduplicated(edges.import_edges(known, known.select("path"))).drop("pos")


_TEST_PAIRS = (("test_a{k}.py", "a{k}.py"), ("b{k}_test.py", "b{k}.py"), ("c{k}.test.ts", "c{k}.ts"), ("d{k}.spec.jsx", "d{k}.jsx"), ("TestE{k}.java", "E{k}.java"), ("F{k}Test.java", "F{k}.java"), ("g{k}_test.go", "g{k}.go"), ("h{k}_test.rb", "h{k}.rb"))
_TEST_PLACES = ("lib/t/", "lib/", "lib/src/", "src/", "")


def _test_pair_sql() -> str:
    k = "' || s_suppkey || '"
    place = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_TEST_PLACES)) + " END"
    rows = [f"SELECT 'lib/t/{t.format(k=k)}' AS source, {place} || '{s.format(k=k)}' AS target FROM supplier" for t, s in _TEST_PAIRS]
    return "SELECT source, target, 'tests' AS relation_type, 'test file for ' || target AS details FROM (" + " UNION ALL ".join(rows) + ")"


@query(_test_pair_sql())
def test_name_edges(spark, d):
    """All patterns of test names, with what they test in each of the places that are looked at."""
    k = F.col("s_suppkey").cast("string")
    filled = lambda name: F.concat(*[x for i, p in enumerate(name.split("{k}")) for x in ([k] if i else []) + [F.lit(p)]])
    place = F.element_at(F.array(*[F.lit(p) for p in _TEST_PLACES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    both = F.array(*[x for t, s in _TEST_PAIRS for x in (F.concat(F.lit("lib/t/"), filled(t)), F.concat(place, filled(s)))])
    files = table(spark, d, "supplier").select(F.explode(both).alias("path"))
    return edges.deduplicated(edges.test_edges(files, files)).drop("pos")


@query("SELECT s_suppkey, s_name || '|Under ' || s_suppkey AS headings, 'directive: note|directive: code' AS key_sections FROM supplier")
def rst_structure(spark, d):
    text = F.concat(F.col("s_name"), F.lit("\n=====\n\nplain\n\nUnder "), F.col("s_suppkey").cast("string"), F.lit("\n  ~~~~\n.. note:: x\n\n.. code:: python\n--"))
    made = extract.document_structure(F.col("c"), "restructuredtext")
    return table(spark, d, "supplier").select("s_suppkey", text.alias("c")).select("s_suppkey", *[F.array_join(made[f], "|").alias(f) for f in ("headings", "key_sections")])


@query("SELECT doc_id, text || chr(10) || 'x' || chr(10) || 'caf' || chr(233) AS valid, 'caf' || chr(233) || chr(10) || doc_id AS latin FROM documents")
def decoded_text(spark, d):
    """UTF-8 bytes, and bytes that are not, with line ends of all kinds."""
    text = lambda c, charset: extract.decoded(F.encode(c, charset))
    rows = table(spark, d, "documents")
    return rows.select("doc_id", text(F.concat("text", F.lit("\r\nx\rcafé")), "UTF-8").alias("valid"), text(F.concat(F.lit("café\r\n"), F.col("doc_id").cast("string")), "ISO-8859-1").alias("latin"))


_LONG = "repeat(text, CAST(ceil(400000 / greatest(1, length(text))) AS INTEGER) + CASE WHEN doc_id % 2 = 0 THEN CAST(ceil(200000 / greatest(1, length(text))) AS INTEGER) ELSE 0 END)"


@query(f"SELECT doc_id, sha256(CASE WHEN length(c) > 500000 THEN substring(c, 1, 500000) || chr(10) || chr(10) || '[... file truncated due to size ...]' ELSE c END) AS content_hash FROM (SELECT doc_id, {_LONG} AS c FROM documents)")
def index_truncate(spark, d):
    """Hashes of texts on either side of the length at which the index cuts them."""
    n = F.greatest(F.lit(1), F.char_length("text"))
    times = F.ceil(F.lit(400000) / n).cast("int") + F.when(F.col("doc_id") % 2 == 0, F.ceil(F.lit(200000) / n).cast("int")).otherwise(F.lit(0))
    cut = truncated(F.col("c"), Settings().max_text_chars, extract.CUT_MARK)
    return table(spark, d, "documents").select("doc_id", F.repeat("text", times).alias("c")).select("doc_id", F.sha2(cut, 256).alias("content_hash"))


@query(f"SELECT relative_path, size_bytes, file_type FROM ({_WALKED}) WHERE NOT (split_part(relative_path, '/', -1) LIKE 'f1%' OR regexp_matches(relative_path, '[37]\\.py$'))")
def glob_filter(spark, d):
    return walk.indexable(V.tree_paths(spark, d), settings=Settings(excluded_globs=("f1*", "*[37].py"))).select("relative_path", "size_bytes", "file_type")


def _echo(prompt: str) -> str:
    """A deterministic model: its summaries name the files it was shown."""
    shown = prompt.split("\n")
    batch = [x.split(": ", 1)[1].removesuffix(" ---") for x in shown if x.startswith("--- FILE ")]
    one = lambda path: f"SUMMARY: seen {path}\nTOPICS: a, {path.rpartition('/')[2]}"
    if batch:
        return "\n".join(f"FILE {i + 1}:\n{one(p)}" for i, p in enumerate(batch))
    return one(next(x for x in shown if x.startswith("File: "))[6:])


@query("SELECT path, 'seen ' || path AS summary, 'a|' || split_part(path, '/', -1) AS topics FROM " + V.DOC_FILES)
def summaries_by_model(spark, d):
    """Summaries of all documents, large ones alone and small ones in batches, by a model that names what it is shown."""
    made = summaries.summarised(_analysed_docs(spark, d), _echo)
    return made.select("path", "summary", F.array_join("key_topics", "|").alias("topics"))


_HEADINGS = r"(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:100], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 3) AS h FROM documents)"
_SINGLE = f"""'{summaries.SINGLE_HEAD}' || 'File: ' || path || chr(10) || 'Type: text (document)' || chr(10) || 'Lines: ' || (length(content) - length(replace(content, chr(10), '')) + 1) || chr(10)
  || CASE WHEN len(h) > 0 THEN 'Headings: ' || array_to_string(h[1:10], ', ') || chr(10) ELSE '' END
  || 'Content:' || chr(10) || CASE WHEN length(content) > 3000 THEN substring(content, 1, 3000) || chr(10) || '[... truncated ...]' ELSE content END || '{summaries.SINGLE_TAIL}'"""


@query(f"SELECT path, {_SINGLE} AS prompt FROM {V.DOC_FILES} JOIN {_HEADINGS} USING (doc_id) WHERE content <> ''")
def single_prompts(spark, d):
    return _analysed_docs(spark, d).where("content <> ''").select("path", summaries.single_prompt().alias("prompt"))


@query("SELECT item_id, CAST(k AS INTEGER) AS slot, CASE WHEN k = 2 THEN 'Summary not available.' ELSE 'item ' || item_id || ' ' || (CASE k WHEN 0 THEN 'one' ELSE 'three' END) END AS summary, CASE k WHEN 0 THEN 'x|y' ELSE '' END AS topics FROM benchmark, (SELECT unnest(range(0, 3)) AS k)")
def parse_batch_reply(spark, d):
    """Replies about three files of which one has no summary: it vanishes, and the last is padded."""
    i = F.col("item_id").cast("string")
    reply = F.concat(F.lit("FILE 1:\nSUMMARY: item "), i, F.lit(" one\nTOPICS: x, , y\nFILE 2:\nTOPICS: lost\nFILE 3:\nsummary: item "), i, F.lit(" three"))
    made = table(spark, d, "benchmark").select("item_id", summaries.batch_entries(reply, F.lit(3)).alias("entries"))
    each = made.select("item_id", F.posexplode("entries").alias("slot", "e"))
    return each.select("item_id", "slot", F.col("e.summary").alias("summary"), F.array_join("e.topics", "|").alias("topics"))


# --- many questions ------------------------------------------------------------------

_ASKED = r"""asked AS (SELECT item_id AS question_id, text AS question, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM
  (SELECT item_id, text, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: length(x) > 3), lambda x: trim(lower(x), '?,.!')) AS w FROM benchmark))"""
_FOR_ALL = f"""{_ASKED}, nodes AS MATERIALIZED (SELECT * FROM {V.DOC_NODES}),
pointed AS (SELECT question_id, path, node_ord, CAST(5 * len(list_filter(words, lambda w: contains(lower(path), w)))
  + 3 * list_sum(list_transform(key_topics, lambda t: len(list_filter(words, lambda w: contains(lower(t), w)))))
  + 2 * list_sum(list_transform(exports, lambda t: len(list_filter(words, lambda w: contains(lower(t), w))))) AS INTEGER) AS score FROM asked, nodes),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_ord) AS INTEGER) AS rank FROM pointed)"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query(f"WITH {_FOR_ALL} SELECT question_id, rank, path, score FROM ranked WHERE rank <= 20")
def route_many(spark, d):
    """The candidates of every benchmark text taken as a question."""
    return score.best_for_all(_questions(spark, d), V.doc_nodes(spark, d), 20).select("question_id", "rank", "path", "score")


def _answerer(prompt: str) -> str:
    """Routes to the first and third candidate, and tells what an answer's prompt holds."""
    if prompt.startswith(context.ROUTE_HEAD):
        shown = json.loads(prompt[prompt.index("FILES:\n") + 7 : prompt.rindex("\n\nSelect the ")])
        return f'FILES: "{shown[0]["path"]}", {shown[2]["path"]}, {shown[0]["path"]}\nREASONING: of {len(shown)}'
    return f"{prompt.count('### File: ')} {prompt.count('### Connected File: ')} {len(prompt)}"


_NOTICE = "[... File truncated due to context limits. Showing first {} chars ...]"
_NEXT = "next AS (SELECT a.path AS source, b.path AS target FROM files a JOIN files b ON b.doc_id = a.doc_id + 1)"


@query(
    f"""WITH {_FOR_ALL}, files AS MATERIALIZED (SELECT * FROM {V.DOC_FILES}), {_NEXT},
    chosen AS (SELECT question_id, path, rank FROM ranked WHERE rank IN (1, 3)),
    near AS (SELECT DISTINCT question_id, other AS path FROM (SELECT question_id, target AS other FROM chosen JOIN next ON source = path UNION SELECT question_id, source FROM chosen JOIN next ON target = path) n
      WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.question_id = n.question_id AND c.path = n.other)),
    parts AS (SELECT question_id, 0 AS beside, path, rank, CASE WHEN length(content) > 50000 THEN 50000 + {len(_NOTICE.format(50000)) + 2} ELSE length(content) END AS n FROM chosen JOIN files USING (path)
      UNION ALL SELECT question_id, 1, path, 0, CASE WHEN length(content) > 4000 THEN 4000 + {len(_NOTICE.format(4000)) + 2} ELSE length(content) END FROM near JOIN files USING (path)),
    counted AS (SELECT question_id, count(*) FILTER (beside = 0) AS n_files, count(*) FILTER (beside = 1) AS n_beside, sum(n + length(path)) AS chars,
      string_agg(path, '|' ORDER BY rank) FILTER (beside = 0) AS sources, coalesce(string_agg(path, '|' ORDER BY path) FILTER (beside = 1), '') AS connections FROM parts GROUP BY question_id)
    SELECT question_id, n_files || ' ' || n_beside || ' ' || CAST({len(context.ANSWER_HEAD) + len(context.PRIMARY) + 1} + chars + {len("### File: ") + 10} * n_files + n_files - 1
      + CASE WHEN n_beside > 0 THEN {len(context.CONNECTED) + 2} + {len("### Connected File: ") + 10} * n_beside + n_beside - 1 ELSE 0 END + {len("QUESTION: ") + 2 + len(context.ANSWER_TAIL)} + length(question) AS BIGINT) AS text,
      sources, connections, 'of 20' AS reasoning, CAST(0.0 AS DOUBLE) AS confidence FROM counted JOIN asked USING (question_id)"""
)
def answers_many(spark, d):
    """Every benchmark text asked of all documents: routed, read with its neighbours, answered by a model that measures its prompt."""
    files = V.doc_files(spark, d)
    nodes = V.doc_nodes(spark, d).withColumns({"summary": F.lit("s"), "file_type": F.lit("text")})
    after = files.select((F.col("doc_id") - 1).alias("before_id"), F.col("path").alias("target"))
    links = files.select("doc_id", F.col("path").alias("source")).join(after, F.col("doc_id") == F.col("before_id")).select("source", "target")
    read = lambda paths: files.join(paths.withColumnRenamed("path", "wanted"), F.col("path") == F.col("wanted")).select("path", "content")
    made = asking.answers(_questions(spark, d), nodes, links, read, _answerer)
    return made.select("question_id", "text", F.array_join("sources", "|").alias("sources"), F.array_join("connections", "|").alias("connections"), "reasoning", "confidence")


@query()
def source_scan(spark, d):
    """The library's own tree through the project data source."""
    from quarrymap.sources import project

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return walk.indexable(project.listing(spark, root)).select("relative_path", "size_bytes", "file_type")
