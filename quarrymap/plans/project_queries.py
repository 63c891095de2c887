"""Queries that index and ask a small project on disk, written from the nation and region tables."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions import binary_documents
from quarrymap.operators import context
from quarrymap.operators.numbering import shared_folder
from quarrymap.plans import asking
from quarrymap.plans.engine import QuarryMap
from quarrymap.plans.queries import _echo, query
from quarrymap.plans.views import table
from quarrymap.settings import MAP_FILE

#: Path and text of the files, one for each nation ({k}, in region {r}) or region ({r}); type and category.
_OF_NATIONS = (("n/n{k}.py", '"""Nation {k}."""\nimport r.region{r}\n\ndef visit(self, a, b, c, d):\n    pass\nclass N{k}: pass\nKEY{k} = 1\n', "python", "code"),)
_OF_REGIONS = (
    ("r/region{r}.py", "class Region{r}: pass\n", "python", "code"),
    ("r/test_region{r}.py", "import r.region{r}\n", "python", "code"),
    ("_hidden/h{r}.yaml", "key{r}: 1\n", "yaml", "document"),
    ("latin/l{r}.txt", "CAPS LINE\ncafé {r}\n", "text", "document"),
)
_ONCE = (("r/__init__.py", "X = 1\n", "python", "code"), ("r/README.md", "# Regions\n\nsee [zero](./r/region0.py)\n", "markdown", "document"))
#: What is not indexed: excluded or ignored folders, unknown types, names, sizes.
_LEFT_OUT = {"node_modules/x.py": "x = 1\n", "skip/s.py": "s = 1\n", "empty.py": "", "a.bin": "1", ".env": "A=1\n", "yarn.lock": "1", ".gitignore": "# note\nskip/\n", "big.txt": "x" * 1_000_001}
_QUESTION = "Where is nation three visited?"


def _project(spark: SparkSession, d: str) -> str:
    """The root of a new tree, in the folder that the driver and all executors share."""
    shared = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).toUri()
    if shared.getScheme() not in (None, "file"):
        raise RuntimeError(f"project trees are opened as files: set spark.checkpoint.dir to a folder that is mounted on the driver and all executors, not {shared}")
    root = os.path.join(os.path.realpath(shared.getPath()), f"quarrymap-project-{uuid.uuid4().hex}")
    os.makedirs(root)  # executors may run as another user
    atexit.register(shutil.rmtree, root, True)
    nations = [r.asDict() for r in table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")).collect()]
    regions = [r.asDict() for r in table(spark, d, "region").select(F.col("r_regionkey").alias("r")).collect()]
    files = dict(_LEFT_OUT)
    for templates, rows in ((_OF_NATIONS, nations), (_OF_REGIONS, regions), (_ONCE, [{}])):
        files |= {path.format(**r): text.format(**r) for path, text, *_ in templates for r in rows}
    for path, text in files.items():
        place = os.path.join(root, path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "wb") as f:
            f.write(text.replace("\n", "\r\n", 1).replace("\n", "\r").replace("\r\r", "\r\n", 1).encode("latin-1") if path.startswith("latin/") else text.encode())
    return root


def _text(template: str) -> str:
    """A template as an SQL expression over nation or region."""
    return "'" + template.replace("'", "''").format(k="' || n_nationkey || '", r="' || n_regionkey || '") + "'"


def _rows(templates, source: str) -> list[str]:
    return [f"SELECT {_text(path)} AS path, {_text(text)} AS content, '{kind}' AS file_type, '{category}' AS category FROM {source}" for path, text, kind, category in templates]


_REGION = "(SELECT r_regionkey AS n_regionkey, 0 AS n_nationkey FROM region)"
_FILES = " UNION ALL ".join(_rows(_OF_NATIONS, "nation") + _rows(_OF_REGIONS, _REGION) + _rows(_ONCE, "(SELECT 0 AS n_regionkey, 0 AS n_nationkey)"))
_TREE = f"""tree AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ord, CAST(CASE WHEN path LIKE 'latin/%' THEN length(content) + 1 ELSE strlen(content) END AS BIGINT) AS size_bytes FROM ({_FILES}))"""
_LINKS = """links AS (
  SELECT 'n/n' || n_nationkey || '.py' AS source, 'r/region' || n_regionkey || '.py' AS target, 'imports' AS relation_type, 1 AS kind, 'import r.region' || n_regionkey AS details FROM nation
  UNION ALL SELECT 'r/test_region' || r_regionkey || '.py', 'r/region' || r_regionkey || '.py', 'imports', 1, 'import r.region' || r_regionkey FROM region
  UNION ALL SELECT 'r/test_region' || r_regionkey || '.py', 'r/region' || r_regionkey || '.py', 'tests', 3, 'test file for r/region' || r_regionkey || '.py' FROM region
  UNION ALL SELECT 'r/README.md', 'r/region0.py', 'references', 2, 'references r/region0.py' UNION ALL SELECT 'r/README.md', 'r/__init__.py', 'documents', 4, 'README for r'),
edges AS (SELECT source, target, relation_type, details, row_number() OVER (ORDER BY string_split(source, '/'), kind, target) - 1 AS emit_ord FROM links)"""


@query(f"WITH {_TREE} SELECT path AS relative_path, size_bytes, file_type, category FROM tree")
def project_files(spark: SparkSession, d: str) -> DataFrame:
    """The indexable files of the tree, through the project source."""
    return QuarryMap(_echo, spark=spark).files(_project(spark, d)).select("relative_path", "size_bytes", "file_type", "category")


@query(
    f"""WITH {_TREE} SELECT path, content, sha256(content) AS content_hash, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS line_count,
    CASE WHEN path LIKE 'n/%' THEN 'def visit(a, b, c, ...)|class N' || regexp_extract(path, '[0-9]+') || '|KEY' || regexp_extract(path, '[0-9]+') WHEN path LIKE 'r/region%' THEN 'class Region' || regexp_extract(path, '[0-9]+') WHEN path = 'r/__init__.py' THEN 'X' ELSE '' END AS exports,
    CASE WHEN path LIKE 'n/%' THEN 'Nation ' || regexp_extract(path, '[0-9]+') || '.' ELSE '' END AS docstring,
    CASE WHEN path = 'r/README.md' THEN '# Regions' WHEN path LIKE '_hidden/%' THEN 'key' || regexp_extract(path, '[0-9]+') WHEN path LIKE 'latin/%' THEN 'CAPS LINE' ELSE '' END AS headings,
    CASE WHEN path = 'r/README.md' THEN './r/region0.py' ELSE '' END AS refs, CASE WHEN category = 'document' THEN content ELSE '' END AS preview FROM tree"""
)
def project_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What the index knows of each file: decoded text, hash, lines, structure."""
    engine = QuarryMap(_echo, spark=spark)
    joined = [F.array_join(c, "|").alias(a) for c, a in (("exports", "exports"), ("headings", "headings"), ("references", "refs"))]
    return engine.analysed(engine.files(_project(spark, d))).select("path", "content", "content_hash", "line_count", "docstring", F.col("content_preview").alias("preview"), *joined)


_NODES = f"""WITH {_TREE} SELECT path, file_type, category, size_bytes, 'seen ' || path AS summary, 'a|' || split_part(path, '/', -1) AS topics, sha256(content) AS content_hash,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS line_count, CAST(ord AS BIGINT) AS node_ord FROM tree"""


def _shown_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("path", "file_type", "category", "size_bytes", "summary", F.array_join("key_topics", "|").alias("topics"), "content_hash", "line_count", "node_ord")


@query(_NODES)
def project_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a new index."""
    return _shown_nodes(QuarryMap(_echo, spark=spark).index(_project(spark, d)).nodes)


@query(f"WITH {_LINKS} SELECT * FROM edges")
def project_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a new index, in order."""
    return QuarryMap(_echo, spark=spark).index(_project(spark, d)).edges


@query(_NODES)
def project_nodes_stored(spark: SparkSession, d: str) -> DataFrame:
    """The nodes as another engine reads them from the stored document."""
    root = _project(spark, d)
    QuarryMap(_echo, spark=spark).index(root)
    return _shown_nodes(QuarryMap(_echo, spark=spark).get_map(root).nodes)


@query(f"WITH {_LINKS} SELECT * FROM edges")
def project_edges_stored(spark: SparkSession, d: str) -> DataFrame:
    root = _project(spark, d)
    QuarryMap(_echo, spark=spark).index(root)
    return QuarryMap(_echo, spark=spark).get_map(root).edges


@query(
    f"""WITH {_TREE}, kept AS (SELECT path, CASE WHEN path = 'n/n0.py' THEN 'again n/n0.py' ELSE 'seen ' || path END AS summary, ord FROM tree WHERE path <> 'n/n1.py' UNION ALL SELECT 'a/new.py', 'again a/new.py', 1000000)
    SELECT path, summary, row_number() OVER (ORDER BY ord) - 1 AS node_ord FROM kept"""
)
def project_update(spark: SparkSession, d: str) -> DataFrame:
    """The nodes after one file changed, one went and one came: only what is new is asked again, the rest keeps its place."""
    root = _project(spark, d)
    QuarryMap(_echo, spark=spark).index(root)
    for path, text in (("n/n0.py", "def other(): pass\n"), ("a/new.py", "new = 1\n")):
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)
    os.remove(os.path.join(root, "n/n1.py"))
    return QuarryMap(_echo_again, spark=spark).index(root).nodes.select("path", "summary", "node_ord")


def _echo_again(prompt: str) -> str:
    return _echo(prompt).replace("SUMMARY: seen", "SUMMARY: again")


@query("SELECT 47 AS files, 'SUMMARY: seen' AS summary, '0.1.0' AS version, 'QuarryMap(indexed 47 files, version=''0.1.0'')' AS shown, 'QuarryMap(not indexed, version=''0.1.0'')' AS before, '_hidden,latin,n,r' AS folders, true AS same_root")
def project_meta(spark: SparkSession, d: str) -> DataFrame:
    """What a map says of its project."""
    root, engine = _project(spark, d), QuarryMap(_about, spark=spark)
    before = repr(engine)
    meta = engine.index(root).meta
    row = (meta.total_files, meta.project_summary, meta.version, repr(engine), before, ",".join(sorted(meta.directory_tree)), meta.root_path == root)
    return spark.createDataFrame([row], "files int, summary string, version string, shown string, before string, folders string, same_root boolean")


def _about(prompt: str) -> str:
    """Says of a project what it says of its first file."""
    return "SUMMARY: seen " if prompt.startswith("Based on") else _echo(prompt)


def _guide(prompt: str) -> str:
    """Routes to two files, one by a part of its name, and answers with its prompt."""
    return prompt if prompt.startswith(context.ANSWER_HEAD) else 'FILES: "n/n3.py", [region2.py], n/n3.py\nREASONING: asked\nReasoning: told'


def _section(word: str) -> str:
    return f"'### {word}: ' || path || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"""WITH {_TREE}, {_LINKS}, chosen AS (SELECT * FROM (VALUES ('n/n3.py', 0), ('r/region2.py', 1)) AS c(path, place)),
    near AS (SELECT DISTINCT other AS path FROM (SELECT target AS other FROM edges JOIN chosen ON source = path UNION SELECT source FROM edges JOIN chosen ON target = path) WHERE other NOT IN (SELECT path FROM chosen)),
    first AS (SELECT string_agg({_section("File")}, chr(10) ORDER BY place) AS shown FROM chosen JOIN tree USING (path)),
    second AS (SELECT string_agg({_section("Connected File")}, chr(10) ORDER BY path) AS shown, string_agg(path, '|' ORDER BY path) AS names FROM near JOIN tree USING (path))
    SELECT {_quoted(context.ANSWER_HEAD + context.PRIMARY)} || chr(10) || first.shown || chr(10) || {_quoted(context.CONNECTED)} || chr(10) || second.shown || chr(10) || chr(10) || {_quoted("QUESTION: " + _QUESTION + context.ANSWER_TAIL)} AS text,
      'n/n3.py|r/region2.py' AS sources, second.names AS connections, 'told' AS reasoning, CAST(0.0 AS DOUBLE) AS confidence FROM first, second"""
)
def project_answer(spark: SparkSession, d: str) -> DataFrame:
    """A question to an indexed project: the whole prompt of the answer, sources, neighbours, reasoning."""
    engine = QuarryMap(_echo, spark=spark)
    engine.index(_project(spark, d))
    engine.model = _guide
    a = engine.ask(_QUESTION)
    return spark.createDataFrame([(a.text, "|".join(a.sources), "|".join(a.connections), a.reasoning, a.confidence)], "text string, sources string, connections string, reasoning string, confidence double")


@query(
    """SELECT * FROM (VALUES ('empty', '', 'Knowledge Map is empty.'), ('failing', 'r/__init__.py|_hidden/h0.yaml|_hidden/h1.yaml', 'LLM routing failed (no answer), using keyword matching fallback.'),
    ('unnamed', '_hidden/h0.yaml', 'No reasoning provided.'), ('unknown', '', 'none'), ('many', 'r/region0.py|r/region1.py|r/region2.py', 'No reasoning provided.')) AS t("case", files, reasoning)"""
)
def project_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routing where the map is empty, the model fails, names nothing, an unknown file, or too many."""
    engine = QuarryMap(_echo, spark=spark)
    known = engine.index(_project(spark, d))
    replies = {"unnamed": "FILES:", "unknown": "FILES: zz.zz\nREASONING: none", "many": "FILES: r/region0.py, r/region1.py\nFILES: r/region1.py, r/region2.py, r/region3.py"}
    rows = []
    for case in ("empty", "failing", *replies):
        engine.model = _failing if case == "failing" else lambda _, case=case: replies[case]
        own = type(known)(known.meta, known.nodes.where("false"), known.edges) if case == "empty" else known
        files, why = engine.route("zzzz", own)
        rows.append((case, "|".join(files), why))
    return spark.createDataFrame(rows, "case string, files string, reasoning string")


def _failing(prompt: str) -> str:
    raise RuntimeError("no answer")


_SMALL = """string_agg('  {' || chr(10) || '    "path": "' || r_regionkey || '.py",' || chr(10) || '    "type": "python",' || chr(10) || '    "summary": "' || r_name || '",' || chr(10) || '    "topics": [' || chr(10) || '      "t' || r_regionkey || '"' || chr(10) || '    ],' || chr(10) || '    "exports": ['
  || chr(10) || (SELECT string_agg('      "e' || i || '"', ',' || chr(10) ORDER BY i) FROM (SELECT unnest(range(0, 10)) AS i)) || chr(10) || '    ]' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey)"""


@query(
    f"""WITH shown AS (SELECT '[' || chr(10) || {_SMALL} || chr(10) || ']' AS j, string_agg(r_regionkey || '.py', '|' ORDER BY r_regionkey) AS paths FROM region)
    SELECT n_nationkey AS question_id, paths, {_quoted(context.ROUTE_HEAD)} || 'A user has asked: ''Where is ' || n_name || '?''' || chr(10) || chr(10) || {_quoted(context.ROUTE_MIDDLE)} || j || chr(10) || chr(10)
      || 'Select the 3 most relevant files that are likely to contain the answer.' || chr(10) || {_quoted(context.ROUTE_TAIL)} AS prompt FROM nation, shown"""
)
def route_prompts_small(spark: SparkSession, d: str) -> DataFrame:
    """The routing prompts of questions to a small map: all of it, in its own order, with ten exports a file."""
    k = F.col("r_regionkey").cast("string")
    nodes = table(spark, d, "region").select(
        F.concat(k, F.lit(".py")).alias("path"), F.lit("python").alias("file_type"), F.col("r_name").alias("summary"), F.array(F.concat(F.lit("t"), k)).alias("key_topics"),
        F.array(*[F.lit(f"e{i}") for i in range(12)]).alias("exports"), F.col("r_regionkey").alias("node_ord"),
    )
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"))
    return asking.route_prompts(asked, nodes).select("question_id", F.array_join("paths", "|").alias("paths"), "prompt")


@query(
    f"""SELECT * FROM (VALUES (0, '', 1, 'usage'), (1, 'index ROOT --full', 0, 'Indexed 47 files.' || chr(10) || 'Map saved to ROOT/{MAP_FILE}' || chr(10)),
    (2, 'map --project ROOT --stats', 0, 'Project: ROOT' || chr(10) || 'Total files: 47' || chr(10) || 'Relationships: 37' || chr(10)),
    (3, 'map --project ROOT', 0, 'seen all' || chr(10) || chr(10) || 'Indexed 47 files.' || chr(10)),
    (4, 'ask Where? --project ROOT', 0, 'told' || chr(10) || chr(10) || 'Sources:' || chr(10) || '  - r/__init__.py' || chr(10) || 'Connected files:' || chr(10) || '  - r/README.md' || chr(10) || 'Reasoning: asked' || chr(10)),
    (5, 'map --project ROOT/r', 1, ''), (6, 'index ROOT/none', 1, '')) AS t(n, command, code, said)"""
)
def project_cli(spark: SparkSession, d: str) -> DataFrame:
    """The command line: what each command says and its exit code."""
    from quarrymap import cli

    root, rows = _project(spark, d), []
    commands = ("", "index ROOT --full", "map --project ROOT --stats", "map --project ROOT", "ask Where? --project ROOT", "map --project ROOT/r", "index ROOT/none")
    for n, command in enumerate(commands):
        engine, said = QuarryMap(_clerk, spark=spark), io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            code = cli.main(command.replace("ROOT", root).split(), engine)
        text = re.sub(r"Last updated: .*\n", "", said.getvalue().replace(root, "ROOT"))
        rows.append((n, command, code, "usage" if text.startswith("usage") else text))
    return spark.createDataFrame(rows, "n int, command string, code int, said string")


def _clerk(prompt: str) -> str:
    if prompt.startswith(context.ROUTE_HEAD):
        return "FILES: r/__init__.py\nREASONING: asked"
    return "told" if prompt.startswith(context.ANSWER_HEAD) else "seen all" if prompt.startswith("Based on") else _echo(prompt)


@query("SELECT unnest(['Answer', 'IndexingError', 'MapMeta', 'MapMissingError', 'NoModelError', 'ParserError', 'ProjectMap', 'QuarryError', 'QuarryMap', 'QueryError', 'Settings', 'StorageError', '__version__', 'load_json', 'load_tables', 'save_json', 'save_tables']) AS name, true AS found")
def package_exports(spark: SparkSession, d: str) -> DataFrame:
    """What the package offers."""
    import quarrymap

    return spark.createDataFrame([(n, getattr(quarrymap, n, None) is not None) for n in quarrymap.__all__], "name string, found boolean")


@query(f"SELECT k, 'x.' || k AS name, CASE k WHEN 'pdf' THEN {_quoted(binary_documents.NO_PDF)} WHEN 'docx' THEN {_quoted(binary_documents.NO_DOCX)} ELSE '' END AS preview, 0 AS headings FROM (SELECT unnest(['pdf', 'docx', 'doc']) AS k)")
def binary_notices(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose optional readers are not installed say so."""
    rows = spark.createDataFrame([(k, f"x.{k}", b"PK") for k in ("pdf", "docx", "doc")], "k string, name string, data binary")
    made = rows.select("k", "name", binary_documents.binary_structure("k", "data").alias("b"))
    return made.select("k", "name", F.col("b.content_preview").alias("preview"), F.size("b.headings").alias("headings"))
