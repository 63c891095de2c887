"""Virtual files made of corpus tables, the same in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators import extract
from quarrymap.operators.numbering import made_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each document."""
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit("text").alias("file_type"), F.lit("document").alias("category"))


DOC_FILES = "(SELECT doc_id, 'docs/' || source || '/' || lang || '_' || doc_id || '.txt' AS path, text AS content, CAST(strlen(text) AS BIGINT) AS size_bytes, 'text' AS file_type, 'document' AS category FROM documents)"


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "page_id", F.col("html").alias("content"))


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, size_bytes): a tree of files, some in excluded places, from events."""
    kind, i = F.col("event_type"), F.col("event_id")
    folder = F.concat(F.when(i % 11 == 0, F.lit("node_modules/")).when(i % 13 == 0, F.lit("src/build/")).when(i % 17 == 0, F.lit("logs/")).otherwise(F.lit("src/")), kind, F.lit("/u"), (F.col("user_id") % 20).cast("string"), F.lit("/"))
    name = F.when(i % 97 == 0, F.lit("yarn.lock")).otherwise(F.concat(F.lit("f"), i.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".JS", ".bin", ".log", ".yaml", "")]), (i % 7 + 1).cast("int"))))
    size = F.floor(F.col("value") * 10000).cast("bigint")
    return table(spark, d, "events").select(F.concat(folder, name).alias("relative_path"), size.alias("size_bytes"))


TREE_PATHS = """(SELECT (CASE WHEN event_id % 11 = 0 THEN 'node_modules/' WHEN event_id % 13 = 0 THEN 'src/build/' WHEN event_id % 17 = 0 THEN 'logs/' ELSE 'src/' END) || event_type || '/u' || (user_id % 20) || '/'
  || (CASE WHEN event_id % 97 = 0 THEN 'yarn.lock' ELSE 'f' || event_id || (['.py', '.md', '.JS', '.bin', '.log', '.yaml', ''])[event_id % 7 + 1] END) AS relative_path,
  CAST(floor(value * 10000) AS BIGINT) AS size_bytes FROM events)"""


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content, category, file_type): a module for each order that imports and names its parts, and the parts with tests and a README that links to some."""
    parts = table(spark, d, "part")
    n = F.col("p_partkey").cast("string")
    line = F.struct(F.col("l_partkey").alias("k"), F.concat(F.lit("import parts.p"), F.col("l_partkey").cast("string")).alias("text"))
    quoted = F.concat(F.lit("data = 'parts/p"), F.min("l_partkey").cast("string"), F.lit("/index.js'\nmore = \"parts/p"), F.max("l_partkey").cast("string"), F.lit(".py\""))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set(line)), lambda x: x["text"]), "\n").alias("imports"), quoted.alias("quoted"))
    modules = orders.select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"), F.concat("imports", F.lit("\n"), "quoted").alias("content"), F.lit("code").alias("category"))
    own = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("parts/p"), n, F.lit(".py")).alias("path"))
    index = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("parts/p"), n, F.lit("/index.js")).alias("path"))
    tests = parts.where("p_partkey % 5 = 0").select(F.concat(F.lit("parts/test_p"), n, F.lit(".py")).alias("path"))
    few = spark.createDataFrame([("parts/README.md",), ("parts/__init__.py",)], "path string")
    rest = own.union(index).union(tests).union(few)
    readme = F.endswith("path", F.lit(".md"))
    rest = rest.select("path", F.when(readme, README).otherwise("").alias("content"), F.when(readme, "document").otherwise("code").alias("category"))
    kind = F.when(F.endswith("path", F.lit(".md")), "markdown").when(F.endswith("path", F.lit(".js")), "javascript").otherwise("python")
    return modules.unionByName(rest).withColumn("file_type", kind)


#: Links to known and unknown files and to a page.
README = "# Parts\n\nsee [two](./parts/p2.py), [none](parts/none.py), `parts/p3/index.js` and [web](https://x/parts/p4.py)"


SOURCE_FILES = """(SELECT 'orders/o' || l_orderkey || '.py' AS path,
  string_agg('import parts.p' || l_partkey, chr(10) ORDER BY l_partkey) || chr(10) || 'data = ''parts/p' || min(l_partkey) || '/index.js''' || chr(10) || 'more = "parts/p' || max(l_partkey) || '.py"' AS content, 'code' AS category
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey
  UNION ALL SELECT 'parts/p' || p_partkey || '.py', '', 'code' FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 'parts/p' || p_partkey || '/index.js', '', 'code' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'parts/test_p' || p_partkey || '.py', '', 'code' FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'parts/README.md', '# Parts', 'document' UNION ALL SELECT 'parts/__init__.py', '', 'code')"""


def analysed_sources(spark: SparkSession, d: str) -> DataFrame:
    """``source_files`` as the index analyses them, once: Python by its syntax tree, links by the document parsers."""
    files = extract.analysed(source_files(spark, d).withColumnRenamed("path", "relative_path")).withColumnRenamed("relative_path", "path")
    return made_once(files.select("path", "content", "category", "imports", "import_sources", "references"))


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash) of two generations: rows dropped from either, some texts changed."""
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    old = docs.where("doc_id % 11 <> 0").select(path, F.sha2("text", 256).alias("content_hash"))
    new = docs.where("doc_id % 7 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return old, new


SNAP_OLD = "(SELECT 'd/' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 11 <> 0)"
SNAP_NEW = "(SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 7 <> 0)"


def doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Map nodes of the documents: topics from their source and language, exports from their first words."""
    first = F.slice(F.split(F.col("content"), " "), 1, 12)
    return doc_files(spark, d).select("path", F.array(F.substring_index(F.substring_index("path", "/", 2), "/", -1), F.substring(F.substring_index("path", "/", -1), 1, 2)).alias("key_topics"), first.alias("exports"), F.col("doc_id").alias("node_ord"))


DOC_NODES = f"(SELECT path, [split_part(path, '/', 2), substring(split_part(path, '/', 3), 1, 2)] AS key_topics, list_slice(string_split(content, ' '), 1, 12) AS exports, doc_id AS node_ord FROM {DOC_FILES})"
