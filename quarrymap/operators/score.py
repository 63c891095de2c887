"""Keyword relevance of files to a question, and deterministic top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions.text import strip, strip_chars

# Points for a word in the path, in a topic, in an export; and for files of these names.
PATH_POINTS, TOPIC_POINTS, EXPORT_POINTS, ENTRY_POINTS = 5, 3, 2, 1
ENTRY_NAMES = ("main", "index", "__init__")
#: Names that are broadcast at most.
FEW_NAMES = 1000


def question_words(question: Column) -> Column:
    """Distinct lower-case words of more than three characters (counted before punctuation goes)."""
    words = F.filter(F.split(strip(question), r"(?U)\s+"), lambda w: F.char_length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: strip_chars(F.lower(w), "?,.!")))


def _hits(texts: Column, words: Column) -> Column:
    """(text, word) pairs in which the text has the word."""
    of_text = lambda t: F.size(F.filter(words, lambda w: F.contains(F.lower(t), w)))
    return F.aggregate(F.transform(texts, of_text), F.lit(0), lambda n, x: n + x)


def relevance(words: Column, path: Column, topics: Column, exports: Column) -> Column:
    """Row-local, so scoring is one pass without a shuffle."""
    low = F.lower(path)
    entry = F.when(F.contains(low, F.lit(ENTRY_NAMES[0])) | F.contains(low, F.lit(ENTRY_NAMES[1])) | F.contains(low, F.lit(ENTRY_NAMES[2])), F.lit(ENTRY_POINTS)).otherwise(F.lit(0))
    in_path = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return (PATH_POINTS * in_path + TOPIC_POINTS * _hits(topics, words) + EXPORT_POINTS * _hits(exports, words) + entry).cast("int")


def scored(nodes: DataFrame, question: Column) -> DataFrame:
    """Nodes (path, key_topics, exports, ...) with ``score``."""
    return nodes.withColumn("score", relevance(question_words(question), F.col("path"), F.col("key_topics"), F.col("exports")))


def best(nodes: DataFrame, question: Column, n: int = 20) -> DataFrame:
    """The ``n`` best by score; ties keep the map's order (node_ord). Each task keeps n rows."""
    return scored(nodes, question).orderBy(F.col("score").desc(), "node_ord").limit(n)


#: Questions that are scored against all nodes in one pass.
QUESTIONS = 256


def best_for_all(questions: DataFrame, nodes: DataFrame, n: int = 20) -> DataFrame:
    """(question_id, rank, score and the nodes' columns): the ``n`` best nodes for each question (question_id, question).

    Questions go to the nodes in blocks of ``QUESTIONS``: a node is read once a
    block and scored for each of its questions, and every task keeps ``n`` rows a question.
    """
    spark = questions.sparkSession
    asked = questions.select("question_id", "question").orderBy("question_id").toLocalIterator()
    out, block, names = None, [], nodes.columns
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "node_ord")

    def scored_block() -> DataFrame:
        few = spark.createDataFrame(block, questions.select("question_id", "question").schema)
        all_of = few.agg(F.collect_list(F.struct("question_id", question_words(F.col("question")).alias("words"))).alias("asked")).collect()[0]["asked"]
        kind = few.schema["question_id"].dataType
        each = F.array(*[F.struct(F.lit(q["question_id"]).cast(kind).alias("question_id"), F.array(*[F.lit(w) for w in q["words"]]).cast("array<string>").alias("words")) for q in all_of])
        rows = nodes.select(*names, F.explode(each).alias("q"))
        points = relevance(F.col("q.words"), F.col("path"), F.col("key_topics"), F.col("exports"))
        rows = rows.select(F.col("q.question_id").alias("question_id"), points.alias("score"), *names)
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    for q in asked:
        block.append(q)
        if len(block) == QUESTIONS:
            own, block = scored_block(), []
            out = own if out is None else out.unionByName(own)
    if block or out is None:
        own = scored_block() if block else nodes.withColumns({"question_id": F.lit(None).cast(questions.schema["question_id"].dataType), "score": F.lit(0), "rank": F.lit(1)}).where("false")
        out = own if out is None else out.unionByName(own)
    return out


def fuzzy_paths(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, path): a known name as it is, else the first path in map order that contains it or is contained in it.

    ``names`` is usually the router's short list for a question; it is broadcast
    only if a count shows that it is short, and met in blocks of both sides if not.
    """
    few = names.select("name").distinct()
    if few.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        few = F.broadcast(few)
    either = F.contains(F.col("path"), F.col("name")) | F.contains(F.col("name"), F.col("path"))
    order = F.struct((F.col("path") != F.col("name")).alias("inexact"), "node_ord")
    return nodes.select("path", "node_ord").join(few, either).groupBy("name").agg(F.min_by("path", order).alias("path"))
