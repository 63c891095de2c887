"""Bounded context for an answer: texts cut to a budget and assembled in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.text import lines, strip, truncated

# The prompts' wording.
PRIMARY, CONNECTED = "--- PRIMARY TARGET FILES ---", "--- DIRECTLY CONNECTED FILES (For Additional Context) ---"
ANSWER_HEAD = "You are answering a question about a codebase or document repository.\nBelow is the relevant file context retrieved for the question.\n\n"
ANSWER_TAIL = (
    "\n\nPlease provide a detailed and accurate answer based ONLY on the provided context. If the context does not contain enough information to fully answer the question, say so. "
    "Cite the file names when you reference specific parts of the code/docs."
)
# What is said where there is nothing to say, or a model fails.
EMPTY_MAP = "Knowledge Map is empty."
NO_FILES = "I could not identify any relevant files in the project to answer this question."
NO_REASON = "No reasoning provided."
ANSWER_FAILED = "[LLM Error while generating answer: "
ROUTE_HEAD = "You are an intelligent code router for a retrieval system.\n"
ROUTE_MIDDLE = "Below is a list of candidate files from the project, with their summaries and key topics.\n\nFILES:\n"
ROUTE_TAIL = "Respond in EXACTLY the following format:\nFILES: file1.py, file2.js\nREASONING: I chose file1.py because..."


def cut_mark(limit: Column) -> Column:
    return F.concat(F.lit("\n\n[... File truncated due to context limits. Showing first "), limit.cast("string"), F.lit(" chars ...]"))


def cut_to(texts: DataFrame, limit: Column) -> DataFrame:
    """Contents cut to ``limit`` characters, with a notice."""
    return texts.withColumn("content", truncated(F.col("content"), limit, cut_mark(limit)))


def budgeted(texts: DataFrame, total_chars: int | None = None, each_chars: int | None = None) -> DataFrame:
    """(path, content, ...) with contents cut to ``each_chars``, or to an even share of ``total_chars``."""
    if each_chars:
        return cut_to(texts, F.lit(each_chars))
    share = texts.agg(F.floor(F.lit(total_chars) / F.greatest(F.lit(1), F.count("*"))).cast("int").alias("share_chars"))
    return cut_to(texts.withColumn("share_chars", share.scalar()), F.col("share_chars")).drop("share_chars")


def answer_prompt(question: Column, primary: Column, connected: Column) -> Column:
    """The prompt of two assembled contexts; an empty one of connected files has no heading."""
    beside = F.when(connected != "", F.concat(F.lit(f"\n{CONNECTED}\n"), connected)).otherwise(F.lit(""))
    return F.concat(F.lit(f"{ANSWER_HEAD}{PRIMARY}\n"), primary, beside, F.lit("\n\nQUESTION: "), question, F.lit(ANSWER_TAIL))


def route_prompt(question: Column, candidates_json: Column, n: int) -> Column:
    return F.concat(F.lit(f"{ROUTE_HEAD}A user has asked: '"), question, F.lit(f"'\n\n{ROUTE_MIDDLE}"), candidates_json, F.lit(f"\n\nSelect the {n} most relevant files that are likely to contain the answer.\n{ROUTE_TAIL}"))


def _said(reply: Column, label: str) -> Column:
    """What the lines that start with the label say, in order."""
    own = F.filter(F.transform(lines(strip(reply)), strip), lambda x: F.startswith(F.upper(x), F.lit(label)))
    return F.transform(own, lambda x: F.substring(x, F.lit(len(label) + 1), F.lit(1 << 30)))


def route_names(reply: Column) -> Column:
    """Names on all FILES: lines of a reply."""
    return F.flatten(F.transform(_said(reply, "FILES:"), lambda x: F.transform(F.split(F.regexp_replace(x, r'["\[\]]', ""), ",", -1), strip)))


def route_reason(reply: Column) -> Column:
    """The last REASONING: of a reply."""
    return F.coalesce(strip(F.try_element_at(_said(reply, "REASONING:"), F.lit(-1))), F.lit(NO_REASON))


def file_section(connected: bool = False) -> Column:
    """One file (path, content) as it stands in a prompt."""
    return F.concat(F.lit("### Connected File: " if connected else "### File: "), F.col("path"), F.lit("\n```\n"), F.col("content"), F.lit("\n```\n"))


def assembled(texts: DataFrame, connected: bool = False, by: list[str] | None = None) -> DataFrame:
    """A row (context) of a bounded set of (ord, path, content); with ``by`` one for each group."""
    rows = texts.groupBy(*(by or []))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", file_section(connected).alias("part")))), lambda x: x["part"]), "\n").alias("context"))
