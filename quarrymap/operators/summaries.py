"""Summaries: prompts, batches, parsed replies and fallbacks as columns; the model is a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.paths import walk_key
from quarrymap.functions.text import empty_strings, first_n, lines, strip, truncated
from quarrymap.operators.numbering import numbered
from quarrymap.settings import Settings

# The prompts' wording.
SINGLE_HEAD = "Analyze the following file and provide:\n1. A concise 2-3 sentence summary of what this file does.\n2. A list of 5-10 key topics/keywords.\n\n"
SINGLE_TAIL = "\n\nRespond in EXACTLY this format:\nSUMMARY: <your summary here>\nTOPICS: <comma-separated list of topics>"
BATCH_TAIL = "\n\nFor EACH file, respond in this format:\nFILE <number>:\nSUMMARY: <2-3 sentence summary>\nTOPICS: <comma-separated keywords>\n"
PROJECT_HEAD = "Based on the following file summaries from a software project, write a concise 3-5 sentence summary describing what this project does, its main purpose, and key components.\n\nFile summaries:\n"
PROJECT_TAIL = "\n\nProject summary:"
NO_SUMMARY, NO_PROJECT_SUMMARY = "Summary not available.", "Project summary could not be generated."
PROMPT_CUT = "\n[... truncated ...]"
# Types whose title isn't their capitalised name.
TITLES = {"c_header": "C_Header", "cpp_header": "Cpp_Header"}


def prepared_content() -> Column:
    """The file's parts for a prompt, one a line, those that there are."""
    part = lambda label, items, n: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(first_n(F.col(items), n), ", ")))
    return F.concat_ws(
        "\n",
        F.when(F.col("docstring") != "", F.concat(F.lit("Docstring: "), F.substring("docstring", 1, 300))),
        part("Exports: ", "exports", 15),
        part("Imports: ", "imports", 10),
        part("Headings: ", "headings", 10),
        part("Sections: ", "key_sections", 10),
        F.when(F.col("content") != "", F.concat(F.lit("Content:\n"), truncated(F.col("content"), 3000, PROMPT_CUT))),
    )


def single_prompt() -> Column:
    return F.concat(
        F.lit(SINGLE_HEAD + "File: "), F.col("path"), F.lit("\nType: "), F.col("file_type"), F.lit(" ("), F.col("category"), F.lit(")\nLines: "),
        F.col("line_count").cast("string"), F.lit("\n"), prepared_content(), F.lit(SINGLE_TAIL),
    )


def title(kind: Column) -> Column:
    out = F.when(kind == "c_header", F.lit(TITLES["c_header"])).when(kind == "cpp_header", F.lit(TITLES["cpp_header"]))
    return out.otherwise(F.initcap(kind))


def fallback_summary() -> Column:
    return (
        F.when(F.col("docstring") != "", F.substring("docstring", 1, 300))
        .when(F.col("content_preview") != "", F.concat(F.lit("Document file containing: "), F.substring("content_preview", 1, 200)))
        .when(F.size("exports") > 0, F.concat(title(F.col("file_type")), F.lit(" file defining: "), F.array_join(first_n(F.col("exports"), 5), ", ")))
        .otherwise(F.concat(title(F.col("file_type")), F.lit(" file ("), F.col("line_count").cast("string"), F.lit(" lines).")))
    )


def fallback_topics() -> Column:
    return first_n(F.concat(F.array("file_type"), first_n(F.col("exports"), 5), first_n(F.col("headings"), 5)), 10)


def _last_said(reply: Column, label: str) -> Column:
    """What the last line that starts with the label says; null if none does."""
    own = F.filter(F.transform(lines(strip(reply)), strip), lambda x: F.startswith(F.upper(x), F.lit(label)))
    return strip(F.substring(F.try_element_at(own, F.lit(-1)), F.lit(len(label) + 1), F.lit(1 << 30)))


def topic_list(text: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(text, ",", -1), strip), lambda t: t != ""), empty_strings())


def parsed_reply(reply: Column) -> tuple[Column, Column]:
    """(summary, topics) of a reply about one file; a reply without a summary line is its own summary."""
    said = F.coalesce(_last_said(reply, "SUMMARY:"), F.lit(""))
    return F.when(said != "", said).otherwise(F.substring(strip(reply), 1, 500)), topic_list(_last_said(reply, "TOPICS:"))


def parsed_batch_reply(reply: str, count: int) -> list[tuple[str, list[str]]]:
    """(summary, topics) of each of ``count`` files; entries without a summary are skipped, missing ones padded."""
    entries: list[tuple[str, list[str]]] = []
    summary, topics = "", []
    for line in [*map(str.strip, reply.strip().split("\n")), "FILE end:"]:
        head, colon, rest = line.partition(":")
        label = head.upper()
        if label.startswith("FILE") and colon:
            entries += [(summary, topics)] if summary else []
            summary, topics = "", []
        elif label == "SUMMARY" and colon:
            summary = rest.strip()
        elif label == "TOPICS" and colon:
            topics = [t for t in map(str.strip, rest.split(",")) if t]
    return (entries + [(NO_SUMMARY, [])] * count)[:count]


def batch_entries(reply: Column | str, count: Column | str) -> Column:
    """(summary, topics) of each file of a reply about several."""

    @F.pandas_udf("array<struct<summary: string, topics: array<string>>>")
    def entries(reply: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"summary": s, "topics": t} for s, t in parsed_batch_reply(r, n)] for r, n in zip(reply, count)])

    return entries(reply, count)


def batched(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``batch`` and ``slot``: small files by fives in walk order; large files alone, before them (batch null).

    Small files are numbered in two passes over their paths only; the numbers are
    joined back, so texts are not moved through it.
    """
    small = (F.col("size_bytes") <= settings.small_file_bytes) & F.lit(settings.batch_small_files)
    places = numbered(files.where(small).select("path"), [walk_key(F.col("path"))], "n").select(F.col("path").alias("small_path"), F.floor(F.col("n") / settings.batch_files).cast("bigint").alias("batch"), (F.col("n") % settings.batch_files).cast("int").alias("slot"))
    return files.join(places, F.col("path") == F.col("small_path"), "left").drop("small_path")


def batch_prompts(files: DataFrame) -> DataFrame:
    """(batch, n, paths, prompt) of batched files; a batch of one gets the single prompt. At most a batch's files are gathered."""
    section = F.concat(F.lit("\n--- FILE "), (F.col("slot") + 1).cast("string"), F.lit(": "), F.col("path"), F.lit(" ---\nType: "), F.col("file_type"), F.lit("\n"), prepared_content(), F.lit("\n"))
    rows = files.where("batch IS NOT NULL").select("batch", F.struct("slot", "path", section.alias("section"), single_prompt().alias("single")).alias("file"))
    groups = rows.groupBy("batch").agg(F.sort_array(F.collect_list("file")).alias("files")).withColumn("n", F.size("files"))
    many = F.concat(F.lit("Analyze the following "), F.col("n").cast("string"), F.lit(" files and provide a summary and key topics for EACH file.\n"), F.array_join("files.section", ""), F.lit(BATCH_TAIL))
    return groups.select("batch", "n", F.col("files.path").alias("paths"), F.when(F.col("n") == 1, F.get("files.single", F.lit(0))).otherwise(many).alias("prompt"))


def replies(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Adds ``reply`` and ``error`` (one of them null): the model's answer to each prompt, in Arrow batches.

    The model isn't deterministic: write the result before it is used twice.
    """
    names = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said: list[tuple[str | None, str | None]] = []
            for prompt in rows["prompt"]:
                try:
                    said.append((str(model(prompt)), None))
                except Exception as e:  # the model is the user's: what it raises is data
                    said.append((None, str(e)))
            rows["reply"], rows["error"] = ([x[i] for x in said] for i in (0, 1))
            yield rows[[*names, "reply", "error"]]

    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", reply string, error string")


def summarised(files: DataFrame, model: Callable[[str], str], settings: Settings = Settings()) -> DataFrame:
    """``files`` (analysed, with path) with summary, key_topics and insert_ord (large files first, then small ones)."""
    dealt = batched(files, settings)
    summary, topics = parsed_reply(F.col("reply"))
    alone = replies(dealt.where("batch IS NULL").select("path", single_prompt().alias("prompt")), model)
    alone = alone.select(F.col("path").alias("s_path"), F.when(F.col("reply").isNotNull(), summary).alias("summary"), F.when(F.col("reply").isNotNull(), topics).alias("key_topics"))

    groups = replies(batch_prompts(dealt), model)
    one = F.array(F.struct(summary.alias("summary"), topics.alias("topics")))
    told = groups.withColumn("entries", F.when(F.col("n") == 1, F.when(F.col("reply").isNotNull(), one)).otherwise(batch_entries("reply", "n")))
    each = told.select("entries", F.posexplode("paths").alias("slot", "s_path")).select("s_path", F.get("entries", F.col("slot")).alias("entry"))
    together = each.select("s_path", F.col("entry.summary").alias("summary"), F.col("entry.topics").alias("key_topics"))
    out = dealt.join(alone.union(together), F.col("path") == F.col("s_path"), "left").drop("s_path")
    return (
        out.withColumn("key_topics", F.when(F.col("summary").isNull(), fallback_topics()).otherwise(F.col("key_topics")))
        .withColumn("summary", F.coalesce("summary", fallback_summary()))
        .withColumn("insert_ord", F.struct(F.col("batch").isNotNull().alias("small"), walk_key(F.col("path")).alias("walk")))
        .drop("batch", "slot")
    )


def project_prompt(nodes: DataFrame, n: int = 50) -> DataFrame:
    """One row (prompt) from the first ``n`` nodes in map order."""
    first = nodes.orderBy("node_ord").limit(n)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_ord", F.concat(F.lit("- "), F.col("path"), F.lit(": "), F.col("summary")).alias("line")))), lambda x: x["line"]), "\n")
    return first.agg(F.concat(F.lit(PROJECT_HEAD), said, F.lit(PROJECT_TAIL)).alias("prompt"))
