"""Operators against values worked out by hand."""

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from quarrymap.functions.python_source import parse
from quarrymap.functions.text import glob, strip
from quarrymap.operators import context, diff, edges, extract, score, summaries, walk
from quarrymap.plans import queries


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("pattern", ["*.py", "a?c", "[ab]*", "[!a]x", "[", "x[", "logs*", "a.b", "[^a]", "*"])
def test_glob_is_fnmatch(pattern):
    for name in ("a.py", "abc", "logs/a.py", "bx", "ax", "[", "x[", "a.b", "aXb", "^x", "\n"):
        assert bool(re.match(glob(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_relevance_prefers_the_topic(spark):
    nodes = spark.createDataFrame([("main.py", ["entry", "app"], [], 0), ("auth.py", ["auth", "login"], [], 1)], "path string, key_topics array<string>, exports array<string>, node_ord bigint")
    got = [(r["path"], r["score"]) for r in score.best(nodes, F.lit("How does login auth work?"), 20).collect()]
    assert got == [("auth.py", 11), ("main.py", 1)]


def test_words_and_strip(spark):
    assert one(spark, score.question_words(F.col("q")), q="Is?? ???? What's THIS, this.") == ["is", "", "what's", "this"]
    assert one(spark, strip(F.col("q")), q=" \t x y \r\n") == "x y"


def test_text_and_rst_headings(spark):
    text = "ALL CAPS\nABC\nTitle\n=====\nlower\n\n===\nEND"
    assert one(spark, extract.text_headings(F.col("c")), c=text) == ["ALL CAPS", "Title", ""]
    rst = extract.document_structure(F.col("c"), "restructuredtext")
    assert one(spark, rst["headings"], c="Top\n===\nx\n--\ny\n~~~") == ["Top", "y"]
    assert one(spark, rst["key_sections"], c=".. note:: x") == ["directive: note"]


def test_decoding(spark):
    rows = spark.createDataFrame([(b"a\r\nb\rc",), ("é".encode("latin-1"),), ("é".encode(),)], "b binary").select(extract.decoded(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["a\nb\nc", "é", "é"]


def test_python_source():
    got = parse("'''Doc.'''\nimport a, b.c\nfrom . import d\nfrom .e import f\ndef g(self, x): \n  import deep\nif 1:\n  def hidden(): pass\nUP = low = 1\n")
    assert got["imports"] == ["import a", "import b.c", "from  import d", "from e import f", "import deep"]
    assert got["import_sources"] == ["a", "b.c", "e", "deep"]
    assert got["exports"] == ["def g(x)", "UP"] and got["docstring"] == "Doc."
    broken = parse("import a, b\nfrom .m import x\ndef f(:\nclass C\n")
    assert broken["import_sources"] == ["a", ".m"] and broken["exports"] == ["def f()", "class C"]
    assert parse("\0")["imports"] == []


def test_import_resolution(spark):
    files = [("a.py",), ("a/index.js",), ("pkg/sub/x.py",), ("pkg/y.py",), ("lib.rb",), ("cmd/main.go",), ("inc/h.h",)]
    paths = spark.createDataFrame(files, "path string")
    rows = spark.createDataFrame([("pkg/sub/x.py", "code", "", ["import a"], ["a", "..y", ".x", "lib", "cmd", "inc/h.h", "./y", "no"], [])], "path string, category string, content string, imports array<string>, import_sources array<string>, references array<string>")
    got = {(r["pos"], r["target"], r["details"]) for r in edges.import_edges(rows, paths).collect()}
    assert got == {(0, "a.py", "import a"), (1, "pkg/y.py", "imports from ..y"), (3, "lib.rb", "imports from lib"), (4, "cmd/main.go", "imports from cmd"), (5, "inc/h.h", "imports from inc/h.h")}


def test_edges_first_wins_and_no_self(spark):
    schema = "path string, category string, content string, imports array<string>, import_sources array<string>, references array<string>"
    rows = spark.createDataFrame([("docs/a.md", "document", "'b.py' \"docs\\\\a.md\"", [], [], ["./b.py", "https://x/b.py", "docs/a.md"]), ("b.py", "code", "", [], [], []), ("src/t/b.test.ts", "code", "", [], [], []), ("src/b.ts", "code", "", [], [], [])], schema)
    got = {(r["source"], r["target"], r["relation_type"], r["details"]) for r in edges.all_edges(rows).collect()}
    assert got == {("docs/a.md", "b.py", "references", "references b.py"), ("src/t/b.test.ts", "src/b.ts", "tests", "test file for src/b.ts")}


def test_ignore_dialect(spark):
    files = spark.createDataFrame([(p, 5) for p in ("logs/a.py", "b/logs.py", "x/build.md", "deep/er/k.py", "top.py")], "relative_path string, size_bytes bigint")
    kept = lambda *p: {r["relative_path"] for r in walk.indexable(files, list(p)).collect()}
    assert "logs/a.py" in kept("logs") and "logs/a.py" not in kept("logs*") and "logs/a.py" not in kept("logs/")
    assert "top.py" not in kept("/top.py") and "deep/er/k.py" not in kept("er/") and "x/build.md" in kept("/build")


def test_size_limits_and_types(spark):
    files = spark.createDataFrame([("a.py", 0), ("b.py", 1), ("c.py", 1_000_000), ("d.py", 1_000_001), ("x.env", 3), (".env", 3), ("Makefile", 3), ("E.R", 3), ("yarn.lock", 3)], "relative_path string, size_bytes bigint")
    got = {r["relative_path"]: r["file_type"] for r in walk.indexable(files).collect()}
    assert got == {"b.py": "python", "c.py": "python", "x.env": "env", "E.R": "r"}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    status = diff.compared(old, new)
    assert {(r["path"], r["status"]) for r in status.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert diff.change_ratio(status).collect()[0]["ratio"] == pytest.approx(2 / 3)


def test_batch_replies():
    said = summaries.parsed_batch_reply("FILE 1:\nSUMMARY: a\nTOPICS: x, ,y\nFILE 2:\nTOPICS: lost\nFILE 3:\nsummary: c", 3)
    assert said == [("a", ["x", "y"]), ("c", []), ("Summary not available.", [])]
    assert summaries.parsed_batch_reply("", 1) == [("Summary not available.", [])]


def test_model_failure_falls_back(spark):
    files = spark.createDataFrame([("a.py", "python", "code", "", ["def f()"], [], [], [], "", "x = 1", 10, 1)], "path string, file_type string, category string, docstring string, exports array<string>, imports array<string>, headings array<string>, key_sections array<string>, content_preview string, content string, size_bytes bigint, line_count bigint")

    def broken(prompt):
        raise RuntimeError("no")

    row = summaries.summarised(files, broken).collect()[0]
    assert row["summary"] == "Python file defining: def f()" and row["key_topics"] == ["python", "def f()"]


def test_prompts(spark):
    shown = lambda beside: spark.range(1).select(context.answer_prompt(F.lit("q"), F.lit("### File: a\n```\nx\n```\n"), F.lit(beside)).alias("p")).collect()[0]["p"]
    assert shown("").count("###") == 1 and context.CONNECTED not in shown("") and shown("").startswith(context.ANSWER_HEAD)
    assert f"```\n\n{context.CONNECTED}\n### Connected File: b" in shown("### Connected File: b") and shown("").endswith("QUESTION: q" + context.ANSWER_TAIL)


def test_numbers_are_global(spark):
    from quarrymap.operators.numbering import numbered

    rows = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "k int, v string").repartition(5)
    assert sorted((r["k"], r["n"]) for r in numbered(rows, [F.col("k")], "n").collect()) == [(i, i) for i in range(100)]
    assert numbered(rows.where("false"), [F.col("k")], "n").count() == 0
    same = numbered(rows, [F.lit(1)], "n").collect()
    assert sorted(r["n"] for r in same) == list(range(100))


def test_many_questions_score_as_one(spark):
    nodes = spark.createDataFrame([(f"p{i}/{w}.py", [w], ["x"], i) for i, w in enumerate(["auth", "main", "login", "index", "auth"] * 9)], "path string, key_topics array<string>, exports array<string>, node_ord bigint")
    asked = [(i, q) for i, q in enumerate(["How does login work", "where is auth", "zzzz", "", "the index of auth and login?"])]
    got = score.best_for_all(spark.createDataFrame(asked, "question_id int, question string"), nodes, 4).collect()
    for i, q in asked:
        want = [(r["path"], r["score"]) for r in score.best(nodes, F.lit(q), 4).collect()]
        assert [(r["path"], r["score"]) for r in sorted((r for r in got if r["question_id"] == i), key=lambda r: r["rank"])] == want
    assert score.best_for_all(spark.createDataFrame([], "question_id int, question string"), nodes).count() == 0


def test_edges_of_targets_are_those_of_all(spark):
    files = queries.V.analysed_sources(spark, "/root/testdata/sf0.001")
    targets = spark.createDataFrame([("parts/p3/index.js",), ("orders/o5.py",), ("parts/README.md",)], "path string")
    key = lambda rows: sorted((r["source"], r["target"], r["relation_type"], r["details"]) for r in rows)
    ends = {r["path"] for r in targets.collect()}
    whole = [r for r in edges.all_edges(files).collect() if r["source"] in ends or r["target"] in ends]
    assert key(edges.all_edges(files, targets=targets).collect()) == key(whole) and whole


def test_plans_stay_native(spark):
    files = queries.V.source_files(spark, "/root/testdata/sf0.001").withColumns({"imports": F.array(F.lit("import a")), "import_sources": F.array(F.lit("a")), "references": F.array(F.lit("b"))})
    plan = edges.all_edges(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_streaming_index(spark, tmp_path):
    from quarrymap.streaming.incremental import keep_indexed

    schema = "path string, content string, file_type string, category string, size_bytes bigint, version bigint"
    spark.createDataFrame([("a.txt", "x", "text", "document", 1, 1), ("a.txt", "y", "text", "document", 1, 2)], schema).write.parquet(str(tmp_path / "in"))
    keep_indexed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "generation=0")).collect()
    assert [(r["path"], r["version"]) for r in got] == [("a.txt", 2)]


def test_fuzzy_paths_takes_all_names(spark):
    from quarrymap.operators import score

    nodes = spark.createDataFrame([(f"src/f{i:04}.py", i) for i in range(1500)], "path string, node_ord long")
    names = spark.createDataFrame([(f"f{i:04}.py",) for i in range(1500)], "name string")
    got = {(r["name"], r["path"]) for r in score.fuzzy_paths(names, nodes).collect()}
    assert got == {(f"f{i:04}.py", f"src/f{i:04}.py") for i in range(1500)}
