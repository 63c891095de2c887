"""A small project end to end, with a stub model."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymap import cli
from quarrymap.operators import context
from quarrymap.plans.engine import QuarryMap
from quarrymap.settings import IndexingError, MapMissingError, NoModelError, Settings, StorageError

FILES = {
    "src/main.py": '"""Starts it."""\nimport util\nimport src.auth\n\ndef run(self, a, b, c, d):\n    pass\n',
    "src/auth.py": "import util\nTOKEN = 1\nclass Login: pass\n",
    "util.py": "async def helper(x): pass\n",
    "tests/test_util.py": "import util\n",
    "src/README.md": "# Title\n\nsee [auth](./src/auth.py) and `src/main.py`\n",
    "src/__init__.py": "X = 1\n",
    ".git/config": "core\n",
    "_priv/p.py": "y = 'util.py'\n",
    ".github/w.yml": "on: push\n",
    "build/gone.py": "z = 1\n",
    "logs/a.log.py": "a = 1\n",
    ".env": "A=1\n",
    "empty.py": "",
    ".gitignore": "# note\nlogs/\n",
}


@pytest.fixture()
def tree(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_walk_skips_excluded_and_keeps_hidden(spark, tree):
    engine = QuarryMap(cli.stub_model, spark=spark)
    found = {r["relative_path"] for r in engine.files(str(tree)).collect()}
    assert found == {"src/main.py", "src/auth.py", "util.py", "tests/test_util.py", "src/README.md", "src/__init__.py", "_priv/p.py", ".github/w.yml"}


def test_index_then_ask(spark, tree):
    engine = QuarryMap(cli.stub_model, spark=spark)
    made = engine.index(str(tree))
    assert made.meta.total_files == 8
    kinds = {(e["source"], e["target"], e["relation_type"]) for e in made.edges.collect()}
    assert {("src/main.py", "util.py", "imports"), ("src/main.py", "src/auth.py", "imports"), ("tests/test_util.py", "util.py", "tests"), ("src/README.md", "src/__init__.py", "documents"), ("_priv/p.py", "util.py", "references"), ("src/README.md", "src/auth.py", "references")} <= kinds
    nodes = {r["path"]: r for r in made.nodes.collect()}
    assert nodes["src/main.py"]["exports"] == ["def run(a, b, c, ...)"]
    assert nodes["src/auth.py"]["exports"] == ["class Login", "TOKEN"] or nodes["src/auth.py"]["exports"] == ["TOKEN", "class Login"]
    assert nodes["util.py"]["summary"] == "Summary not available." or nodes["util.py"]["summary"] == "Summarised by the stub model."
    answer = engine.ask("How does main start?")
    assert answer.sources == ["src/main.py"]
    assert answer.connections == ["src/auth.py", "src/README.md", "util.py"] or set(answer.connections) == {"src/auth.py", "src/README.md", "util.py"}
    assert answer.reasoning == "The stub model always chooses main.py."
    document = json.loads((tree / Settings().map_file).read_text())
    assert document["total_files"] == 8 and document["directory_tree"]["src"]["main.py"] is None
    # nothing changed: nothing is asked again
    asked = []
    again = QuarryMap(lambda p: asked.append(p) or "SUMMARY: x", spark=spark)
    again.index(str(tree))
    assert not asked
    # a change and a deletion
    (tree / "util.py").write_text("def other(): pass\n")
    (tree / "src/auth.py").unlink()
    third = again.index(str(tree))
    paths = {r["path"]: r for r in third.nodes.collect()}
    assert "src/auth.py" not in paths and paths["util.py"]["exports"] == ["def other()"]


def test_binary_documents(spark, tmp_path):
    from quarrymap.functions import binary_documents

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 \xff")
    (tmp_path / "b.docx").write_bytes(b"PK")
    (tmp_path / "c.doc").write_bytes(b"x")
    engine = QuarryMap(cli.stub_model, spark=spark)
    rows = {r["path"]: r for r in engine.analysed(engine.files(str(tmp_path))).collect()}
    assert rows["a.pdf"]["content_preview"] in (binary_documents.NO_PDF, binary_documents.BAD_PDF)
    assert rows["b.docx"]["content_preview"] in (binary_documents.NO_DOCX, binary_documents.BAD_DOCX)
    assert all(r["line_count"] == 0 and r["content"] == "" and r["headings"] == [] for r in rows.values())


def test_errors(spark, tmp_path):
    with pytest.raises(NoModelError):
        QuarryMap("no", spark=spark)
    engine = QuarryMap(cli.stub_model, spark=spark)
    with pytest.raises(IndexingError):
        engine.index(str(tmp_path / "none"))
    with pytest.raises(MapMissingError):
        engine.ask("?")
    assert engine.get_map(str(tmp_path)) is None
    (tmp_path / Settings().map_file).write_text("{")
    with pytest.raises(StorageError):
        engine.get_map(str(tmp_path))


def test_cli(spark, tree, capsys):
    engine = QuarryMap(cli.stub_model, spark=spark)
    assert cli.main([], engine) == 1
    assert cli.main(["index", str(tree), "--full"], engine) == 0
    assert "8 files" in capsys.readouterr().out
    assert cli.main(["map", "--project", str(tree), "--stats"], engine) == 0
    assert cli.main(["map", "--project", str(tree / "src")], QuarryMap(cli.stub_model, spark=spark)) == 1
    assert cli.main(["index", str(tree / "none")], engine) == 1


def test_route_names(spark):
    replies = ['x\nFILES: ["a.py", b.py]\nfiles: c.py\nREASONING: one\nreasoning: two', "nothing", "FILES:", None]
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(context.route_names(F.col("r")).alias("n"), context.route_reason(F.col("r")).alias("w")).collect()
    assert [tuple(r) for r in got] == [(["a.py", "b.py", "c.py"], "two"), ([], context.NO_REASON), ([""], context.NO_REASON), (None, context.NO_REASON)]


def test_many_questions(spark, tree):
    def model(prompt):
        if "intelligent code router" in prompt:
            if "fails" in prompt:
                raise RuntimeError("no")
            return "FILES: util.py, nowhere.zz\nREASONING: named" if "the helper" in prompt else "FILES: nowhere.zz"
        return f"{prompt.count('### File: ')} {prompt.count('### Connected File: ')} {prompt.rpartition('QUESTION: ')[2][:6]}"

    engine = QuarryMap(cli.stub_model, spark=spark)
    engine.index(str(tree))
    engine.model = model
    asked = [(1, "Where is the helper?"), (2, "It fails"), (3, "Other words")]
    got = {r["question_id"]: r for r in engine.ask_many(spark.createDataFrame(asked, "question_id int, question string")).collect()}
    for i, question in asked:
        one = engine.ask(question)
        assert (got[i]["text"], got[i]["sources"], got[i]["connections"], got[i]["reasoning"]) == (one.text, one.sources, one.connections, one.reasoning), question
    assert got[1]["sources"] == ["util.py"] and got[1]["text"].startswith("1 ") and got[1]["reasoning"] == "named"
    assert len(got[2]["sources"]) == 3 and "(no)" in got[2]["reasoning"] and got[3]["text"] == context.NO_FILES


def test_listing_prunes_and_splits(spark, tmp_path):
    from quarrymap.sources import project

    for i in range(12):
        (tmp_path / "one" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "one" / f"d{i}" / "e" / "f.py").write_text("x" * (i + 1))
    (tmp_path / "one" / "g.py").write_text("y")
    (tmp_path / "h.py").write_text("z")
    reader = project.ListingReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 12 and sorted(r[1] for p in parts for r in reader.read(p)) == sorted(["h.py", "one/g.py", *[f"one/d{i}/e/f.py" for i in range(12)]])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = project.listing(spark, str(tmp_path)).where("size_bytes >= 3 AND size_bytes < 5")
        assert sorted(r["relative_path"] for r in few.collect()) == ["one/d2/e/f.py", "one/d3/e/f.py"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    small = project.listing(spark, str(tmp_path), Settings(max_file_bytes=1))
    assert sorted(r["relative_path"] for r in small.collect()) == ["h.py", "one/d0/e/f.py", "one/g.py"]


def test_listing_needs_no_python_beside_the_driver(spark, tree):
    from quarrymap.sources import project

    own = project.listing(spark, str(tree), patterns=["logs/"])
    assert "Scan" not in own._jdf.queryExecution().toString()  # a Python source is planned by processes of the driver
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        source = project.listing(spark, str(tree), patterns=["logs/"])
        assert "Scan" in source._jdf.queryExecution().toString() and source.schema == own.schema
        assert sorted(own.collect()) == sorted(source.collect()) != []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_listing_of_more_files_than_a_batch(spark, tmp_path, monkeypatch):
    from quarrymap.sources import project

    for i in range(7):
        (tmp_path / f"f{i}.py").write_text("x")
    monkeypatch.setattr(project, "LISTED", 3)
    assert sorted(r["relative_path"] for r in project.listing(spark, str(tmp_path)).collect()) == [f"f{i}.py" for i in range(7)]


def test_index_plans_hold_the_analysis_once(spark, tree, monkeypatch):
    held = []
    edges_of = QuarryMap.edges_of
    monkeypatch.setattr(QuarryMap, "edges_of", staticmethod(lambda found: held.append(found) or edges_of(found)))
    QuarryMap(cli.stub_model, spark=spark).index(str(tree))
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "InMemory" not in plan


def test_package_exports():
    import quarrymap

    assert all(getattr(quarrymap, n) is not None for n in quarrymap.__all__) and quarrymap.QuarryMap is QuarryMap
    with pytest.raises(AttributeError):
        quarrymap.nothing
