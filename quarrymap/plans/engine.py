"""The façade: index a project, ask it, look at its map."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions.binary_documents import binary_structure
from quarrymap.functions.paths import walk_key
from quarrymap.operators import context, diff, edges, extract, graph, summaries, walk
from quarrymap.operators.numbering import made_once, numbered
from quarrymap.plans import asking
from quarrymap.settings import IndexingError, MapMissingError, NoModelError, Settings
from quarrymap.sources import project, store
from quarrymap.sources.store import NODES, MapMeta, ProjectMap


_NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


@dataclass
class Answer:
    text: str
    sources: list[str] = field(default_factory=list)
    connections: list[str] = field(default_factory=list)
    reasoning: str = ""
    confidence: float = 0.0


class QuarryMap:
    """Structural index and retrieval over project trees; ``model`` maps a prompt to a reply."""

    def __init__(self, model: Callable[[str], str], settings: Settings = Settings(), spark: SparkSession | None = None):
        if not callable(model):
            raise NoModelError("model must be a callable from prompt to reply")
        self.model, self.settings = model, settings
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.map: ProjectMap | None = None

    def __repr__(self) -> str:
        return f"QuarryMap({'indexed ' + str(self.map.meta.total_files) + ' files' if self.map else 'not indexed'}, version={MapMeta('').version!r})"

    # --- index --------------------------------------------------------------

    def files(self, root: str) -> DataFrame:
        """The indexable files of a tree."""
        patterns = project.ignore_patterns(root) if self.settings.use_ignore_file else []
        return walk.indexable(project.listing(self.spark, root, self.settings, patterns), patterns, self.settings)

    def analysed(self, files: DataFrame) -> DataFrame:
        """Indexable files with content and structure; PDF and DOCX by the optional readers."""
        kind = F.col("file_type")
        binary = kind.isin("pdf", "docx")
        read = project.with_bytes(files).withColumn("content", extract.decoded(F.coalesce(F.col("data"), F.lit("").cast("binary"))))
        read = read.withColumn("binary", F.when(binary, binary_structure(kind, F.when(binary, F.col("data"))))).drop("data")
        found = extract.analysed(read, self.settings)
        for c in ("headings", "content_preview"):
            found = found.withColumn(c, F.coalesce(F.col(f"binary.{c}"), F.col(c)))
        return found.drop("binary").withColumnRenamed("relative_path", "path")

    def index(self, path: str, incremental: bool = True) -> ProjectMap:
        """Build or update the map of a project and store it beside the project."""
        root = os.path.realpath(path)
        if not os.path.isdir(root):
            raise IndexingError(f"not a directory: {path}")
        old = store.load_json(self.spark, root, self.settings.map_file) if incremental else None
        if old is not None and old.meta.root_path != root:
            old = None
        now = datetime.now(timezone.utc).isoformat()
        meta = old.meta if old else MapMeta(root, created_at=now)
        meta.updated_at = now

        # written, not cached: each later plan would hold all of the analysis once more for every use of it
        found = made_once(self.analysed(self.files(root)))
        meta.total_files = found.count()
        tree = walk.tree_entries(found.select(F.col("path").alias("relative_path"))).select("parent", "name", "is_dir").collect()
        meta.directory_tree = store.nested_tree([tuple(r) for r in tree])
        fresh = diff.to_process(old.nodes, found) if old else found
        made = made_once(self._nodes(fresh, now))  # the model isn't asked twice
        nodes = self._merged(old.nodes, found, made) if old else made
        changed, gone = made.count(), diff.deleted(old.nodes, found).count() if old else 0
        links = made_once(self.edges_of(found) if changed or gone or old is None else old.edges)
        if not meta.project_summary or changed / max(1, meta.total_files) > 0.1:
            meta.project_summary = self._project_summary(nodes)
        self.map = ProjectMap(meta, nodes, links)
        store.save_json(self.map, root, self.settings.map_file)
        return self.map

    def _nodes(self, fresh: DataFrame, now: str) -> DataFrame:
        told = made_once(summaries.summarised(fresh, self.model, self.settings)).withColumn("last_indexed", F.lit(now))
        return numbered(told, [F.col("insert_ord")], "node_ord").select(*_NODE_COLUMNS)

    @staticmethod
    def _merged(before: DataFrame, found: DataFrame, made: DataFrame) -> DataFrame:
        """The nodes of the files there are: a changed file keeps its place, a new one goes to the end."""
        kept = before.join(found.select(F.col("path").alias("here")), F.col("path") == F.col("here"), "left_semi")
        place = before.select(F.col("path").alias("old_path"), F.col("node_ord").alias("old_ord"))
        placed = made.join(place, F.col("path") == F.col("old_path"), "left")
        rows = kept.join(made.select(F.col("path").alias("made_path")), F.col("path") == F.col("made_path"), "left_anti").withColumn("order", F.struct(F.lit(0).alias("a"), F.col("node_ord").alias("b")))
        rows = rows.unionByName(placed.withColumn("order", F.struct(F.when(F.col("old_ord").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("a"), F.coalesce("old_ord", "node_ord").alias("b"))).drop("old_path", "old_ord"))
        return made_once(numbered(rows.drop("node_ord"), [F.col("order")], "node_ord").select(*_NODE_COLUMNS))

    @staticmethod
    def edges_of(found: DataFrame) -> DataFrame:
        """All edges in the order of their files and kinds."""
        made = edges.all_edges(found)
        kind = F.array_position(F.array(*[F.lit(k) for k in edges.KINDS]), F.col("relation_type"))
        return numbered(made, [walk_key(F.col("source")), kind, F.col("pos"), F.col("target")], "emit_ord").select("source", "target", "relation_type", "details", "emit_ord")

    def _project_summary(self, nodes: DataFrame) -> str:
        try:
            return self.model(summaries.project_prompt(nodes, self.settings.project_files).collect()[0]["prompt"]).strip()
        except Exception:  # the model's failure isn't the index's
            return summaries.NO_PROJECT_SUMMARY

    # --- ask ----------------------------------------------------------------

    def get_map(self, project_path: str | None = None) -> ProjectMap | None:
        if self.map is None and project_path is not None:
            return store.load_json(self.spark, os.path.realpath(project_path), self.settings.map_file)
        return self.map

    def route(self, question: str, project_map: ProjectMap) -> tuple[list[str], str]:
        """The files that answer best, as the model picks them from the candidates, and why."""
        if project_map.nodes.isEmpty():
            return [], context.EMPTY_MAP
        asked = self.spark.createDataFrame([(0, question)], "question_id int, question string")
        prompt = asking.route_prompts(asked, project_map.nodes, self.settings).collect()[0]
        try:
            said = (self.model(prompt["prompt"]), None)
        except Exception as e:
            said = (None, str(e))
        reply = self.spark.createDataFrame([(0, prompt["paths"], *said)], "question_id int, paths array<string>, reply string, error string")
        chosen = asking.routed(reply, project_map.nodes, self.settings).orderBy("ord").collect()
        why = reply.select(context.route_reason(F.col("reply")).alias("why")).collect()[0]["why"]
        return [r["path"] for r in chosen], chosen[0]["reasoning"] if chosen else why

    def ask(self, question: str, project_path: str | None = None) -> Answer:
        """One question; the model runs on the driver."""
        known = self.get_map(project_path)
        if known is None:
            raise MapMissingError("no map: index the project first, or name its path")
        chosen, reason = self.route(question, known)
        if not chosen:
            return Answer(context.NO_FILES, reasoning=reason)
        targets = self.spark.createDataFrame([(p,) for p in chosen], "path string")
        near = [r["path"] for r in graph.connected(known.edges, targets).orderBy("path").collect()] if self.settings.with_connections else []
        texts = lambda paths: self.spark.createDataFrame([(i, p, project.read_now(known.meta.root_path, p)) for i, p in enumerate(paths)], "ord int, path string, content string")
        primary = context.assembled(context.budgeted(texts(chosen), total_chars=self.settings.context_chars)).withColumnRenamed("context", "primary")
        beside = context.assembled(context.budgeted(texts(near), each_chars=self.settings.connected_chars), connected=True)
        prompt = context.answer_prompt(F.lit(question), F.col("primary"), F.col("beside"))
        shown = primary.withColumn("beside", beside.scalar()).select(prompt.alias("prompt")).collect()[0]["prompt"]
        try:
            text = self.model(shown)
        except Exception as e:
            text = f"{context.ANSWER_FAILED}{e}]"
        return Answer(text, chosen, near, reason)

    def ask_many(self, questions: DataFrame, project_path: str | None = None) -> DataFrame:
        """(question_id, text, sources, connections, reasoning, confidence) of (question_id, question); the model runs where the rows lie."""
        known = self.get_map(project_path)
        if known is None:
            raise MapMissingError("no map: index the project first, or name its path")
        root = known.meta.root_path
        return asking.answers(questions, known.nodes, known.edges, lambda paths: project.texts_now(paths, root), self.model, self.settings)
