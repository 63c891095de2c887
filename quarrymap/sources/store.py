"""The map on disk: nodes and edges as Parquet for Spark, one JSON document for exchange."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarrymap.settings import MAP_FILE, StorageError

NODES = "path string, file_type string, category string, size_bytes bigint, summary string, key_topics array<string>, exports array<string>, imports array<string>, last_indexed string, content_hash string, line_count bigint, node_ord bigint"
EDGES = "source string, target string, relation_type string, details string, emit_ord bigint"
_NODE_DEFAULTS = {"key_topics": [], "exports": [], "imports": [], "last_indexed": "", "content_hash": "", "line_count": 0}
_NODE_REQUIRED = ("path", "file_type", "category", "size_bytes", "summary")


@dataclass
class MapMeta:
    root_path: str
    project_summary: str = ""
    created_at: str = ""
    updated_at: str = ""
    version: str = "0.1.0"
    total_files: int = 0
    directory_tree: dict = field(default_factory=dict)


@dataclass
class ProjectMap:
    meta: MapMeta
    nodes: DataFrame
    edges: DataFrame


def nested_tree(entries: list[tuple[str, str, bool]]) -> dict:
    """(parent, name, is_dir) as nested dictionaries; files are None."""
    root: dict = {}
    below = {"": root}
    for parent, name, is_dir in sorted(entries, key=lambda e: (e[0].split("/") if e[0] else [], e[1])):
        path = f"{parent}/{name}" if parent else name
        below[parent][name] = {} if is_dir else None
        if is_dir:
            below[path] = below[parent][name]
    return root


def save_json(project: ProjectMap, root: str, name: str = MAP_FILE) -> str:
    """Write the exchange document; it gets its name when it is whole."""
    nodes = {r["path"]: {k: v for k, v in r.asDict(True).items() if k != "node_ord"} for r in project.nodes.orderBy("node_ord").toLocalIterator()}
    edges = [{k: v for k, v in r.asDict().items() if k != "emit_ord"} for r in project.edges.orderBy("emit_ord").toLocalIterator()]
    m = project.meta
    document = {
        "map_version": m.version, "root_path": m.root_path, "project_summary": m.project_summary, "created_at": m.created_at, "updated_at": m.updated_at,
        "total_files": m.total_files, "directory_tree": m.directory_tree, "nodes": nodes, "relationships": edges,
    }
    target = os.path.join(root, name)
    try:
        with tempfile.NamedTemporaryFile("w", dir=root, delete=False, suffix=".part") as f:
            json.dump(document, f, indent=2)
        os.replace(f.name, target)
    except OSError as e:
        raise StorageError(f"can't write {target}: {e}") from e
    return target


def load_json(spark: SparkSession, root: str, name: str = MAP_FILE) -> ProjectMap | None:
    """The map of a project; None without one, an error if it can't be read as one."""
    path = os.path.join(root, name)
    if not os.path.exists(path):
        return None
    try:
        with open(path) as f:
            d = json.load(f)
        meta = MapMeta(d["root_path"], d.get("project_summary", ""), d.get("created_at", ""), d.get("updated_at", ""), d.get("map_version", "0.1.0"), d.get("total_files", 0), d.get("directory_tree", {}))
        nodes = [tuple([n[k] for k in _NODE_REQUIRED[:5]] + [n.get(k, v) for k, v in _NODE_DEFAULTS.items()] + [i]) for i, n in enumerate(d.get("nodes", {}).values())]
        edges = [(e["source"], e["target"], e["relation_type"], e.get("details", ""), i) for i, e in enumerate(d.get("relationships", []))]
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        raise StorageError(f"can't read {path}: {e}") from e
    return ProjectMap(meta, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def save_tables(project: ProjectMap, folder: str) -> None:
    """Nodes and edges as Parquet, for maps that are tables rather than documents."""
    project.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    project.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges")
