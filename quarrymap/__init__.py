"""Structural analysis and retrieval over file and document corpora, on Spark."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

#: Where the exported names live; they are imported when first asked for, so that workers load only what they run.
_PLACES = {
    "QuarryMap": "plans.engine", "Answer": "plans.engine",
    "ProjectMap": "sources.store", "MapMeta": "sources.store", "save_json": "sources.store", "load_json": "sources.store", "save_tables": "sources.store", "load_tables": "sources.store",
    "Settings": "settings", "QuarryError": "settings", "IndexingError": "settings", "QueryError": "settings", "NoModelError": "settings", "MapMissingError": "settings", "ParserError": "settings", "StorageError": "settings",
}
__all__ = [*_PLACES, "__version__"]


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_PLACES])
