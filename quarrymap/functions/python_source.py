"""Imports, exports and docstring of Python sources: the one parser that needs a syntax tree.

An Arrow-batched pandas UDF; all other languages are native expressions.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_LIST = ArrayType(StringType())
RESULT = StructType([StructField("imports", _LIST), StructField("import_sources", _LIST), StructField("exports", _LIST), StructField("docstring", StringType())])

# What is looked for where a source has no syntax tree.
IMPORT_LINE = r"^(?:from\s+(\S+)\s+)?import\s+(.+)$"
DEF_LINE = r"^(?:async\s+)?def\s+(\w+)\s*\("
CLASS_LINE = r"^class\s+(\w+)"


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    names = [a.arg for a in node.args.args if a.arg not in ("self", "cls")]
    shown = names[:3] + ["..."] * (len(names) > 3)
    return ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"def {node.name}({', '.join(shown)})"


def _top_level(body: list[ast.stmt]) -> list[str]:
    out = []
    for node in body:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                out.append(_signature(node))
            case ast.ClassDef():
                out.append(f"class {node.name}")
            case ast.Assign():
                out += [t.id for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
    return out


def _by_lines(text: str) -> dict:
    imports, sources = [], []
    for module, names in re.findall(IMPORT_LINE, text, re.M):
        imports.append(f"from {module} import {names}" if module else f"import {names}")
        sources.append(module or names.partition(",")[0].strip())
    exports = [f"def {n}()" for n in re.findall(DEF_LINE, text, re.M)] + [f"class {n}" for n in re.findall(CLASS_LINE, text, re.M)]
    return {"imports": imports, "import_sources": sources, "exports": exports, "docstring": ""}


def parse(text: str) -> dict:
    """What one source imports (at any depth, outer levels first), exports at top level, and its docstring."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError:
        return _by_lines(text)
    except (ValueError, RecursionError, MemoryError):
        return {"imports": [], "import_sources": [], "exports": [], "docstring": ""}
    imports, sources, level = [], [], deque([tree])
    while level:
        node = level.popleft()
        if isinstance(node, ast.Import):
            imports += [f"import {a.name}" for a in node.names]
            sources += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(f"from {node.module or ''} import {', '.join(a.name for a in node.names)}")
            sources += [node.module] if node.module else []
        level.extend(ast.iter_child_nodes(node))
    return {"imports": imports, "import_sources": sources, "exports": _top_level(tree.body), "docstring": ast.get_docstring(tree) or ""}


@F.pandas_udf(RESULT)
def python_structure(texts: pd.Series) -> pd.DataFrame:
    """A struct for each source; null texts give empty ones."""
    return pd.DataFrame([parse(t) if t is not None else parse("") for t in texts], columns=["imports", "import_sources", "exports", "docstring"])
