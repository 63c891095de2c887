"""Structure of file texts: line counts, hashes, imports, exports, headings, references.

Rules are data (fixed patterns per type); they become native column
expressions, so a scan stays in the JVM for every type but Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.python_source import python_structure
from quarrymap.functions.text import empty_strings, first_n, found, is_upper, lines, lstrip_chars, prefixed, strip, strip_chars, truncated
from quarrymap.settings import Settings

#: Marks a text that was cut before analysis.
CUT_MARK = "\n\n[... file truncated due to size ...]"


@dataclass(frozen=True)
class Rule:
    """Each match of ``pattern`` adds ``before`` + group to a field."""

    field: str
    pattern: str
    before: str = ""
    group: int = 1
    lines: bool = False


# Patterns of each code type, in the order their matches are listed.
CODE_RULES: dict[str, list[Rule]] = {
    "javascript": [
        Rule("imports", r"""import\s+(?:\{[^}]+\}|\w+|\*\s+as\s+\w+)\s+from\s+['"]([^'"]+)['"]""", group=0),
        Rule("import_sources", r"""import\s+(?:\{[^}]+\}|\w+|\*\s+as\s+\w+)\s+from\s+['"]([^'"]+)['"]"""),
        Rule("import_sources", r"""(?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
        Rule("exports", r"export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)", "function "),
        Rule("exports", r"export\s+(?:default\s+)?class\s+(\w+)", "class "),
        Rule("exports", r"export\s+(?:const|let|var)\s+(\w+)"),
        Rule("more_exports", r"^(?:async\s+)?function\s+(\w+)", "function ", lines=True),
    ],
    "java": [
        Rule("imports", r"import\s+([\w.]+);", "import "),
        Rule("import_sources", r"import\s+([\w.]+);"),
        Rule("exports", r"(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+)", "class "),
        Rule("exports", r"(?:public\s+)?interface\s+(\w+)", "interface "),
        Rule("exports", r"public\s+(?:static\s+)?(?:\w+)\s+(\w+)\s*\(", "method "),
    ],
    "go": [
        Rule("import_sources", r'import\s+"([^"]+)"'),
        Rule("import_blocks", r"import\s+\(([\s\S]*?)\)"),
        Rule("exports", r"func\s+(?:\([^)]+\)\s+)?([A-Z]\w+)\s*\(", "func "),
        Rule("exports", r"type\s+([A-Z]\w+)\s+(?:struct|interface)", "type "),
    ],
    "c": [
        Rule("imports", r'#include\s+[<"]([^>"]+)[>"]', "#include "),
        Rule("import_sources", r'#include\s+[<"]([^>"]+)[>"]'),
        Rule("exports", r"class\s+(\w+)", "class "),
        Rule("exports", r"(?:typedef\s+)?struct\s+(\w+)", "struct "),
    ],
    "rust": [
        Rule("imports", r"use\s+([\w:]+(?:::\{[^}]+\})?);", "use "),
        Rule("import_sources", r"use\s+([\w:]+(?:::\{[^}]+\})?);"),
        Rule("exports", r"pub\s+(?:async\s+)?fn\s+(\w+)", "fn "),
        Rule("exports", r"pub\s+struct\s+(\w+)", "struct "),
        Rule("exports", r"pub\s+enum\s+(\w+)", "enum "),
        Rule("exports", r"pub\s+trait\s+(\w+)", "trait "),
    ],
    "ruby": [
        Rule("import_sources", r"""require(?:_relative)?\s+['"]([^'"]+)['"]"""),
        Rule("exports", r"class\s+(\w+(?:::\w+)*)", "class "),
        Rule("exports", r"module\s+(\w+(?:::\w+)*)", "module "),
        Rule("exports", r"def\s+(?:self\.)?(\w+[?!]?)", "def "),
    ],
    "php": [
        Rule("import_sources", r"""(?:use|require|require_once|include)\s+['"]?([^;'"]+)"""),
        Rule("exports", r"class\s+(\w+)", "class "),
        Rule("exports", r"function\s+(\w+)\s*\(", "function "),
    ],
    "shell": [
        Rule("import_sources", r"""(?:source|\.)\s+['"]?([^'"\s;]+)"""),
        Rule("exports", r"(?:function\s+)?(\w+)\s*\(\s*\)\s*\{", "function "),
    ],
    "other": [
        Rule("imports", r"^(?:import|require|include|use)\s+(.+)$", group=0, lines=True),
        Rule("exports", r"^(?:def|func|function|fn|sub)\s+(\w+)", "function ", lines=True),
        Rule("exports", r"^(?:class|struct|type|interface)\s+(\w+)", "class ", lines=True),
    ],
}
#: Types that share another's rules; types that are in neither are "other".
SAME_RULES = {"typescript": "javascript", "cpp": "c", "c_header": "c", "cpp_header": "c"}

# Patterns of the document types.
HEADING = r"^(#{1,6})\s+(.+)$"
LINK_TARGET = r"\[([^\]]+)\]\(([^)]+)\)"
CODE_TOKEN = r"`([^`]*(?:\.\w+))`"
DIRECTIVE = r"\.\.\s+(\w+)::"
YAML_KEY = r"^(\w[\w-]*):"
SECTION = r"^\[([^\]]+)\]"
XML_TAG = r"<(\w+)[\s>]"
ENV_NAME = r"^([A-Z_][A-Z0-9_]*)="
UNDERLINE = r"^[=\-~^]{3,}$"

FIELDS = ("imports", "import_sources", "exports", "headings", "references", "key_sections")


def _of_rules(content: Column, rules: list[Rule], field: str) -> Column:
    made = [prefixed(found(content, r.pattern, r.group, r.lines), r.before) for r in rules if r.field == field]
    return F.concat(*made) if len(made) > 1 else made[0] if made else empty_strings()


def code_structure(content: Column, kind: str) -> dict[str, Column]:
    """The fields of a code type other than Python."""
    rules = CODE_RULES[kind]
    out = {f: _of_rules(content, rules, f) for f in ("imports", "import_sources", "exports")}
    if kind == "javascript":  # functions at the start of a line, if no export names them yet
        out["exports"] = F.concat(out["exports"], F.array_distinct(F.array_except(_of_rules(content, rules, "more_exports"), out["exports"])))
    if kind == "go":
        block_lines = F.flatten(F.transform(_of_rules(content, rules, "import_blocks"), lambda b: F.transform(lines(strip(b)), lambda x: strip_chars(strip(x), '"'))))
        out["import_sources"] = F.concat(out["import_sources"], F.filter(block_lines, lambda x: x != ""))
    if kind == "other":
        out["imports"] = F.transform(out["imports"], strip)
    return out


def document_structure(content: Column, kind: str) -> dict[str, Column]:
    """The fields of a document type; types without a parser of their own are read as text."""
    if kind == "markdown":
        marks, titles = found(content, HEADING, 1, True), found(content, HEADING, 2, True)
        headings = F.zip_with(marks, titles, lambda m, t: F.concat(m, F.lit(" "), strip(t)))
        tokens = F.filter(found(content, CODE_TOKEN), lambda x: F.contains(x, F.lit(".")) & F.contains(x, F.lit("/")))
        sections = F.filter(headings, lambda h: F.startswith(h, F.lit("# ")) | F.startswith(h, F.lit("## ")))
        return {"headings": headings, "references": F.concat(found(content, LINK_TARGET, 2), tokens), "key_sections": F.transform(sections, lambda h: lstrip_chars(h, "# "))}
    if kind == "restructuredtext":
        pairs = _with_next(lines(content))
        under = F.filter(pairs, lambda p: p["next"].isNotNull() & p["next"].rlike(UNDERLINE))
        return {"headings": F.transform(under, lambda p: p["line"]), "key_sections": prefixed(found(content, DIRECTIVE), "directive: ")}
    if kind == "yaml":
        keys = found(content, YAML_KEY, 1, True)
        return {"headings": keys, "key_sections": first_n(keys, 20)}
    if kind == "json":
        keys = first_n(F.array_distinct(F.coalesce(F.json_object_keys(content), empty_strings())), 30)
        return {"headings": keys, "key_sections": first_n(keys, 20)}
    if kind == "toml":
        names = found(content, SECTION, 1, True)
        headings = prefixed(names, "[", "]")
        return {"headings": headings, "key_sections": F.transform(headings, lambda h: strip_chars(h, "[]"))}
    if kind == "ini":
        names = found(content, SECTION, 1, True)
        return {"headings": names, "key_sections": names}
    if kind == "csv":
        cells = F.split(strip(F.get(lines(content), F.lit(0))), ",", -1)
        shape = F.concat(F.size(lines(content)).cast("string"), F.lit(" rows, "), F.size(cells).cast("string"), F.lit(" columns"))
        return {"headings": F.transform(cells, lambda c: strip_chars(strip(c), '"')), "key_sections": F.array(shape)}
    if kind == "xml":
        return {"headings": first_n(F.array_distinct(F.filter(found(content, XML_TAG), lambda t: t != "xml")), 20)}
    if kind == "env":
        names = found(content, ENV_NAME, 1, True)
        return {"headings": names, "key_sections": names}
    return {"headings": text_headings(content)}


def _with_next(all_lines: Column, most: int | None = None) -> Column:
    """(line, next line), both stripped; null after the last."""
    own = first_n(all_lines, most) if most else all_lines
    return F.transform(own, lambda x, i: F.struct(strip(x).alias("line"), strip(F.get(all_lines, i + 1)).alias("next")))


def text_headings(content: Column) -> Column:
    """Of the first 100 lines those in capitals, and those that are underlined with ===."""
    pairs = _with_next(lines(content), 100)
    chosen = F.filter(pairs, lambda p: (is_upper(p["line"]) & (F.char_length(p["line"]) > 3)) | F.coalesce(F.startswith(p["next"], F.lit("===")), F.lit(False)))
    return F.transform(chosen, lambda p: p["line"])


#: Documents that are not text: their content is empty.
BINARY_TYPES = ("pdf", "docx", "doc")


def decoded(data: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else Latin-1; \\r\\n and \\r become \\n."""
    text = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def _by_kind(kind: Column, made: dict[str, Column], default: Column) -> Column:
    out = None
    for k, c in made.items():
        out = F.when(kind == k, c) if out is None else out.when(kind == k, c)
    return default if out is None else out.otherwise(default)


def analysed(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(relative_path, file_type, category, content, ...) -> with hash, line count and structure.

    ``content`` is the decoded text; null is empty. Arrays are never null.
    """
    content = F.when(F.col("file_type").isin(*BINARY_TYPES), F.lit("")).otherwise(F.coalesce(truncated(F.col("content"), settings.max_text_chars, CUT_MARK), F.lit("")))
    rows = files.withColumn("content", content)
    c, category, kind = F.col("content"), F.col("category"), F.col("file_type")
    is_python = (category == "code") & (kind == "python")
    code_kinds = [k for k in CODE_RULES if k != "other"]
    rules = F.when(kind.isin(*code_kinds), kind).when(kind.isin(*SAME_RULES), F.element_at(F.create_map(*[F.lit(x) for kv in SAME_RULES.items() for x in kv]), kind)).otherwise(F.lit("other"))
    rows = rows.withColumn("rules", F.when(category == "code", rules).otherwise(kind)).withColumn("python", F.when(is_python, python_structure(F.when(is_python, c))))
    code = {k: code_structure(c, k) for k in CODE_RULES}
    documents = {k: document_structure(c, k) for k in ("markdown", "restructuredtext", "yaml", "json", "toml", "ini", "csv", "xml", "env", "text")}
    none = empty_strings()
    is_code = category == "code"
    out = {}
    for f in FIELDS:
        from_code = _by_kind(F.col("rules"), {k: v[f] for k, v in code.items() if f in v}, none)
        if f in ("imports", "import_sources", "exports"):
            from_code = F.when(is_python, F.col(f"python.{f}")).otherwise(from_code)
        own = {k: v[f] for k, v in documents.items() if f in v}
        plain = own.pop("text", none)
        # binary documents have no text to read headings from
        from_document = _by_kind(kind, own | {k: none for k in BINARY_TYPES}, plain)
        out[f] = F.coalesce(F.when(is_code, from_code).otherwise(from_document), none)
    return (
        rows.withColumns(out)
        .withColumn("docstring", F.coalesce(F.when(is_python, F.col("python.docstring")), F.lit("")))
        .withColumn("content_preview", F.when(category == "document", F.substring(c, 1, 500)).otherwise(F.lit("")))
        .withColumn("content_hash", F.sha2(c, 256))
        .withColumn("line_count", F.when(c == "", F.lit(0)).otherwise(F.size(lines(c))).cast("bigint"))
        .drop("rules", "python")
    )
