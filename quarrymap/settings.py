"""Settings and the fixed values that decide what is indexed and how."""

from __future__ import annotations

from dataclasses import dataclass, field

# Extension -> type of code files.
CODE_TYPES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c_header", ".hpp": "cpp_header",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r",
    ".lua": "lua", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".sql": "sql",
    ".html": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".vue": "vue", ".svelte": "svelte",
    ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml", ".pl": "perl", ".pm": "perl",
}

# Extension -> type of documents.
DOCUMENT_TYPES = {
    ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".rst": "restructuredtext", ".adoc": "asciidoc",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".csv": "csv",
    ".xml": "xml", ".env": "env", ".properties": "properties", ".pdf": "pdf", ".docx": "docx", ".doc": "doc",
}

# Directories that are not entered (whole names).
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs", "*.egg-info", ".next", ".nuxt", ".output", "coverage",
    ".coverage", ".idea", ".vscode", ".DS_Store", "vendor", "target", "bin", "obj",
)

#: The name of the exported map.
MAP_FILE = ".quarrymap.json"

# Files that are left out (whole names).
EXCLUDED_FILES = (
    MAP_FILE, ".DS_Store", "Thumbs.db", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
    "Pipfile.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock",
)


@dataclass(frozen=True)
class Settings:
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    excluded_files: tuple[str, ...] = EXCLUDED_FILES
    #: Glob patterns for base names.
    excluded_globs: tuple[str, ...] = ()
    use_ignore_file: bool = True
    max_file_bytes: int = 1_000_000
    #: Characters of a text that are analysed.
    max_text_chars: int = 500_000
    code_types: dict[str, str] = field(default_factory=lambda: dict(CODE_TYPES))
    document_types: dict[str, str] = field(default_factory=lambda: dict(DOCUMENT_TYPES))
    batch_small_files: bool = True
    small_file_bytes: int = 2_000
    batch_files: int = 5
    routed_files: int = 3
    context_chars: int = 100_000
    with_connections: bool = True
    map_file: str = MAP_FILE
    #: Candidates shown to the router; maps of at most ``small_map`` files are shown whole.
    candidates: int = 20
    small_map: int = 15
    connected_chars: int = 4_000
    project_files: int = 50


class QuarryError(Exception):
    """Base of this library's errors."""


class IndexingError(QuarryError):
    """A project can't be indexed."""


class QueryError(QuarryError):
    """A question can't be answered."""


class NoModelError(QuarryError):
    """The language model isn't a callable."""


class MapMissingError(QuarryError):
    """There is no map to ask."""


class ParserError(QuarryError):
    """A file can't be parsed."""


class StorageError(QuarryError):
    """A map can't be written or read."""
