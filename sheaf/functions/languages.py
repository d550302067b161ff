"""Programming language from a file extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.paths import extension

# fixed values: lower-case extension -> language
EXTENSIONS = {
    "go": "go",
    "java": "java",
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "html": "html",
    "css": "css",
    "cpp": "cpp",
    "cc": "cpp",
    "h": "cpp",
    "cs": "csharp",
    "php": "php",
    "rb": "ruby",
    "sh": "bash",
    "bash": "bash",
    "swift": "swift",
    "kt": "kotlin",
    "sql": "sql",
}
LANGUAGES = tuple(dict.fromkeys(EXTENSIONS.values()))


def detect_language(path: Column) -> Column:
    """Language of a path, null when the extension is not known."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(EXTENSIONS.items())])
    return F.try_element_at(table, F.lower(extension(path)))
