"""Run settings. Plain frozen values, checked before any plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

FORMATS = ("xml", "json", "yaml")


@dataclass(frozen=True)
class CleanOptions:
    """What the cleaning step removes."""

    remove_comments: bool = True
    preserve_doc_comments: bool = True
    remove_imports: bool = False
    remove_logging: bool = True
    remove_accessors: bool = True
    optimize_whitespace: bool = True
    remove_empty_lines: bool = True
    # extra statement prefixes treated as logging, per language
    logging_prefixes: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class PackOptions:
    """Everything one packing run needs. Sizes are strings such as ``10MB``."""

    include: str = "*.go,*.json,*.yaml,*.yml"
    exclude: str = ""
    max_file_size: str = "10MB"
    max_output_size: str = "50MB"
    roots: Sequence[str] = (".",)
    output_path: str | None = None
    work_dir: str = ""
    anchor: str = "relative"
    clean: CleanOptions | None = None
    enforce_budget: bool = True
    # the corpus holds one row per path, as one file scan does: no shuffle to drop duplicates
    unique_paths: bool = False
    # of equal texts keep the one with the smallest path
    distinct_content: bool = False
    # column of the corpus with the path a row links to, null for files: one row of each file stays
    link_target: str | None = None

    def __post_init__(self) -> None:
        if not self.include:
            raise ValueError("an include pattern is needed")
        if not self.roots:
            raise ValueError("at least one root is needed")
        if self.anchor not in ("relative", "absolute"):
            raise ValueError("anchor must be 'relative' or 'absolute'")
        output_format(self.output_path)


def output_format(output_path: str | None) -> str:
    """Bundle format from an output file name; XML when there is none."""
    if not output_path:
        return "xml"
    name = output_path.rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    known = {"xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml"}
    if suffix not in known:
        raise ValueError(f"output {name!r} has no known format: xml, json, yaml or yml")
    return known[suffix]
