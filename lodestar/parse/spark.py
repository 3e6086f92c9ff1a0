"""The parse step over a table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from lodestar.parse import braces, fallback, python_
from lodestar.parse.model import COLUMNS, Parsed

EXTRACTORS: dict[str, Callable[[str], Parsed]] = {"python": python_.extract, "rust": braces.rust, "typescript": braces.typescript, "go": braces.go}


def register_extractor(language: str, extract: Callable[[str], Parsed]) -> None:
    EXTRACTORS[language] = extract


def parse_one(language: str, source: str, extractors: dict[str, Callable[[str], Parsed]] | None = None) -> Parsed:
    """By the language's extractor; by patterns where there is none, or where it fails."""
    known = EXTRACTORS if extractors is None else extractors
    if language in known:
        try:
            return known[language](source)
        except (SyntaxError, ValueError, RecursionError):
            return fallback.extract(source)
    out = fallback.extract(source)
    if language == "javascript" and "typescript" in known:  # no symbols, but a skeleton
        out.skeleton = known["typescript"](source).skeleton
    return out


def parse(files: DataFrame) -> DataFrame:
    """files (path, language, source, ...) with symbols, imports, calls, skeleton and status; one narrow pass."""
    extractors = dict(EXTRACTORS)
    schema = StructType([*files.schema.fields, *_parse_datatype_string(COLUMNS).fields])

    def run(batches):
        for pdf in batches:
            got = [parse_one(lang, src or "", extractors) for lang, src in zip(pdf["language"], pdf["source"], strict=True)]
            yield pdf.assign(symbols=[[s.row() for s in g.symbols] for g in got], imports=[g.imports for g in got], calls=[g.calls for g in got], skeleton=[g.skeleton for g in got], status=[g.status for g in got])

    return files.mapInPandas(run, schema)


__all__ = ["EXTRACTORS", "parse", "parse_one", "register_extractor"]
