"""Declarations by patterns, for languages without an extractor. All symbols are private."""

from __future__ import annotations

import re

from lodestar.parse.model import Parsed, Symbol

_PUB, _EXPORT = r"(?:pub\s+)?", r"(?:export\s+)?"
PATTERNS = [
    (kind, re.compile(r"^\s*" + p + r"(\w+)", re.M))
    for kind, p in (
        ("function", _PUB + r"fn\s+"),
        ("function", _PUB + r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?"),
        ("function", r"def\s+"),
        ("function", _EXPORT + r"(?:async\s+)?function\s+"),
        ("struct", _PUB + r"struct\s+"),
        ("enum", _PUB + r"enum\s+"),
        ("interface", _PUB + r"trait\s+"),
        ("class", _EXPORT + r"(?:abstract\s+)?class\s+"),
        ("interface", _EXPORT + r"interface\s+"),
        ("type alias", _PUB + r"type\s+"),
        ("type alias", _EXPORT + r"type\s+"),
        ("module", _PUB + r"mod\s+"),
    )
]


def extract(source: str) -> Parsed:
    """The first of each (kind, name), in the order of lines; a match's line is where its blank lines begin."""
    seen: set[tuple[str, str]] = set()
    found = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(source):
            if (kind, m.group(1)) not in seen:
                seen.add((kind, m.group(1)))
                line = source.count("\n", 0, m.start()) + 1
                found.append(Symbol(kind, m.group(1), line_start=line, line_end=line))
    return Parsed(sorted(found, key=lambda s: s.line_start), skeleton=source, status="fallback")
