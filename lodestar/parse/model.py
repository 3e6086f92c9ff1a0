"""The rows that extractors give."""

from __future__ import annotations

from dataclasses import dataclass, field

SYMBOL = "struct<kind:string,name:string,visibility:string,signature:string,docstring:string,line_start:int,line_end:int,parent:string,parents:array<struct<name:string,kind:string>>,members:array<string>,derives:array<string>,body_stripped:boolean>"
IMPORT = "struct<module:string,names:array<string>,line:int>"
CALL = "struct<callee:string,qualifier:string,line:int,enclosing:string>"
COLUMNS = f"symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>, skeleton string, status string"


@dataclass
class Symbol:
    kind: str
    name: str
    visibility: str = "private"
    signature: str = ""
    docstring: str | None = None
    line_start: int = 1
    line_end: int = 1
    parent: str | None = None
    parents: list[dict] = field(default_factory=list)
    members: list[str] = field(default_factory=list)
    derives: list[str] = field(default_factory=list)
    body_stripped: bool = False

    @property
    def is_stripped(self) -> bool:
        """Functions, structs and classes alone have a body that can be taken out."""
        return self.body_stripped and self.kind in ("function", "struct", "class")

    def row(self) -> dict:
        return self.__dict__.copy()


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    skeleton: str = ""
    status: str = "ok"


def splice(text: str, spans: list[tuple[int, int]], by: str) -> str:
    """text with each of the spans, merged where they overlap or touch, replaced."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])
