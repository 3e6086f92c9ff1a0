"""Paths that an import may mean, in the order in which they are tried."""

from __future__ import annotations

import re

TS_SUFFIXES = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def _join(base: list[str], relative: str) -> list[str]:
    out = list(base)
    for part in relative.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return out


def _upwards(folder: list[str]) -> list[list[str]]:
    return [folder[:k] for k in range(len(folder), -1, -1)]


def _script(folder: list[str], module: str) -> list[str]:
    if not module.startswith(("./", "../")) and module not in (".", ".."):
        return []
    target = _join(folder, module)
    if not target:
        return [f"index.{s}" for s in TS_SUFFIXES]
    stem = re.sub(r"(?<=.)\.[^.]*$", "", target[-1])
    head = target[:-1]
    return ["/".join([*head, f"{stem}.{s}"]) for s in TS_SUFFIXES] + ["/".join([*target, f"index.{s}"]) for s in TS_SUFFIXES]


def _python(folder: list[str], module: str) -> list[str]:
    dots = len(module) - len(module.lstrip("."))
    rest = [p for p in module[dots:].split("/") if p]
    rest = [".".join(rest)] if dots else [p for p in module.split(".") if p]
    if dots:
        if not rest or not rest[0]:
            return ["/".join([*folder, "__init__.py"])]
        base = folder[: max(0, len(folder) - (dots - 1))]
        return ["/".join([*base, *rest]) + ".py", "/".join([*base, *rest, "__init__.py"])]
    out = []
    for base in _upwards(folder) if rest else []:
        out += ["/".join([*base, *rest]) + ".py", "/".join([*base, *rest, "__init__.py"])]
    return out


def _rust(folder: list[str], module: str) -> list[str]:
    parts = [p for p in module.split("::") if p]
    start = list(folder)
    if not parts:
        return []
    if parts[0] in ("crate", "self"):
        parts = parts[1:]
    elif parts[0] == "super":
        k = 0
        while parts and parts[0] == "super":
            parts, k = parts[1:], k + 1
        start = start[: max(0, len(start) - (k - 1))]
    elif len(parts) > 1:
        return []
    out = []
    for base in _upwards(start) if parts else []:
        out += ["/".join([*base, *parts]) + ".rs", "/".join([*base, *parts, "mod.rs"])]
    return out


def _go(folder: list[str], module: str) -> list[str]:
    parts = [p for p in module.split("/") if p]
    return ["/".join([*base, *parts[k:]]) for k in range(len(parts)) for base in _upwards(folder)]


OF = {"typescript": _script, "javascript": _script, "python": _python, "rust": _rust, "go": _go}


def candidates(path: str, language: str, module: str) -> list[str]:
    folder = path.split("/")[:-1]
    return OF[language](folder, module) if language in OF else []
