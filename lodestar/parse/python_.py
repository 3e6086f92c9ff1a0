"""Python by the standard library's parser."""

from __future__ import annotations

import ast

from lodestar.parse.model import Parsed, Symbol, splice


def _visibility(name: str) -> str:
    return "private" if name.startswith("_") else "public"


def _params(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Plain parameters, and annotated ones; those that have but a default drop out."""
    a = node.args
    places = [*a.posonlyargs, *a.args]
    bare_default = len(places) - len(a.defaults)
    out = []
    for k, p in enumerate(places):
        if p.annotation is not None:
            out.append(f"{p.arg}: {ast.unparse(p.annotation)}")
        elif k < bare_default:
            out.append(p.arg)
    return out


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Symbol:
    return Symbol("function", node.name, _visibility(node.name), f"def {node.name}({', '.join(_params(node))})", ast.get_docstring(node, clean=False), node.lineno, node.end_lineno or node.lineno)


def _class(node: ast.ClassDef) -> Symbol:
    bases = ", ".join(b.id for b in node.bases if isinstance(b, ast.Name))
    parents = [{"name": bases, "kind": "extends"}] if bases else []  # several are one name, which no symbol has
    members = [n.name for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    return Symbol("class", node.name, _visibility(node.name), f"class {node.name}", ast.get_docstring(node, clean=False), node.lineno, node.end_lineno or node.lineno, parents=parents, members=members)


def extract(source: str) -> Parsed:
    tree = ast.parse(source)
    out = Parsed()
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    def top(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.symbols.append(_function(n))
            elif isinstance(n, ast.ClassDef):
                out.symbols.append(_class(n))
            else:
                for part in ("body", "orelse", "finalbody"):
                    top([x for x in getattr(n, part, []) if isinstance(x, ast.stmt)])
                for h in getattr(n, "handlers", []):
                    top(h.body)

    spans: list[tuple[int, int]] = []

    def walk(node: ast.AST, inside: str | None) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            spans.append((offset(node.body[0].lineno, node.body[0].col_offset), offset(node.body[-1].end_lineno, node.body[-1].end_col_offset)))
            inside = node.name
        elif isinstance(node, ast.Import):
            out.imports.extend({"module": a.name, "names": [], "line": node.lineno} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            names = [a.name for a in node.names]
            out.imports.extend({"module": module, "names": [] if n == "*" else [n], "line": node.lineno} for n in names)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.calls.append({"callee": f.id, "qualifier": None, "line": node.lineno, "enclosing": inside})
            elif isinstance(f, ast.Attribute):
                out.calls.append({"callee": f.attr, "qualifier": ast.unparse(f.value), "line": node.lineno, "enclosing": inside})
        for child in ast.iter_child_nodes(node):
            walk(child, inside)

    top(tree.body)
    walk(tree, None)
    out.skeleton = splice(source, spans, "...")
    return out
