"""Rust, TypeScript and Go by one scan: strings and comments are masked, then declarations are read
by patterns, and bodies by matching braces. A scan takes broken sources as well."""

from __future__ import annotations

import bisect
import re

from lodestar.parse.model import Parsed, Symbol, splice

KEYWORDS = frozenset("if else for while match switch return fn func function loop in as let const var new typeof await catch super self this where impl pub use mod struct enum trait type go defer select range case break continue import export class interface extends implements throw delete void yield async unsafe move ref mut dyn static".split())
_MASKS = {
    "rust": r'//[^\n]*|/\*.*?\*/|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\])\'',
    "typescript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\])'",
}
MASKS = {k: re.compile(v, re.S) for k, v in _MASKS.items()}


class Source:
    def __init__(self, text: str, language: str):
        self.text = text
        self.code = MASKS[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        self.derives: list[tuple[int, list[str]]] = []
        if language == "rust":  # attributes hold no calls
            self.derives = [(m.start(), [x.strip() for x in m.group(1).split(",") if x.strip()]) for m in re.finditer(r"#\[derive\(([^)]*)\)\]", self.code)]
            self.code = re.sub(r"#!?\[[^\]]*\]", lambda m: re.sub(r"[^\n]", " ", m.group()), self.code)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pairs: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\]]", self.code):
            c = m.group()
            if c in "{([":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] == {"}": "{", ")": "(", "]": "["}[c]:
                self.pairs[stack.pop()[1]] = m.start()

    def block(self, at: int) -> int:
        """Where the innermost block around a place opens, or -1."""
        return max((a for a, b in self.pairs.items() if a < at < b), default=-1)

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def body(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The braces that open next after `at`, unless `stop` comes before; brackets in between are passed over."""
        k = at
        while k < len(self.code):
            c = self.code[k]
            if c == "{":
                return (k, self.pairs[k] + 1) if k in self.pairs else None
            if c in "([" and k in self.pairs:
                k = self.pairs[k]
            elif c in stop or c == "}":
                return None
            k += 1
        return None

    def docs(self, at: int, marks: tuple[str, ...]) -> str | None:
        """Comment lines right above `at`."""
        start = self.text.rfind("\n", 0, at) + 1
        found: list[str] = []
        while start > 0:
            before = self.text.rfind("\n", 0, start - 1) + 1
            line = self.text[before : start - 1].strip()
            mark = next((m for m in marks if line.startswith(m)), None)
            if mark is None:
                break
            found.append(line[len(mark) :].strip())
            start = before
        return "\n".join(reversed(found)) or None


def _inside(spans: list[tuple[int, int, str]], at: int) -> str | None:
    """The name of the innermost span that holds `at`."""
    best = None
    for a, b, name in spans:
        if a <= at < b and (best is None or a >= best[0]):
            best = (a, name)
    return best[1] if best else None


def _calls(s: Source, functions: list[tuple[int, int, str]], skip: set[int], separators: str) -> list[dict]:
    out = []
    pattern = re.compile(r"((?:[A-Za-z_]\w*(?:" + separators + r"))*)([A-Za-z_]\w*)\s*(?:::<[^>()]*>)?\(")
    for m in pattern.finditer(s.code):
        if (m.group(2) in KEYWORDS and not m.group(1) and s.code[m.start() - 1 : m.start()] != ".") or m.start(2) in skip or s.code[: m.start()].rstrip().endswith(("fn", "func", "function")):
            continue
        qualifier = re.sub("(?:" + separators + ")$", "", m.group(1)) or None
        if qualifier is None and m.start() and s.code[m.start() - 1] == ".":
            qualifier = ""
        out.append({"callee": m.group(2), "qualifier": qualifier, "line": s.line(m.start()), "enclosing": _inside(functions, m.start())})
    return out


def rust(source: str) -> Parsed:
    s, out = Source(source, "rust"), Parsed()
    vis = lambda v: "private" if not v else "crate" if re.match(r"pub\s*\(\s*crate\s*\)", v) else "public"
    closed: list[tuple[int, int]] = []  # bodies whose items aren't symbols
    functions, bodies, names = [], [], set()
    item = re.compile(r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\b(?P<what>fn|struct|enum|trait|type|mod|impl)\b(?:\s*(?P<name>[A-Za-z_]\w*))?")
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "interface", "type": "type alias", "mod": "module"}
    for m in item.finditer(s.code):
        what, name, at = m.group("what"), m.group("name"), m.start()
        hidden = any(a <= at < b for a, b in closed)
        if what == "impl" or not name:
            continue
        body = s.body(m.end(), ";" if what != "type" else ";")
        end = body[1] if body else s.code.find(";", m.end())
        end = end if end > 0 else m.end()
        if what == "fn":
            if body:
                functions.append((at, body[1], name))
                bodies.append(body)
                closed.append(body)
            names.add(m.start("name"))
        elif what in ("trait", "mod") and body:
            closed.append(body)
        if hidden:
            continue
        signature = f"{what} {name}"
        if what == "fn":
            open_ = s.code.find("(", m.end())
            signature = f"fn {name}" + (source[open_ : s.pairs[open_] + 1] if open_ in s.pairs else "()")
        visibility = "private" if what == "mod" else vis(m.group("vis"))
        derives = _derives(s, at) if what in ("struct", "enum") else []
        out.symbols.append(Symbol(kinds[what], name, visibility, signature, s.docs(at, ("///", "//!")), s.line(at), s.line(end), derives=derives))
    for m in re.finditer(r"\buse\s+([^;]+);", s.code):
        line = s.line(m.start())
        for path in _use(re.sub(r"\s+", " ", m.group(1)).strip()):
            head, _, last = path.rpartition("::")
            module, bound = (head, last) if head else (last, "")
            out.imports.append({"module": module, "names": [bound] if bound and bound != "*" else [], "line": line})
    out.calls = _calls(s, functions, names, r"::|\.")
    out.skeleton = splice(source, bodies, "/* ... */")
    return out


def _derives(s: Source, at: int) -> list[str]:
    """What all attributes before an item in its block derive: they are siblings of the items, so an item
    without any of its own has those of the items before it."""
    if not s.derives:
        return []
    here = s.block(at)
    return [name for place, names in s.derives if here < place < at and s.block(place) == here for name in names]


def _use(tree: str) -> list[str]:
    """Paths of a use tree, one for each name that it binds; an alias has the path of what it names."""
    tree = tree.strip()
    if (k := tree.find("{")) < 0:
        return [re.sub(r"\s+as\s+\w+$", "", tree).replace(" ", "")] if tree else []
    head, inner, depth, parts, last = tree[:k].replace(" ", ""), tree[k + 1 : tree.rfind("}")], 0, [], 0
    for i, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(inner[last:i])
            last = i + 1
    parts.append(inner[last:])
    out = []
    for p in parts:
        for path in _use(p):
            out.append(head.removesuffix("::") if path == "self" else head + path)
    return out


def typescript(source: str) -> Parsed:
    s, out = Source(source, "typescript"), Parsed()
    functions, bodies, names, blocks = [], [], set(), []
    item = re.compile(r"(?P<export>\bexport\s+(?:default\s+)?)?(?:(?:declare|abstract|async|const)\s+)*\b(?P<what>function|class|interface|type|enum)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)")
    kinds = {"function": "function", "class": "class", "interface": "interface", "type": "type alias", "enum": "enum"}
    for m in item.finditer(s.code):
        what, name, at = m.group("what"), m.group("name"), m.start()
        if what == "type" and not re.match(r"\s*(?:<[^=]*>)?\s*=", s.code[m.end() :]):
            continue
        body = s.body(m.end(), ";" if what != "type" else ";\n")
        end = body[1] if body else m.end()
        exported = bool(m.group("export")) and not any(a < at < b for a, b in blocks)
        symbol = Symbol(kinds[what], name, "public" if exported else "private", "" if what == "function" else f"{what} {name}", None, s.line(at), s.line(end))
        if what in ("class", "interface") and body:
            head = re.sub(r"<[^<>]*>", "", s.code[m.end() : body[0]])
            listed = lambda t: [x.strip() for x in t.split(",") if re.fullmatch(r"[\w$.]+", x.strip())]
            ext = re.search(r"\bextends\s+([\w$.,\s]+?)(?=\bimplements\b|$)", head)
            imp = re.search(r"\bimplements\s+([\w$.,\s]+)$", head)
            supers = listed(ext.group(1)) if ext else []
            if what == "class":
                symbol.parents = [{"name": n, "kind": "extends"} for n in supers[:1]] + [{"name": n, "kind": "implements"} for n in supers[1:] + (listed(imp.group(1)) if imp else [])]
                for f in re.finditer(r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*(?:<[^<>(){}]*>)?\(", s.code[body[0] : body[1]]):
                    start = body[0] + f.start(1)
                    close = s.pairs.get(body[0] + f.end() - 1)
                    inner = s.body(close + 1) if close and f.group(1) not in KEYWORDS - {"new"} else None
                    if inner and not any(a < start < b for a, b in bodies):
                        symbol.members.append(f.group(1))
                        functions.append((start, inner[1], f.group(1)))
                        bodies.append(inner)
                        names.add(start)
            else:
                symbol.parents = [{"name": n, "kind": "interface_extends"} for n in supers]
        if what == "function":
            names.add(m.start("name"))
            if body:
                functions.append((at, body[1], name))
                bodies.append(body)
                blocks.append(body)
        out.symbols.append(symbol)
    text = lambda a, b: source[a:b]
    for m in re.finditer(r"\b(?:import|export)\b([^;'\"`{}]*(?:\{[^}]*\})?[^;'\"`{}]*?)\bfrom(?=\s)|\bimport(?=\s)|\brequire\s*\(", s.code):
        q = re.match(r"\s*['\"]([^'\"\n]+)['\"]", text(m.end(), m.end() + 300))
        if q:
            clause = m.group(1) or ""
            bound = []
            braces = re.search(r"\{([^}]*)\}", clause)
            lead = re.match(r"\s*(?:type\s+)?([A-Za-z_$][\w$]*)", clause)
            if lead and lead.group(1) not in ("type",):
                bound.append(lead.group(1))
            if braces:
                bound += [re.split(r"\s+as\s+", x.strip().removeprefix("type "))[0].strip() for x in braces.group(1).split(",") if x.strip()]
            out.imports.append({"module": q.group(1), "names": bound, "line": s.line(m.start())})
    out.calls = _calls(s, functions, names, r"\.|\?\.")
    out.calls = [c for c in out.calls if c["callee"] not in ("require",)]
    out.skeleton = splice(source, bodies, "/* ... */")
    return out


def go(source: str) -> Parsed:
    s, out = Source(source, "go"), Parsed()
    vis = lambda n: "public" if n[:1].isupper() else "private"
    functions, bodies, names = [], [], set()
    for m in re.finditer(r"(?m)^\s*func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", s.code):
        close = s.pairs.get(m.end() - 1)
        body = s.body(close + 1, ";") if close else None
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        names.add(m.start(1))
        if body:
            functions.append((at, body[1], m.group(1)))
            bodies.append(body)
        out.symbols.append(Symbol("function", m.group(1), vis(m.group(1)), "", s.docs(at, ("//",)), s.line(at), s.line(body[1] if body else m.end())))
    spec = r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(=\s*)?(struct|interface|[\w.*\[\]]+)"
    groups = [(m.end(), s.pairs[m.end() - 1]) for m in re.finditer(r"\btype\s*\(", s.code) if m.end() - 1 in s.pairs]
    declared = [(m.start(1), m) for m in re.finditer(r"(?m)^\s*type\s+" + spec, s.code)]
    for a, b in groups:
        declared += [(m.start(1), m) for m in re.compile(r"(?m)^\s*" + spec).finditer(s.code, a, b) if not any(x < m.start(1) < y for x, y in ((k, v) for k, v in s.pairs.items() if s.code[k] == "{" and a < k < b))]
    for at, m in sorted(declared, key=lambda x: x[0]):
        kind = {"struct": "struct", "interface": "interface"}.get(m.group(3), "type alias")
        body = s.body(m.end(), "\n") if kind != "type alias" else None
        out.symbols.append(Symbol(kind, m.group(1), vis(m.group(1)), f"{'type' if kind == 'type alias' else kind} {m.group(1)}", s.docs(at, ("//",)), s.line(at), s.line(body[1] if body else m.end())))
    out.symbols.sort(key=lambda x: x.line_start)
    for m in re.finditer(r"(?m)^\s*import\b\s*(\()?", s.code):
        end = s.pairs.get(m.end() - 1, m.end()) if m.group(1) else (s.code.find("\n", m.end()) if "\n" in s.code[m.end() :] else len(s.code))
        for q in re.finditer(r"\"([^\"\n]+)\"|`([^`\n]+)`", source[m.end() : end]):
            out.imports.append({"module": q.group(1) or q.group(2), "names": [], "line": s.line(m.end() + q.start())})
    out.calls = _calls(s, functions, names, r"\.")
    out.skeleton = splice(source, bodies, "/* ... */")
    return out
