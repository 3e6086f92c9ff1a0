import json

import pytest
from lodestar.parse.spark import parse_one
from lodestar.plans import topology
from lodestar.plans.candidates import candidates
from lodestar.sources.repository import Limits, ignored, read

RUST = '/// Doc\npub fn main() { helper(); }\npub(crate) fn inner(x: i32) -> i32 { foo::bar::<u8>(x); x }\nuse a::{b, c::{self, d as e}, f::*};\nimpl T { pub fn m(&self) { self.go(); } }\nmod deep { pub fn hidden() {} }\npub trait Z { fn q(); }\n#[derive(Clone)]\nstruct S { a: u8 }\n'
TS = 'import React, { useState as us } from "react";\nimport * as x from "./u";\nexport class Dog extends Animal implements Pet {\n  private bark(a: string): void { woof(a); }\n}\nexport function f(x: number) { return g(x); }\ninterface I extends J {}\nexport type T = string;\nconst r = require("./z");\n'
GO = 'package a\nimport (\n "fmt"\n x "y/z"\n)\n// Hello greets\nfunc Hello(n string) { fmt.Println(n) }\nfunc (s *Srv) run() { Hello("a") }\ntype Srv struct { a int }\n'
PY = 'import os.path as p\nfrom .a import b, c\nclass K(Base, Q):\n    """doc"""\n    def m(self, x=1, y: int = 2):\n        return helper(x)\n@dec\ndef f(a, b: int):\n    "d"\n    def nested(): pass\n    return os.walk(a)\ndef _hidden(): pass\n'


def shown(p):
    return [(s.kind, s.name, s.visibility) for s in p.symbols]


def test_rust():
    p = parse_one("rust", RUST)
    assert shown(p) == [("function", "main", "public"), ("function", "inner", "crate"), ("function", "m", "public"), ("module", "deep", "private"), ("interface", "Z", "public"), ("struct", "S", "private")]
    assert p.symbols[0].docstring == "Doc" and p.symbols[1].signature == "fn inner(x: i32)"
    assert [(i["module"], i["names"]) for i in p.imports] == [("a", ["b"]), ("a", ["c"]), ("a::c", ["d"]), ("a::f", [])]
    assert [(c["callee"], c["enclosing"]) for c in p.calls] == [("helper", "main"), ("bar", "inner"), ("go", "m")]
    assert "pub fn main() /* ... */" in p.skeleton and "helper" not in p.skeleton


def test_typescript_and_javascript():
    p = parse_one("typescript", TS)
    assert shown(p) == [("class", "Dog", "public"), ("function", "f", "public"), ("interface", "I", "private"), ("type alias", "T", "public")]
    assert p.symbols[0].parents == [{"name": "Animal", "kind": "extends"}, {"name": "Pet", "kind": "implements"}] and p.symbols[0].members == ["bark"]
    assert [(i["module"], i["names"]) for i in p.imports] == [("react", ["React", "useState"]), ("./u", []), ("./z", [])]
    assert [(c["callee"], c["enclosing"]) for c in p.calls] == [("woof", "bark"), ("g", "f")]
    js = parse_one("javascript", "export function f() { return 1; }")
    assert shown(js) == [("function", "f", "private")] and js.skeleton == "export function f() /* ... */"


def test_go():
    p = parse_one("go", GO)
    assert shown(p) == [("function", "Hello", "public"), ("function", "run", "private"), ("struct", "Srv", "public")]
    assert [i["module"] for i in p.imports] == ["fmt", "y/z"] and [(c["callee"], c["qualifier"]) for c in p.calls] == [("Println", "fmt"), ("Hello", None)]


def test_python_and_broken_python():
    p = parse_one("python", PY)
    assert shown(p) == [("class", "K", "public"), ("function", "f", "public"), ("function", "_hidden", "private")]
    assert p.symbols[0].parents == [{"name": "Base, Q", "kind": "extends"}] and p.symbols[1].signature == "def f(a, b: int)"
    assert [(i["module"], i["names"]) for i in p.imports] == [("os.path", []), (".a", ["b"]), (".a", ["c"])]
    assert "..." in p.skeleton and "helper" not in p.skeleton
    broken = parse_one("python", "def broken(:\n  pass\n\n\ndef other(): pass")
    assert broken.status == "fallback" and [(s.name, s.line_start) for s in broken.symbols] == [("broken", 1), ("other", 3)]


@pytest.mark.parametrize(
    ("path", "language", "module", "first"),
    [("src/auth/login.rs", "rust", "super::utils", "src/auth/utils.rs"), ("src/a.ts", "typescript", "./user.service", "src/user.ts"), ("src/a.ts", "typescript", "react", None), ("p/q/a.py", "python", "x.y", "p/q/x/y.py"), ("p/q/a.py", "python", "..b", "p/b.py"), ("a.rs", "rust", "std::io", None), ("c/a.go", "go", "m/n", "c/m/n")],
)
def test_candidates(path, language, module, first):
    got = candidates(path, language, module)
    assert (got[0] if got else None) == first


def test_ignore_rules():
    rules = [("", "*.log", False), ("", "build/", False), ("", "!keep.log", True), ("", "/top", False)]
    rules[2] = ("", "keep.log", True)
    assert ignored("a/x.log", rules) and ignored("build/a.py", rules) and not ignored("keep.log", rules) and ignored("top", rules) and not ignored("a/top", rules)


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "a.log").write_text("no")
    (tmp_path / "bad.bin").write_bytes(b"\x00\x01\x02\x03")
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "src" / "session.py").write_text("class Session:\n    pass\n\ndef open_session(user):\n    return Session()\n")
    (tmp_path / "src" / "auth.py").write_text('from session import open_session\n\ndef login(user):\n    """Authenticate a user by credentials."""\n    token = "abcdef0123456789abcd"\n    return open_session(user)\n')
    (tmp_path / "src" / "other.py").write_text("def unrelated(x):\n    return [x * k for k in range(1000)]\n" * 1)
    return tmp_path


def test_reading(spark, repo):
    c = read(spark, str(repo))
    assert [r.path for r in c.files.orderBy("file_id").collect()] == [".gitignore", "src/auth.py", "src/other.py", "src/session.py"]
    assert {(r.path, r.reason) for r in c.skipped.collect()} == {("bad.bin", "binary"), ("latin.txt", "not_utf8")} and c.redactions == 1
    assert read(spark, str(repo), Limits(max_file_count=2)).truncated == 4


def test_runs(spark, repo):
    dump = topology.run(spark, str(repo))
    assert "## Contract View" not in dump and "[REDACTED]" in dump and "| **Total** | **4** |" in dump
    g = json.loads(topology.export_graph(spark, str(repo)))
    names = {n["id"]: n["name"] for n in g["nodes"]}
    assert {(names[e["source"]], names[e["target"]], e["kind"]) for e in g["edges"]} == {("login", "open_session", "import"), ("login", "open_session", "call"), ("open_session", "Session", "call")}
    assert abs(sum(n["score"] for n in g["nodes"]) - 1) < 0.01
    architect = topology.run(spark, str(repo), topology.Options("architect"))
    assert "## Contract View" in architect and "..." in architect
    task = topology.run(spark, str(repo), topology.Options("task", "login authenticate credentials", 10_000))
    assert "Authenticate a user by credentials" in task and "L1: function unrelated" in task
    for bad in (topology.Options("x"), topology.Options("task"), topology.Options(max_tokens=0)):
        with pytest.raises(ValueError):
            topology.run(spark, str(repo), bad)
