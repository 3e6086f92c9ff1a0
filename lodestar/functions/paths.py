"""Paths and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# language: (extensions, fence, display name, comment prefix, extractor, skeletonised)
LANGUAGES = {
    "rust": (("rs",), "rs", "Rust", "//", "rust", True),
    "python": (("py", "pyi", "pyx"), "py", "Python", "#", "python", True),
    "typescript": (("ts", "tsx"), "ts", "TypeScript", "//", "typescript", True),
    "javascript": (("js", "jsx", "mjs", "cjs"), "js", "JavaScript", "//", "fallback", True),
    "go": (("go",), "go", "Go", "//", "go", True),
    "java": (("java",), "java", "Java", "//", "fallback", False),
    "c": (("c", "h"), "c", "C", "//", "fallback", False),
    "cpp": (("cpp", "cc", "cxx", "hpp", "hxx"), "cpp", "C++", "//", "fallback", False),
    "csharp": (("cs",), "cs", "C#", "//", "fallback", False),
    "ruby": (("rb",), "rb", "Ruby", "#", "fallback", False),
    "swift": (("swift",), "swift", "Swift", "//", "fallback", False),
    "kotlin": (("kt", "kts"), "kt", "Kotlin", "//", "fallback", False),
}
ALIASES = {"ts": "typescript", "js": "javascript", "golang": "go", "c++": "cpp", "c#": "csharp", "kt": "kotlin"}
EXTENSIONS = {e: name for name, row in LANGUAGES.items() for e in row[0]}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def shebang(source: Column) -> Column:
    """The language that the first line names, or unknown."""
    line = F.regexp_extract(F.coalesce(source, F.lit("")), r"^(#!/[^\n]*)", 1)
    last = F.regexp_extract(F.rtrim(line), r"([^/ \t]*)$", 1)
    return F.when(last.isin("python", "python3"), "python").when(last.isin("node", "nodejs"), "javascript").otherwise("unknown")


def language(path: Column, source: Column | None = None) -> Column:
    known = _lookup(extension(path), EXTENSIONS)
    return F.coalesce(known, shebang(source) if source is not None else F.lit("unknown"))


def language_named(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(_lookup(low, {**{n: n for n in LANGUAGES}, **ALIASES}), low)


def display(lang: Column) -> Column:
    return F.coalesce(_lookup(lang, {n: r[2] for n, r in LANGUAGES.items()}), lang)


def comment_prefix(lang: Column) -> Column:
    return F.coalesce(_lookup(lang, {n: r[3] for n, r in LANGUAGES.items()}), F.lit("#"))


def fence(lang: Column, path: Column) -> Column:
    return F.coalesce(_lookup(lang, {n: r[1] for n, r in LANGUAGES.items()}), F.nullif(extension(path), F.lit("")), F.lit("text"))


def directory(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def join_lexical(base: Column, relative: Column) -> Column:
    """base/relative with . and .. resolved without looking at files."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(folded, "/")


def normalise(path: Column, windows: bool = False) -> Column:
    """With slashes for backslashes, where these separate folders; elsewhere a path as it is."""
    return F.replace(path, F.lit("\\"), F.lit("/")) if windows else path


def same_path(a: Column, b: Column, windows: bool = False) -> Column:
    """Whether two paths have the same parts. Repeated and closing slashes don't count, a leading one does;
    . and .. are parts like others. Null where a path is null."""
    whole = lambda p: F.regexp_replace(F.regexp_replace(normalise(p, windows), "/+", "/"), "(?<=.)/$", "")
    return whole(a) == whole(b)
