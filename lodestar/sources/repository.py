"""A tree of source files as a table, with what is left out and why."""

from __future__ import annotations

import functools
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import paths, secrets


@dataclass(frozen=True)
class Limits:
    max_file_size: int = 1 << 20
    max_file_count: int = 10_000
    max_path_depth: int = 64


@dataclass
class Corpus:
    files: DataFrame  # file_id, path, language, source, size_bytes, has_redactions
    skipped: DataFrame  # path, reason
    truncated: int
    redactions: int


def _lines(text: str, base: str) -> list[tuple[str, str, bool]]:
    """(directory, pattern, negated) of an ignore file. Spaces at the end count only after a backslash."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if line and not line.startswith("#"):
            out.append((base, line.removeprefix("!"), line.startswith("!")))
    return out


def _rules(root: Path) -> list[tuple[str, str, bool]]:
    """(directory, pattern, negated) of all ignore files: the user's own, the repository's exclude file, then outer before inner ones."""
    out = []
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    for extra in (Path(config, "git", "ignore"), root / ".git" / "info" / "exclude"):
        if extra.is_file():
            out += _lines(extra.read_text(errors="replace"), "")
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d != ".git")
        base = os.path.relpath(at, root).replace(os.sep, "/")
        for name in (".gitignore", ".ignore"):
            if name in names:
                out += _lines(Path(at, name).read_text(errors="replace"), "" if base == "." else base)
    return out


@functools.lru_cache(maxsize=65_536)
def _pattern(glob: str) -> re.Pattern:
    """A glob as an expression: * and ? stay within a part of a path; **/, /** and /**/ stand for any number of parts."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob[k:] == "**" and k and glob[k - 1] == "/":
            out, k = out + ".+", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2 + (glob[k + 1 : k + 2] in "!^"))) > 0:
            body = glob[k + 1 : end]
            inverse = body[:1] in ("!", "^")
            body = body[inverse:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            out, k = out + ("(?!/)[^" if inverse else "(?!/)[") + body + "]", end + 1
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    try:
        return re.compile(out)
    except re.error:  # a range that isn't one matches nothing
        return re.compile(r"(?!)")


def ignored(path: str, rules: list[tuple[str, str, bool]]) -> bool:
    """Whether a path relative to the root, or a directory that it is in, is ignored; the last rule that matches decides."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, is_dir, out = "/".join(parts[:k]), k < len(parts), False
        for base, pattern, negated in rules:
            if base and not here.startswith(base + "/"):
                continue
            inner = here[len(base) + 1 :] if base else here
            only_dir, p = pattern.endswith("/"), pattern.rstrip("/")
            if only_dir and not is_dir:
                continue
            target = inner if "/" in p else inner.rsplit("/", 1)[-1]
            if p and _pattern(p.removeprefix("/")).fullmatch(target):
                out = not negated
        if out:
            return True
    return False


def admit(raw: DataFrame, limits: Limits) -> DataFrame:
    """raw (path, content, length) with source and reason (null: admitted). A null content or length is read as an empty file."""
    raw = raw.withColumns({"content": F.coalesce("content", F.lit("").cast("binary")), "length": F.coalesce("length", F.lit(0))})
    text = F.col("content").cast("string")
    reason = (
        F.when(F.instr("path", "\0") > 0, "bad_path")
        .when(F.size(F.split("path", "/")) > limits.max_path_depth, "path_too_deep")
        .when(F.col("length") > limits.max_file_size, "too_large")
        .when(F.contains(F.substring("content", 1, 512), F.unhex(F.lit("00"))), "binary")
        .when(~F.is_valid_utf8(text), "not_utf8")
    )
    return raw.select("path", "length", text.alias("source"), reason.alias("reason"))


def read(spark: SparkSession, root: str, limits: Limits = Limits()) -> Corpus:
    base = Path(root).resolve()
    if not base.is_dir():
        raise FileNotFoundError(f"no directory: {root}")
    rules = _rules(base)
    listing = [os.path.relpath(os.path.join(at, n), base).replace(os.sep, "/") for at, dirs, names in os.walk(base) if not dirs.sort() for n in names if os.path.isfile(os.path.join(at, n)) and not os.path.islink(os.path.join(at, n))]
    wanted = sorted(p for p in listing if not p.startswith(".git/") and "/.git/" not in p and not ignored(p, rules))
    kept, truncated = wanted[: limits.max_file_count], max(0, len(wanted) - limits.max_file_count)
    names = spark.createDataFrame([(p,) for p in kept], "path string")
    # Spark's own listings leave out names that begin with a dot or an underscore, so tasks open the files
    # themselves, from the folder, which all of them share.
    folder, most = str(base), limits.max_file_size

    def load(batches):
        for pdf in batches:
            sizes = [os.path.getsize(os.path.join(folder, p)) for p in pdf["path"]]
            content = [Path(folder, p).read_bytes() if n <= most else b"" for p, n in zip(pdf["path"], sizes, strict=True)]
            yield pdf.assign(content=content, length=sizes)

    parts = max(1, min(len(kept) // 50 + 1, 10_000))
    raw = names.repartition(parts).mapInPandas(load, "path string, content binary, length long")
    scored = admit(raw, limits)
    good = scored.where("reason is null")
    clean = good.select("path", "source", secrets.redact(F.col("source")).alias("text"), secrets.count(F.col("source")).alias("n"), "length")
    ids = spark.createDataFrame([(k, p) for k, p in enumerate(kept)], "file_id long, path string")
    files = clean.join(F.broadcast(ids), "path").select("file_id", "path", paths.language(F.col("path"), F.col("text")).alias("language"), F.col("text").alias("source"), F.col("length").alias("size_bytes"), (F.col("n") > 0).alias("has_redactions"), "n")
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Corpus(files.drop("n"), scored.where("reason is not null").select("path", "reason"), truncated, int(total))
