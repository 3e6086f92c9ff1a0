"""Markdown and JSON from tables of files. Each part is a row; only the end joins rows to one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import paths
from lodestar.functions.text import html_escape

TITLE = "Corpus outline"


def contract_view(files: DataFrame) -> DataFrame:
    """(path, line): the public symbols of each file that has any. files: (path, symbols of visibility, name, docstring)"""
    public = F.filter("symbols", lambda s: s["visibility"] == "public")
    names = F.transform(public, lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit(" — "), s["docstring"]), F.lit(""))))
    # The filter stays above the generator; it would otherwise make all names a second time.
    listed = files.select("path", F.explode(F.array(names)).alias("names")).where(F.size("names") > 0)
    return listed.select("path", F.concat(F.lit("- `"), "path", F.lit("`: "), F.array_join("names", ", ")).alias("line"))


def file_blocks(files: DataFrame, collapse: bool = True) -> DataFrame:
    """(path, block). files: (path, language, source[, token_count, has_redactions, symbols])"""
    have = files.columns
    path, lang, source = F.col("path"), F.col("language"), F.col("source")
    code = F.concat(F.lit("```"), paths.fence(lang, path), F.lit("\n"), source, F.when(source.endswith("\n"), "").otherwise("\n"), F.lit("```\n"))
    listed = F.lit("")
    if "symbols" in have:
        lines = F.transform("symbols", lambda s: F.concat(F.lit("- L"), s["line_start"].cast("string"), F.lit(": "), s["kind"], F.lit(" **"), s["name"], F.lit("**\n")))
        listed = F.when(F.size("symbols") > 0, F.concat(F.lit("\n**Extracted Symbols:**\n\n"), F.array_join(lines, ""))).otherwise("")
    if not collapse:
        return files.select("path", F.concat(F.lit("### "), path, F.lit("\n"), code, listed).alias("block"))
    tokens = F.col("token_count") if "token_count" in have else F.lit(0)
    mark = F.when(F.col("has_redactions"), " ⚠️ redacted").otherwise("") if "has_redactions" in have else F.lit("")
    head = F.concat(F.lit("<details>\n<summary><code>"), html_escape(path), F.lit("</code> <em>"), paths.display(lang), F.lit(" · "), tokens.cast("string"), F.lit(" tokens"), mark, F.lit("</em></summary>\n\n"))
    return files.select("path", F.concat(head, code, listed, F.lit("\n</details>\n")).alias("block"))


def summary(files: DataFrame) -> DataFrame:
    """(dir, files, tokens) by directory, and the row Total. files: (path, token_count)"""
    out = files.select(paths.directory(F.col("path")).alias("dir"), "token_count").rollup("dir").agg(F.grouping("dir").alias("all"), F.count("*").alias("files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return out.select(F.when(F.col("all") == 1, "Total").otherwise(F.col("dir")).alias("dir"), "files", "tokens", "all")


def markdown(files: DataFrame, collapse: bool = True, contract: bool = True, max_tokens: int | None = None) -> str:
    """One document for a corpus that fits in the driver; file_blocks gives the rows of any other."""
    totals = files.agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0)), F.coalesce(F.sum(F.size("symbols")), F.lit(0))).first()
    out = [f"# {TITLE}\n", f"**{totals[0]} files · {totals[1]} tokens · {totals[2]} symbols**\n", "## Structural Summary\n", "| Directory | Files | Tokens |", "|---|---|---|"]
    for r in summary(files).orderBy("all", "dir").collect():
        out.append(f"| **Total** | **{r.files}** | **{r.tokens}** |" if r["all"] else f"| `{r.dir}` | {r.files} | {r.tokens} |")
    out.append("")
    if contract:
        out += ["## Contract View\n", *(r.line for r in contract_view(files).orderBy("path").collect()), ""]
    out += ["## Source Files\n", *(r.block for r in file_blocks(files, collapse).orderBy("path").collect())]
    if max_tokens is not None and totals[1] > max_tokens:
        out.append(f"> ⚠️ {totals[1]} tokens are over the budget of {max_tokens}.\n")
    return "\n".join(out)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): nodes and edges in the order of their fields, and their numbers."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    both = n.crossJoin(e).select("nodes", "edges", F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"))
    return both.select(F.to_json(F.struct("*")).alias("json"))
