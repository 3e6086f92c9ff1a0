"""Whole runs over a repository: outline, graph, and slices under a token budget."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.bpe import count_tokens
from lodestar.operators import graph, resolve, slicing
from lodestar.parse.spark import parse
from lodestar.plans import render, strategies
from lodestar.plans.candidates import candidates
from lodestar.session import cut
from lodestar.sources import repository

MODES = ("dump", "explore", "architect", "task")


@dataclass(frozen=True)
class Options:
    mode: str = "dump"
    query: str | None = None
    max_tokens: int | None = None
    collapse: bool = True
    vocabulary: str | None = None  # a file of byte-pair ranks; without one, tokens are estimated

    def checked(self) -> Options:
        mode = self.mode.strip().lower()
        if self.max_tokens is not None and self.max_tokens < 1:
            raise ValueError(f"a budget of {self.max_tokens} tokens has no room for anything; give 1 or more")
        known = [*MODES, *(m for m in strategies.STRATEGIES if m not in MODES)]
        if mode not in known:
            raise ValueError(f"no mode {self.mode!r}; there are {', '.join(known)}")
        if mode == "task" and not (self.query or "").strip():
            raise ValueError("the mode task needs a query that isn't blank")
        return replace(self, mode=mode)


def parsed_files(files: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return cut(parse(files).withColumn("token_count", count_tokens(F.col("source"), vocabulary)))


def symbol_nodes(parsed: DataFrame) -> DataFrame:
    """(node, file_id, path, name, kind) of exported symbols, numbered by file and declaration."""
    each = parsed.select("file_id", "path", F.posexplode("symbols").alias("ordinal", "s")).where("s.visibility = 'public'")
    flat = each.select("file_id", "ordinal", "path", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"))
    return cut(graph.dense_ids(flat, "file_id", "ordinal"))


def code_graph(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind): imports, calls and parents between exported symbols."""
    wanted = parsed.select("path", "language", F.explode("imports").alias("i")).select("path", "language", F.col("i.module").alias("module"), F.col("i.names").alias("names")).distinct()

    def options(batches):
        for pdf in batches:
            lists = [candidates(p, l, m) for p, l, m in zip(pdf["path"], pdf["language"], pdf["module"], strict=True)]
            out = pd.DataFrame({"importer": pdf["path"], "module": pdf["module"], "tried": lists}).explode("tried").dropna(subset="tried")
            out["priority"] = out.groupby(level=0).cumcount()
            yield out.rename(columns={"tried": "path"})[["importer", "module", "path", "priority"]]

    tried = wanted.select("path", "language", "module").distinct().mapInPandas(options, "importer string, module string, path string, priority long")
    found = resolve.first_existing(tried, parsed, "importer", "module").select(F.col("importer").alias("path"), "module", F.col("path").alias("target"))
    imports = wanted.join(found, ["path", "module"]).select("path", "target", "names")
    calls = parsed.select("path", F.explode("calls").alias("c")).select("path", F.col("c.enclosing").alias("enclosing"), F.col("c.callee").alias("callee"))
    parents = parsed.select("path", F.explode("symbols").alias("s")).select("path", F.col("s.name").alias("name"), F.explode("s.parents").alias("p")).select("path", "name", F.col("p.name").alias("parent"), F.col("p.kind").alias("kind"))
    named = nodes.select("node", "path", "name")
    both = resolve.import_edges(imports, named).unionByName(resolve.call_edges(calls, named)).unionByName(resolve.parent_edges(parents, named))
    return cut(graph.distinct_edges(both))


def document_text(parsed: DataFrame) -> DataFrame:
    """(file_id, doc): the path, and each symbol's signature and docstring. Functions without a signature add nothing."""
    parts = F.transform("symbols", lambda s: F.concat(F.lit(" "), s["signature"], F.coalesce(F.concat(F.lit(" "), s["docstring"]), F.lit(""))))
    return parsed.select("file_id", F.concat("path", F.array_join(parts, "")).alias("doc"))


def plan(parsed: DataFrame, options: Options) -> DataFrame:
    """(file_id, level) of a mode that has a strategy."""
    nodes = symbol_nodes(parsed)
    edges = code_graph(parsed, nodes)
    scores = cut(graph.page_rank(nodes, edges))
    importance = graph.file_importance(nodes.select("node", "path"), scores, parsed)
    hub_files = graph.hubs(scores).join(nodes, "node").select("path").distinct().withColumn("hub", F.lit(True))
    files = parsed.select("file_id", "path", "token_count", F.size("symbols").alias("n_symbols"), count_tokens(F.col("skeleton"), options.vocabulary).alias("skeleton_tokens"))
    files = files.join(importance, "path").join(hub_files, "path", "left").withColumn("is_hub", F.coalesce("hub", F.lit(False))).drop("hub")
    levels = strategies.STRATEGIES[options.mode](strategies.Code(files, nodes, edges, document_text(parsed), options.query))
    plans = slicing.build_plans(levels).join(levels.select("file_id", "level"), "file_id")
    return slicing.allocate(plans, options.max_tokens or slicing.UNBOUNDED)


def apply_plan(parsed: DataFrame, levels: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Sources at their levels, recounted; files without any source left are gone."""
    from lodestar.functions.paths import comment_prefix

    mark = comment_prefix(F.col("language"))
    lines = F.transform("symbols", lambda s: F.concat(F.lit("L"), s["line_start"].cast("string"), F.lit(": "), s["kind"], F.lit(" "), s["name"]))
    signatures = F.concat(mark, F.lit(" "), F.col("path"), F.lit("\n"), F.array_join(lines, "\n"))
    source = F.when(F.col("level") == 3, F.col("source")).when(F.col("level") == 2, F.col("skeleton")).when(F.col("level") == 1, signatures).otherwise("")
    out = parsed.join(levels, "file_id").withColumn("source", source).where("source <> ''")
    return out.withColumn("token_count", count_tokens(F.col("source"), vocabulary)).drop("level")


def run(spark: SparkSession, root: str, options: Options = Options(), limits: repository.Limits = repository.Limits()) -> str:
    """The Markdown of a repository."""
    options = options.checked()
    files = parsed_files(repository.read(spark, root, limits).files, options.vocabulary)
    sliced = options.mode in strategies.STRATEGIES
    if sliced:
        files = cut(apply_plan(files, plan(files, options), options.vocabulary))
    return render.markdown(files, options.collapse, contract=options.mode != "dump", max_tokens=None if sliced else options.max_tokens)


def export_graph(spark: SparkSession, root: str) -> str | None:
    """The graph of a repository as JSON, or None where it has no symbols."""
    parsed = parsed_files(repository.read(spark, root).files)
    nodes = symbol_nodes(parsed)
    if nodes.isEmpty():
        return None
    edges = code_graph(parsed, nodes)
    scored = nodes.join(graph.page_rank(nodes, edges), "node").select(F.col("node").alias("id"), "name", F.col("path").alias("file"), "kind", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("score"))
    return render.graph_json(scored, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind")).first()[0]
