"""Strategies: at which level each file of a sliced run starts, and what it is worth.

A strategy takes a `Code` and gives (file_id, level, is_hub, importance), a row a file; `slicing.allocate` then
fits the levels to the budget. `register_strategy` adds a mode of one's own to those of the command line.

Defined results: a null score means that a search didn't find the file, null flags are false and null importances
are 0; columns other than those named stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import bm25, graph
from lodestar.session import cut

TOP_FILES, HOPS = 5, 2


@dataclass(frozen=True)
class Code:
    files: DataFrame  # file_id, path, token_count, n_symbols, skeleton_tokens, importance, is_hub
    nodes: DataFrame  # node, file_id, path, name, kind
    edges: DataFrame  # src, dst, kind
    texts: DataFrame  # file_id, doc
    query: str | None


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def architect_levels(files: DataFrame) -> DataFrame:
    """files (file_id, is_hub, importance): hubs in full, the others as skeletons."""
    return files.withColumn("is_hub", _flag("is_hub")).withColumn("level", F.when(F.col("is_hub"), 3).otherwise(2))


def task_levels(files: DataFrame) -> DataFrame:
    """files (file_id, is_hub, importance, score, near): those found in full, and as hubs; their neighbours as
    skeletons; signatures of the others. A file found is worth its score besides its importance."""
    found = F.col("score").isNotNull()
    out = files.withColumn("level", F.when(found, 3).when(_flag("near"), 2).otherwise(1))
    return out.withColumns({"is_hub": found | _flag("is_hub"), "importance": F.coalesce("score", F.lit(0.0)) + F.coalesce("importance", F.lit(0.0))})


def architect(code: Code) -> DataFrame:
    return architect_levels(code.files)


def task(code: Code) -> DataFrame:
    best = cut(bm25.search(code.texts, "file_id", F.col("doc"), code.query or "", TOP_FILES))
    start = code.nodes.join(best.select("file_id"), "file_id").select("node")
    near = graph.k_hop(code.edges, start, HOPS).join(code.nodes, "node").select("file_id").distinct().join(best, "file_id", "left_anti")
    return task_levels(code.files.join(best, "file_id", "left").join(near.withColumn("near", F.lit(True)), "file_id", "left"))


Strategy = Callable[[Code], DataFrame]
STRATEGIES: dict[str, Strategy] = {"architect": architect, "task": task}


def register_strategy(mode: str, strategy: Strategy) -> None:
    STRATEGIES[mode.strip().lower()] = strategy
