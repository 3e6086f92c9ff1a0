"""Graphs as edge tables: degrees, PageRank, hubs, neighbourhoods.

Nodes have a column node, edges src and dst, and kind where kinds matter; other columns are not looked at.

Defined results: null nodes, and edges with a null end, are left out; repeated nodes are one, while parallel edges
count each until `distinct_edges` drops them; empty tables give empty results; equal scores go by node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut

DAMPING, MAX_ROUNDS, TOLERANCE, HUB_SHARE = 0.85, 100, 1e-6, 0.10


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Without self loops and repeats of (src, dst, kind)."""
    keys = [c for c in ("src", "dst", "kind") if c in edges.columns]  # src <> dst leaves out null ends too
    return edges.where("src <> dst").dropDuplicates(keys)


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree) of all nodes; parallel edges of different kinds count each."""
    nodes = nodes.where("node is not null")
    d = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, small: int = 2_000_000) -> DataFrame:
    """(node, score). Graphs of at most `small` nodes and edges are ranked in one task; others, with the same
    result, by a join a round.

    Mass of nodes without edges out is spread over all. Edges from or to what isn't a node don't count. Rounds
    end when the scores change by less than the tolerance in sum, after the change.
    """
    nodes = nodes.select("node").where("node is not null").distinct()
    known = lambda end: nodes.select(F.col("node").alias(end))
    edges = cut(edges.select("src", "dst").join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst"))
    n, m = nodes.count(), edges.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    if n + m <= small:
        return _rank_in_task(nodes, edges, damping, rounds, tolerance)
    degree = out_degree(nodes, edges)
    # Partitioned once by source; each round moves only scores and sums.
    flow = cut(edges.select("src", "dst").join(degree.withColumnRenamed("node", "src"), "src").repartition("src"))
    now = cut(degree.select("node", "out_degree", F.lit(1.0 / n).alias("score")))
    for _ in range(rounds):
        dangling = now.where("out_degree = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        into = flow.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out_degree")).alias("in"))
        new = (1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n)
        after = cut(now.join(into, "node", "left").crossJoin(F.broadcast(dangling)).select("node", "out_degree", new.alias("score"), F.abs(new - F.col("score")).alias("moved")))
        moved = after.agg(F.sum("moved")).first()[0]
        now = after.drop("moved")
        if moved < tolerance:
            break
    return now.select("node", "score")


def _rank_in_task(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    kind = nodes.schema["node"].dataType.simpleString()

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = left.node.sort_values(ignore_index=True)
        at = pd.Index(names)
        src, dst = at.get_indexer(right.src), at.get_indexer(right.dst)
        n = len(names)
        degree = np.bincount(src, minlength=n)
        score = np.full(n, 1.0 / n)
        for _ in range(rounds):
            share = score / np.maximum(degree, 1)
            new = (1 - damping) / n + damping * (np.bincount(dst, share[src], minlength=n) + score[degree == 0].sum() / n)
            moved = np.abs(new - score).sum()
            score = new
            if moved < tolerance:
                break
        return pd.DataFrame({"node": names, "score": score})

    one = F.lit(0).alias("g")
    return nodes.select("node", one).groupBy("g").cogroup(edges.select("src", "dst", one).groupBy("g")).applyInPandas(run, f"node {kind}, score double")


def hubs(scores: DataFrame, share: float = HUB_SHARE) -> DataFrame:
    """(node, score) of the first max(1, floor(n * share)) by score, then node."""
    share = min(max(share, 0.0), 1.0)
    n = scores.count()
    most = min(n, max(1, int(n * share)))
    return scores.select("node", "score").orderBy(F.desc("score"), "node").limit(most)


def k_hop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, hop): nodes within k edges of the start, either way, but for the start itself; import edges don't count."""
    if "kind" in edges.columns:
        edges = edges.where("kind <> 'import'")
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, k + 1):
        # The edges themselves aren't made distinct: a semi join has each once a hop, and only their ends are kept.
        step = near.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen.where("hop > 0")


def file_importance(nodes: DataFrame, scores: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importance): the largest score of the file's exported symbols, 0 without any. nodes: (node, path)"""
    best = nodes.join(scores, "node").groupBy("path").agg(F.max("score").alias("importance"))
    return files.select("path").join(best, "path", "left").select("path", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def dense_ids(symbols: DataFrame, *order: str) -> DataFrame:
    """With node, a number from 0 in the order given; a column of this name is replaced, all others stay.

    Nulls come first; rows alike in the order get numbers next to each other. A window over all rows would
    sort them in one task; so rows are sorted by range, and each partition's rows are numbered from the sum of
    those before it.
    """
    taken = {c.lower() for c in symbols.columns}
    part, base = (next(x for x in (f"_{name}{k}" for k in range(len(taken) + 1)) if x not in taken) for name in ("part", "base"))
    ranged = cut(symbols.drop(*(c for c in symbols.columns if c.lower() == "node" and c not in order)).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).count().orderBy(part).collect()  # one row a partition
    before, total = [], 0
    for row in sizes:
        before.append((row[part], total))
        total += row["count"]
    starts = symbols.sparkSession.createDataFrame(before, f"{part} int, {base} long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(starts), part).withColumn("node", (F.col(base) + within - 1).cast("long")).drop(part, base)
