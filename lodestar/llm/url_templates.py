"""URL filters (operator 2): a tree of path templates for each host, rejected by labelled purity.

1. A URL is a host and the segments of its path (query and fragment are left out). Level by level
   from the root, the tree of each host is generalised: numbers become wildcards, which keep a file's extension. So do, at
   nodes of more than `max_children` different segments, all but those with LEAST_LABELS labels or more that differ
   from their siblings' beyond chance. A level is one aggregate and one join over distinct paths; a host of any size is spread over tasks.
2. Branches that differ in one segment and agree in the rest are merged where their labels don't differ beyond
   chance (likelihood ratio, 5 %), deepest segments first. Those with fewer than LEAST_LABELS labels, which can't show it, stay alone.
3. A template's purity is its share of good pages, smoothed by `prior_weight` pages of the host's
   purity, and that in turn by as many of all hosts. Templates below `least_purity` are rejected.

Defined results
- A null or empty URL, or one without a host, has host "" and the segments of what there is; a path of only "/" has the template "/".
- Segments beyond `max_depth` are one wildcard, "**". Host names are compared in lower case.
- Pages without a label count for the tree but not for purity; without any label the purity is 1. Null labels are ignored.
- Repeated rows count as often as they occur, and are given once for a page_id and URL. Rows with a null page_id are left out of the result only.
- Ties: branches of equal purity are taken by name, and a template at `least_purity` is kept. Empty tables give empty results.
- Very long URLs are read whole; brackets, bars and backslashes in them are shown with a backslash.
- Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

MAX_CHILDREN, MAX_DEPTH, PRIOR_WEIGHT, LEAST_PURITY = 20, 12, 5.0, 0.7
CHANCE, LEAST_LABELS = 3.841, 5


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def segments_of(url: Column, max_depth: int) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#][\s\S]*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))).otherwise(parts)


def wildcard(segment: Column) -> Column:
    """What stands for a segment: a number, or anything, with its extension."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    body = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return F.concat(F.when(body.rlike(r"^[0-9]+$"), F.lit("{number}")).otherwise(F.lit("{any}")), extension)


def _g2_of(g: Column, n: Column, all_g: Column, all_n: Column) -> Column:
    """Likelihood ratio of g good ones of n having the rate of the rest of all_g of all_n."""
    term = lambda o, of, rate: F.when(o > 0, o * F.log(o / (of * rate))).otherwise(0.0)
    rate, rest = all_g / all_n, all_n - n
    good, bad = term(g, n, rate) + term(all_g - g, rest, rate), term(n - g, n, 1 - rate) + term(rest - all_g + g, rest, 1 - rate)
    return 2 * (good + bad)


def templates(paths: DataFrame, max_children: int, max_depth: int) -> DataFrame:
    """paths (host, segments, good, labelled) with the column template, an array as long as segments."""
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    number = lambda s: s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$")
    now = paths.withColumn("template", F.expr("cast(array() as array<string>)"))
    for level in range(deepest):
        here = F.get("segments", F.lit(level))
        named = now.withColumn("here", F.when(number(here) & (here != "**"), wildcard(here)).otherwise(here))
        kids = named.where("here is not null").groupBy("host", "template", "here").agg(F.sum("good").alias("g"), F.sum("labelled").alias("n"))
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("g").alias("all_g"), F.sum("n").alias("all_n")).where(F.col("children") > max_children)
        own = (F.col("n") >= LEAST_LABELS) & (_g2_of(F.col("g"), F.col("n"), F.col("all_g"), F.col("all_n")) >= CHANCE)
        wide = kids.join(nodes, ["host", "template"]).where(~F.coalesce(own, F.lit(False))).select("host", "template", "here", F.lit(True).alias("wide"))
        joined = named.join(wide, ["host", "template", "here"], "left")
        step = F.when(F.col("here").isNull(), F.array().cast("array<string>")).when(F.col("wide") & (F.col("here") != "**") & ~F.col("here").startswith("{number}"), F.array(wildcard(F.col("here")))).otherwise(F.array("here"))
        now = common.cut(joined.select("host", "segments", "good", "labelled", F.concat("template", step).alias("template")))
    return now


def _g2(a: np.ndarray, b: np.ndarray) -> float:
    """Likelihood ratio of two (good, bad) counts having one rate."""
    total = a + b
    out = 0.0
    for x in (a, b):
        expected = total * x.sum() / max(total.sum(), 1e-9)
        seen = x > 0
        out += 2 * float((x[seen] * np.log(x[seen] / expected[seen])).sum())
    return out


Segment = tuple[str, ...]  # what stands at one level: the merged segments, in order


def shown(segment: Segment) -> str:
    """A segment as text: several in brackets, with bars between them; brackets, bars and backslashes of URLs are escaped."""
    names = [re.sub(r"([\\()|])", r"\\\1", n) for n in segment]
    return names[0] if len(names) == 1 else "(" + "|".join(names) + ")"


def merge_branches(table: dict[tuple[str, ...], np.ndarray], chance: float = CHANCE) -> dict[tuple[str, ...], tuple[Segment, ...]]:
    """The template that each of one host's templates (with good and bad counts) is merged into.

    Templates have at most one parent a level, so following a template's parents to the end takes no more steps than levels.
    """
    whole = lambda t: tuple((s,) for s in t)
    counts = {whole(t): np.asarray(c, float) for t, c in table.items()}
    parent: dict[tuple[Segment, ...], tuple[Segment, ...]] = {}
    for level in range(max((len(t) for t in table), default=0) - 1, -1, -1):
        families: dict[tuple, list[tuple[Segment, ...]]] = {}
        for t in sorted(counts):
            if len(t) > level and counts[t].sum() >= LEAST_LABELS:
                families.setdefault((t[:level], t[level + 1 :]), []).append(t)
        for (head, tail), branches in sorted(families.items()):
            # By purity, so that only neighbours need comparing.
            branches.sort(key=lambda t: ((counts[t][0] + 1) / (counts[t].sum() + 2), t))
            groups: list[tuple[list, np.ndarray]] = []
            for t in branches:
                if groups and _g2(groups[-1][1], counts[t]) < chance:
                    groups[-1] = ([*groups[-1][0], t], groups[-1][1] + counts[t])
                else:
                    groups.append(([t], counts[t]))
            for members, total in groups:
                if len(members) < 2:
                    continue
                merged = (*head, tuple(sorted({n for t in members for n in t[level]})), *tail)
                for t in members:
                    counts.pop(t)
                    parent[t] = merged
                counts[merged] = total

    def end(t: tuple[Segment, ...]) -> tuple[Segment, ...]:
        while t in parent:
            t = parent[t]
        return t

    return {t: end(whole(t)) for t in table}


def judge(pages: DataFrame, labels: DataFrame, max_children: int = MAX_CHILDREN, max_depth: int = MAX_DEPTH, prior_weight: float = PRIOR_WEIGHT, least_purity: float = LEAST_PURITY) -> DataFrame:
    """(page_id, url, host, template, labelled, purity, rejected) of each page. labels: (url, good), of any number of pages."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parsed = base.select("page_id", "url", host_of(F.col("url")).alias("host"), segments_of(F.col("url"), max_depth).alias("segments"))
    known = labels.select(F.col("url").cast("string").alias("url"), F.col("good").cast("int").alias("good")).where("good is not null")
    known = known.select(host_of(F.col("url")).alias("host"), segments_of(F.col("url"), max_depth).alias("segments"), F.when(F.col("good") > 0, 1).otherwise(0).alias("good"))
    marks = known.groupBy("host", "segments").agg(F.sum("good").alias("good"), F.count("*").alias("labelled"))
    paths = parsed.select("host", "segments").distinct().join(marks, ["host", "segments"], "left").fillna(0, ["good", "labelled"])
    tree = templates(paths, max_children, max_depth)
    leaves = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        table = {tuple(t): np.array([g, n - g], float) for t, g, n in zip(pdf.template, pdf.good, pdf.labelled, strict=True)}
        to = merge_branches(table)
        return pd.DataFrame({"host": pdf.host, "template": pdf.template, "shown": ["/" + "/".join(map(shown, to[tuple(t)])) for t in pdf.template], "good": pdf.good, "labelled": pdf.labelled})

    # Only templates with labels enough to be told apart are merged, so a host's task holds no more than its labels allow.
    form = "host string, template array<string>, shown string, good long, labelled long"
    some = leaves.where(F.col("labelled") >= LEAST_LABELS).groupBy("host").applyInPandas(merge, form)
    one = F.transform("template", lambda x: F.regexp_replace(x, r"([\\()|])", r"\\$1"))
    rest = leaves.where(F.col("labelled") < LEAST_LABELS).select("host", "template", F.concat(F.lit("/"), F.array_join(one, "/")).alias("shown"), "good", "labelled")
    merged = common.cut(some.unionByName(rest))
    per = merged.groupBy("host", "shown").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    hosts = per.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hn"))
    every = hosts.agg(F.sum("hg"), F.sum("hn")).first()
    rate = float(every[0] / every[1]) if every[1] else 1.0
    host_rate = (F.col("hg") + prior_weight * rate) / (F.col("hn") + prior_weight)
    per = per.join(hosts, "host").select("host", "shown", "labelled", ((F.col("good") + prior_weight * host_rate) / (F.col("labelled") + prior_weight)).alias("purity"))
    verdict = tree.drop("good", "labelled").join(merged.select("host", "template", "shown"), ["host", "template"]).join(per, ["host", "shown"]).select("host", "segments", "shown", "labelled", "purity")
    out = parsed.where("page_id is not null").distinct().join(verdict, ["host", "segments"])
    return out.select("page_id", "url", "host", F.col("shown").alias("template"), "labelled", F.round("purity", 6).alias("purity"), (F.col("purity") < least_purity).alias("rejected"))
