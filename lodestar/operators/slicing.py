"""Retention levels under a token budget: 3 full, 2 skeleton, 1 signatures, 0 omitted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = {3: "full", 2: "skeleton", 1: "signature", 0: "omitted"}
UNBOUNDED = (1 << 63) - 1


def build_plans(files: DataFrame) -> DataFrame:
    """files (file_id, token_count, n_symbols[, skeleton_tokens, importance, is_hub]) with the costs of the levels."""
    have = files.columns
    half = F.floor(F.col("token_count") / 2).cast("long")
    return files.select(
        "file_id",
        F.col("token_count").cast("long").alias("full_tokens"),
        (F.coalesce("skeleton_tokens", half) if "skeleton_tokens" in have else half).alias("skeleton_tokens"),
        (5 + 5 * F.col("n_symbols")).cast("long").alias("signature_tokens"),
        (F.col("importance") if "importance" in have else F.lit(0.0)).alias("importance"),
        (F.col("is_hub") if "is_hub" in have else F.lit(False)).alias("is_hub"),
    )


def density(importance: Column, full: Column) -> Column:
    """Importance a token; a file without tokens comes first."""
    return F.when(full == 0, F.lit(float("inf"))).otherwise(importance / F.when(full != 0, full))


def cost(level: Column, full: Column, skeleton: Column, signature: Column) -> Column:
    return F.when(level == 3, full).when(level == 2, skeleton).when(level == 1, signature).otherwise(F.lit(0).cast("long"))


def allocate(plans: DataFrame, budget: int = UNBOUNDED) -> DataFrame:
    """(file_id, level): one greedy pass by value density, from each plan's initial `level` down to what still fits.

    Hubs stop at skeletons even where these don't fit, and one that starts lower is raised to it. Without a column
    `level` all start at 3. Ties go by file_id; null costs and importances are 0, a null level is 0, a null
    is_hub is false; rows that repeat a file_id are plans of their own. What a plan may spend depends on all before it, so the
    pass is one task over the sorted plans, a few numbers a file and in time in proportion to their number; the
    task holds a batch of them at a time.
    """
    first = F.col("level") if "level" in plans.columns else F.lit(3)
    if budget <= 0:
        return plans.select("file_id", F.lit(0).alias("level"))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    full = number("full_tokens")
    rows = plans.select("file_id", (-density(F.coalesce("importance", F.lit(0.0)), full)).alias("k"), full.alias("f"), number("skeleton_tokens").alias("s"), number("signature_tokens").alias("g"), F.coalesce("is_hub", F.lit(False)).alias("h"), F.coalesce(first.cast("int"), F.lit(0)).alias("i"))

    def run(batches):
        left = budget
        for pdf in batches:
            levels = []
            for f, s, g, h, i in zip(*(pdf[c].tolist() for c in ("f", "s", "g", "h", "i")), strict=True):
                if i >= 3 and f <= left:
                    level, spent = 3, f
                elif (i >= 2 and (s <= left or h)) or (h and not (i >= 1 and g <= left)):
                    level, spent = 2, s
                elif i >= 1 and g <= left:
                    level, spent = 1, g
                else:
                    level, spent = 0, 0
                left = max(left - spent, 0)
                levels.append(level)
            yield pd.DataFrame({"file_id": pdf["file_id"], "level": levels})

    id_type = plans.schema["file_id"].dataType.simpleString()
    return rows.repartition(1).sortWithinPartitions("k", "file_id").mapInPandas(run, f"file_id {id_type}, level int")
