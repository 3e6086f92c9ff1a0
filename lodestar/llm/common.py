"""What the operators share: checkpoints, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.text import mix


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) is a temporary folder set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, most_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches regrouped so that a piece has about `most` bytes of text in `column`, and at most `most_rows`.

    Batches are joined as well as split: a kernel that works on arrays wants neither few
    rows nor more than fits in memory. A single longer text is a piece of its own.
    """
    held, size, count = [], 0, 0

    def flush() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, before + most - size, side="right")), at + (not held))
            stop = min(stop, at + most_rows - count)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1] - before)
                count += stop - at
                at = stop
            if at < batch.num_rows or size >= most or count >= most_rows:
                yield flush()
                held, size, count = [], 0, 0
    if held:
        yield flush()


def rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def longs(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as int64 (nulls, which callers mask, become 0)."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def nonnull(column: pa.Array) -> np.ndarray:
    return pc.is_valid(column).to_numpy(zero_copy_only=False)


def map_arrow(df: DataFrame, kernel: Callable, schema: pa.Schema, text: int = 1, most: int = 4 << 20) -> DataFrame:
    """kernel: RecordBatch -> RecordBatch of schema, over pieces of df by the text column."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, most):
            yield kernel(piece)

    return df.mapInArrow(run, from_arrow_schema(schema))


def training_windows(texts: DataFrame, most: int, windows: int, width: int) -> list[tuple[str, bytes]]:
    """(label, window) of texts (label, text), in order: `windows` runs of `width` bytes of each text of a sample, at hashed
    places of the whole text. A shorter text gives itself, once.

    The sample has, of each label, the `most` distinct texts with the least hashes; so copies of a text count once, and
    a rare label isn't crowded out. Tasks keep their least hashes; then the largest hash in the sample of each label is
    known, and only the windows of texts up to that are sent: most * windows * width bytes a label, whatever the input.
    Null labels and null or empty texts are ignored.
    """
    keyed = texts.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label is not null and octet_length(text) > 0")
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    schema = pa.schema([("label", pa.string()), ("h", pa.int64())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            which, h = names.indices.to_numpy(), longs(batch.column(1))
            for k, name in enumerate(names.dictionary.to_pylist()):
                held[name] = np.unique(np.concatenate((held.get(name, h[:0]), h[which == k])))[:most]
        for name, h in held.items():
            yield rows([[name] * len(h), h], schema)

    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    last = keyed.select("label", "h").mapInArrow(least, "label string, h long").distinct().withColumn("k", place).where(F.col("k") <= most).groupBy("label").agg(F.max("h").alias("last"))
    chosen = keyed.join(F.broadcast(cut(last)), "label").where("h <= last").select("label", "text", "h")
    out = pa.schema([("label", pa.string()), ("h", pa.int64()), ("k", pa.int32()), ("window", pa.binary())])

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        for label, text, h in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            data = text.encode()
            room = len(data) - width
            for k in range(windows if room > 0 else 1):
                at = int(mix(np.array([h + k], np.int64))[0] % np.uint64(room + 1)) if room > 0 else 0
                found.append((label, h, k, data[at : at + width]))
        return rows(list(zip(*found, strict=True)) or [[]] * 4, out)

    got = map_arrow(chosen, draw, out).groupBy("label", "h", "k").agg(F.min("window").alias("window")).toArrow().to_pydict()
    return [(label, window) for label, _, _, window in sorted(zip(*got.values(), strict=True))]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n vertices that a chain of edges (a, b) leads to from each."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before, root)  # what was the root of a tree moves with it
        root = root[root]
        if (root == before).all():
            break
    return root


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds (Kiverius et al., 2014): every round halves
    chains, and no vertex gathers its neighbours in one task's memory beyond a min aggregate.
    Null ends and self loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(both: DataFrame, small: bool) -> DataFrame:
        # u's neighbours (and u) hang on the least of them; small: only those at most u
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("m", "u"))
        out = both.join(least, "u")
        if small:
            hung = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            hung = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.where("u <> v").distinct()

    def seal(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    was = seal(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, small=False)
        e = cut(star(large, small=True))
        now = seal(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
