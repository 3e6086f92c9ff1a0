"""BM25 over a table of documents.

A row is a document. One pass reads the texts, and keeps of each its length and how often it has each
of the query's terms; the corpus' numbers and the scores come from these small rows.

Defined results: null and empty texts have no words, count as documents, and match nothing; rows that repeat a
key are documents of their own; an empty table or a query without words gives no row; equal scores go by key.
Columns of the table other than the key and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.functions.text import tokens, words
from lodestar.session import cut

K1, B = 1.2, 0.75


def term_frequency(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf); the rows of one key are counted together.

    A row's terms are counted in place, and only rows whose key another has, which are looked for first, are
    shuffled: by term, as counts.
    """
    several = docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key"))
    each = docs.select(F.col(key), words(text).alias("w"))
    if several.isEmpty():
        return _counted(each, key)
    same = F.col(key).eqNullSafe(F.col("_key"))
    shared = _counted(each.join(several, same, "left_semi"), key).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return _counted(each.join(several, same, "left_anti"), key).unionByName(shared)


def _counted(each: DataFrame, key: str, most: int = 4 << 20) -> DataFrame:
    """(key, term, tf) of each row (key, w) by itself, of about `most` bytes of words at a time, or one row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = 0, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes.astype(np.int64))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                yield count(batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at))
                at = stop

    def count(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        lists = pc.split_pattern(texts, " ")
        terms, row = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        n = len(terms.dictionary)
        found, tf = np.unique(row.astype(np.int64) * n + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
        term = terms.dictionary.take(pa.array(found % max(n, 1)))
        out = pa.RecordBatch.from_arrays([keys.take(pa.array(found // max(n, 1))), term, pa.array(tf.astype(np.int64))], names=[key, "term", "tf"])
        return out.filter(pc.not_equal(term, ""))  # of texts without words

    return each.mapInArrow(run, StructType([each.schema[key], StructField("term", StringType()), StructField("tf", LongType())]))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, df, idf). A document's terms are made distinct in place, so that only counts by term are shuffled."""
    n = docs.agg(F.count("*").alias("n"))
    counts = docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n, avgdl) of documents (dl); the mean length is 1 at least."""
    return lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, dl)"""
    return docs.select(F.col(key), F.size(tokens(text)).alias("dl"))


def search(docs: DataFrame, key: str, text: Column, query: str, k: int) -> DataFrame:
    """(key, score) of the k best documents; a term that the query repeats counts again; ties go to the lesser key."""
    spark = docs.sparkSession
    words = spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q"))).first()[0]
    if not words or k < 1:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    terms = sorted(set(words))
    # What is left after all of a term's occurrences are removed tells their number, without a function over items.
    left = F.size("w")
    each = docs.select(F.col(key).alias("key"), tokens(text).alias("w")).select("key", left.cast("long").alias("dl"), *((left - F.size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    # Written once: a filter on the frequencies would otherwise move below, and split the texts again for each term.
    each = cut(each)
    stats = each.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f = F.col(f"tf{i}")
        part = idf(F.col(f"df{i}"), F.col("n")) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        score = score + F.when(f > 0, part * words.count(t)).otherwise(0.0)
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    found = each.where(hit).crossJoin(F.broadcast(stats)).select(F.col("key").alias(key), score.alias("score"))
    return found.where("score > 0").orderBy(F.desc("score"), key).limit(k)
