"""Documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next. All stages but the last return the columns of documents; the last adds rate
and copies.

1. toxicity: rows that the induced lexicon rejects go.
2. near_duplicates: one document of each group of similar ones stays, that of the least doc_id.
3. decontamination: documents that hold a passage of the benchmark go.
4. personal_data: spans are replaced by their kind; all rows stay.
5. mixing: rates that bring the domains' expected words to their weights; rows of rate 0 go.

Defined results
- Null and empty texts, and rows with a null doc_id, pass the first four stages; null and empty texts have rate 1. A row with
  a null doc_id is judged by its text alone, so it has no near duplicate.
- Rows that repeat a doc_id stay or go together in stage 2, and are judged one by one elsewhere.
- Very long texts are read whole. Of similar documents the least doc_id stays, whatever their similarity.
- Empty tables of documents, labels or benchmark items give empty results or stages that keep all rows.
- Extra columns of documents are kept, but for those named rate and copies, which the last stage replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, decontamination, jaccard, mixing, pii, toxicity
from lodestar.llm.queries import read


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What they write goes to the folder that holds the checkpoints; each stage's
    rows are deleted when those of the next are written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(at), at
    return docs
