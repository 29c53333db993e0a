"""The corpus pipeline: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents; a runner writes
each result and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import decontaminate, mixing, ngram_join, pii, quality
from rookery.llm.exchange import scratch, shared_dir
from rookery.llm.queries import MIX, MIX_WEIGHTS, QUALITY_ROWS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by itself over its whole text, so repeated rows fare
    alike and null ids stay. Null and empty texts are rejected. An empty table
    stays empty; without labels every document with a text is accepted. Other
    columns pass through, whatever their names.
    """
    model, _ = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_ROWS)
    return quality.keep_accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The one of the least (id, text hash) stays, null ids last, so ties can't
    differ from run to run; of rows equal in id and text one stays. Rows of
    null or wordless text all stay. An empty table stays empty, other columns
    pass through, whatever their names.
    """
    return ngram_join.keep_one(docs, n=5, threshold=0.5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null, empty and wordless texts and items match nothing; repeated rows fare
    alike, null ids are like any other. Empty tables of documents or items
    leave the documents as they are. Other columns pass through.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without identifiers and words that give them away.

    All rows stay; n_chars follows the text. Null and empty texts stay as they
    are, rows equal in id and text share their verdict, words that tie with a
    threshold tell. An empty table stays empty, other columns pass through.
    """
    return pii.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, with the epoch of each repetition.

    The null source is one like any other; null and negative sizes count as 0;
    rows of one id fare alike, null ids too. A column `epoch` is replaced, other
    columns pass through. An empty table stays empty.
    """
    return mixing.mix(docs, MIX_WEIGHTS, **MIX)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The classifier is trained by gradient descent and the near duplicates need whole n-gram sets: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; what a stage wrote on its way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
