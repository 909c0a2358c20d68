"""A training corpus from ``documents``, in stages.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``. A stage's files go once the next one is written.

Defined results, at every stage: texts that are null or have no letter go with
the first; a null doc_id is a document of its own name, exact copies of which are
one, and has no near copies; a null source is a source; repeated rows are exact
copies; further columns, of whatever name, are carried on; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import delete_folder, release
from proofline.llm.exact_dedup import drop_duplicates
from proofline.llm.files import output_dir
from proofline.llm.langid import UNDETERMINED, fit, identify
from proofline.llm.mixing import mix
from proofline.llm.near_dedup import drop_near_duplicates
from proofline.llm.packing import pack, token_pieces


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told go: null ones and those without a letter."""
    return identify(docs, fit(docs)).filter(F.col("lang_pred") != UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null one if there is no other."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near copies the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of heavy sources repeat, as their targets ask."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place; repeats are packed each."""
    return pack(token_pieces(docs))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = output_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        release(spark)
        if k:
            delete_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: Language identification and token ids are beyond SQL.
ORACLE_SQL = None
