"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm import mixing, neardup, packing, quality, substring
from popspark.llm.common import checkpoint_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules keep: every row is judged by itself, null ids and repeated rows too."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the near duplicates of documents with a smaller id.

    Rows of one id stay or go together; rows with a null id stay, and so do texts without words."""
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that stand in a document with a smaller id; every document stays, if only with an empty text.

    A null text becomes an empty one; of a character that only partly goes all bytes stay; rows of one
    id don't take from each other; a null id counts as the largest.  Other columns come along as they are,
    whatever their names and kinds."""
    others = [f.name for f in docs.schema if f.name not in ("doc_id", "text", "n_chars")]
    out = substring.remove_repeats(docs, texts=True, extra=others)
    text = F.decode("kept", "UTF-8")
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": F.length(text).cast("long")}
    new |= substring.carried(docs, others)
    return out.select(*(new[c].alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; copies are equal rows.  Null sources are a source, null ids a key."""
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences; equal rows are packed each, a null id stays null."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

# Token identifiers and the packing have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
