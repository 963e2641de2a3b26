"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Null or repeated document numbers, null and empty texts and further columns are kept as
each stage's docstring says; an empty table goes through all stages.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reportloom.llm import chosen_path, credentials, decision_list, packing, pivotal
from reportloom.llm.common import n_words, stored, table


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number in __row that every reading of them agrees on.

    A stored table gets it from the places of its rows, the number of their file above
    their place in it, so that it is not stored once more. Any other table is stored.
    """
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            placed = docs.select(
                "*",
                F.col("_metadata.file_path").alias("__file"),
                F.col("_metadata.row_index").alias("__at"),
            )
        except AnalysisException:
            placed = None
        if placed is not None:
            # One row per file, so the window over all of them is small.
            files = placed.select("__file").distinct()
            number = F.row_number().over(Window.orderBy("__file")).cast("long")
            files = files.select("__file", number.alias("__number"))
            row = F.shiftleft("__number", 40).bitwiseOR(F.col("__at"))
            return placed.join(F.broadcast(files), "__file").select(*docs.columns, row.alias("__row"))
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep, texts unchanged."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__whole"))
    judged = decision_list.judge_by_labels(rows, table(spark, sf_dir, "labels"))
    return judged.where("kept").select("__whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 80 percent of its shingles of five words.

    It is the one with the smallest number, then the first one stored; rows without number
    come last. Rows are linked by their texts alone, so rows with the same number, or with
    none, stay if their texts differ.
    """
    rows = numbered(docs, "near-documents")
    found = chosen_path.near_duplicates(rows.select("__row", "text"), document="__row")
    groups = found.select("__row", "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    kept = (
        groups.join(rows.select("__row", "doc_id"), "__row")
        .groupBy("component_id")
        .agg(F.min(place).alias("first"))
        .select("first.__row")
    )
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials masked, n_chars renewed."""
    clean = credentials.redact(docs)
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length)
    ).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    rows = numbered(docs, "mix-documents")
    sizes = rows.select("__row", "source", n_words(F.col("text")).alias("size"))
    copies = pivotal.mix(sizes, document="__row").select("__row", "copies").where("copies > 0")
    taken = rows.join(copies, "__row")
    return taken.withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, in sequences of up to 1024 tokens."""
    encoder = partial(
        packing.byte_bpe_encoder,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.pack(docs, encoder)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("packing", packed),
]

# SQL expresses neither the trees of the second stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
