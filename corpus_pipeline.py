"""From raw documents to packed training sequences, as stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.llm._shared import release, stash, without_ids
from terralode.llm.decontaminate import find_leaks
from terralode.llm.langid import UNKNOWN, held_out, identify_language, learn_profiles
from terralode.llm.neardup import near_duplicates
from terralode.llm.packing import pack_documents
from terralode.llm.substrings import remove_repeated_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language scores less than this are rejected: noise scores below it, prose of any length above.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those like no learned language."""
    judged = identify_language(docs, learn_profiles(docs.where(~held_out())), COLUMNS)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates: five-word shingles, 0.8."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return without_ids(docs, dropped, "doc_id").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that stand in an earlier document; texts without any stay as they are, and
    documents of which nothing is left go."""
    out = remove_repeated_passages(docs, keep=("lang", "source"), as_is=True).where("n_removed = 0 or n_removed < n_words")
    return out.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return without_ids(docs, leaks, "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language), ("near duplicates", near_duplicate), ("repeated passages", repeated_passages), ("decontamination", decontaminated), ("packing", packed),
]
#: The stages as a whole are beyond SQL: rank-order profiles, connected components and a tokenizer's vocabulary. The
#: tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Each stage's table is written in the shared folder, and deleted once the next is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    *early, (_, last) = STAGES
    for name, stage in early:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(*before)
        before = [docs]
    return last(spark, docs, sf_dir)
