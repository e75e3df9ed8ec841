"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next stage's ``docs``. All but the last return
rows of ``documents`` with its columns:

1. quality rules: documents that the rules reject go;
2. line dedup: later copies of repeated line runs are deleted from the texts,
   and documents of which no word is left go;
3. SimHash near-dedup: of each group of near copies the smallest id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: the pieces of the remaining documents, as sequences.

Nulls, empty tables and clashing further columns: see the operators. The
classifier of stage 1 and the genetic search of stage 5 have no SQL form, so
``ORACLE_SQL`` is None; the tests hold the pipeline against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, line_dedup, pack, quality_rules, simhash
from ledgerlens.llm.frames import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.delete_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", delete_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_items),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
