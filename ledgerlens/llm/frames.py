"""Input handling and written tables shared by the operators of this package.

Inputs may carry any further columns, whatever their names: an operator takes
the columns it needs by name first, so nothing can clash with its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .kernels import Block, blocks, give_back


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(doc_id: str, modulo: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulo``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulo


def written(df: DataFrame, per_file: int = 0) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared checkpoint
    folder (``per_file``: rows of a file at most) and read it back. A lost executor loses none of it, and numbers
    given by partition or position stay what they were when written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python strings."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def map_texts(df: DataFrame, keep: list[str], compute, schema: str) -> DataFrame:
    """Rows of ``df`` with the columns ``keep`` as they are and those that
    ``compute(Block) -> {name: array}`` makes of its ``text`` column (null:
    empty). ``schema``: all columns, in that order. Arrow batches in, Arrow
    batches out; no row leaves its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for a, b, raws in blocks(texts):
                made = compute(Block(raws))
                columns = [batch.column(c).slice(a, b - a) for c in keep] + [pa.array(x) for x in made.values()]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])
        give_back()

    return df.select(*keep, "text").mapInArrow(run, schema)


KNOWN_KEYS = 500_000  # keys that are sent to all executors, at most (4 MB)


def key_list(keys: DataFrame, most: int | None = None):
    """The values of a column of longs, as a broadcast sorted array; None if there are more than ``most``
    (``KNOWN_KEYS``): what they pick out then has to be found by a join."""
    if keys.count() > (KNOWN_KEYS if most is None else most):
        return None
    return keys.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in keys.collect()), np.int64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
