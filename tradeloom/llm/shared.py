"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words are runs of anything but the six ASCII blanks, in Java and SQL regex notation.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(divisor), F.lit(-1).cast("bigint"))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(array: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``size`` bytes in each slice; every row is kept."""
    for batch in batches:
        values = batch.column(column)
        step = max(1, int(batch.num_rows * size / max(size, values.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of jobs run within have at most ``rows`` rows, so that whole texts take little memory outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def bounded_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of jobs run within hold about ``size`` bytes, one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row, position of each text's first word and of the end); null texts have none.

    Blanks at the ends of a text leave empty words there, which stand for nothing.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
