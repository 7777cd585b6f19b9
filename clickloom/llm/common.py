"""Shared pieces of the text operators."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import shared_dir

#: Rows of text per slice inside a task, and the bytes at which a slice is cut sooner.
SLICE_ROWS, SLICE_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, prefix: str, **options: str) -> DataFrame:
    """`df` written to the shared folder, with options of the writer, and read back: computed once, lineage cut."""
    path = shared_dir(df.sparkSession, prefix)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The setting for the rows that Python gets at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_rows(spark: SparkSession, rows: int = SLICE_ROWS) -> str:
    """From now on Python gets `rows` rows at a time at most: a batch of long rows stands in the JVM and in Python.

    Returns the setting before.  Spark reads it when a plan runs, so it has to stay for results that the caller writes.
    """
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    return before


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = SLICE_ROWS):
    """`limit_rows` for what runs inside."""
    before = limit_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def as_bytes(col: str) -> Column:
    """Text as UTF-8 bytes; null stays null."""
    return F.col(f"`{col}`").cast("string").cast("binary")


def slices(batches: Iterator[pa.RecordBatch], text: str = "_text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and, rows permitting, few bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def over_texts(df: DataFrame, text: str, keep: list[str], run: Callable, schema: str) -> DataFrame:
    """Map `run` over slices of (kept columns, `_text` as bytes); it yields record batches of `schema`.

    If the text is kept, it goes to Python once: there the kept column is a view of `_text`.
    """
    once = text in keep and kind(df, text) == "string"
    chosen = df.select(*[F.col(f"`{c}`") for c in keep if not (once and c == text)], as_bytes(text).alias("_text"))

    def viewed(batch):
        own = batch.column("_text")
        own = own.view(pa.large_string() if pa.types.is_large_binary(own.type) else pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, text])

    def task(batches):
        yield from run(map(viewed, slices(batches)) if once else slices(batches))

    return chosen.mapInArrow(task, schema)


#: Bits of a bitmap.
BITS = 1 << 26


def bitmap(spots: DataFrame, size: int = BITS) -> bytes:
    """A bitmap of `size` bits with those in column `h` (0 to size - 1) set: 8 MB by default, whatever the input.

    It only keeps rows without a partner out of a shuffle; a full one lets all pass.
    """
    words = (
        spots.groupBy(F.shiftright("h", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
        .toPandas()
    )
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.tobytes()


def kind(df: DataFrame, col: str) -> str:
    """The SQL type of a column."""
    return df.schema[col].dataType.simpleString()


def word_table(keep: bytes) -> bytes:
    """A bytes.translate table: A-Z to a-z, bytes of `keep` as they are, all others to a space."""
    out = bytearray(b" " * 256)
    for b in keep:
        out[b] = b
    for b in range(65, 91):
        out[b] = b + 32
    return bytes(out)


#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z, and all of UTF-8 beyond ASCII.
PLAIN_WORDS = word_table(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: Lower-cases A-Z and changes nothing else; bytes.split() then cuts at [\x20\x09-\x0D].
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
