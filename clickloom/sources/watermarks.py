"""Incremental loads: a small table with the last processed time per module.

Every update appends a row, and readers take the newest.  So a lost executor
or a repeated write never leaves the state half replaced.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType(
    [
        T.StructField("module", T.StringType()),
        T.StructField("last_ts", T.TimestampType()),
    ]
)


def read_watermarks(spark: SparkSession, path: str) -> DataFrame:
    """Newest mark per module; empty when nothing was processed yet."""
    try:
        marks = spark.read.schema(STATE).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        marks = spark.createDataFrame([], STATE)
    return marks.groupBy("module").agg(F.max("last_ts").alias("last_ts"))


def unprocessed(events: DataFrame, marks: DataFrame, module: str, ts: str = "ts") -> DataFrame:
    """Events later than the module's mark; all of them when it has none."""
    mark = marks.where(F.col("module") == module).agg(F.max("last_ts")).scalar()
    return events.where(mark.isNull() | (F.col(ts) > mark))


def advance(events: DataFrame, path: str, module: str, ts: str = "ts") -> None:
    """Append the new mark; call after the module's own output is safe."""
    mark = events.agg(F.max(ts).alias("last_ts")).where(F.col("last_ts").isNotNull())
    mark.select(F.lit(module).alias("module"), "last_ts").write.mode("append").parquet(path)
