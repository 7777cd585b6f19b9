"""The Parquet lake: hourly partitions, export, compaction, results, caching."""

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("year", "month", "day", "hour")


def with_partitions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add year/month/day/hour taken from the event time."""
    time = F.col(ts)
    return df.withColumns(
        {
            "year": F.year(time),
            "month": F.month(time),
            "day": F.dayofmonth(time),
            "hour": F.hour(time),
        }
    )


def write_lake(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by: Sequence[str] = PARTITIONS,
    max_records_per_file: int = 1_000_000,
) -> None:
    """Partitioned snappy Parquet.

    Rows are clustered on the partition columns before the write.  The
    rebalance hint lets AQE split a partition that holds much of the data over
    several tasks and merge small ones, so no partition value is written by
    one task alone.
    """
    keys = [F.col(c) for c in partition_by]
    clustered = df.hint("rebalance", *keys) if keys else df
    (
        clustered.write.mode(mode)
        .partitionBy(*partition_by)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(path)
    )


def read_lake(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    columns: Sequence[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Lake rows with start <= ts < end.

    The bound is also stated on the partition columns, as one number per hour,
    so folders outside it are pruned before any file is opened.
    """
    df = spark.read.parquet(path)
    hour_key = (
        (F.col("year") * 100 + F.col("month")) * 100 + F.col("day")
    ) * 100 + F.col("hour")
    if start is not None:
        df = df.where((hour_key >= int(start.strftime("%Y%m%d%H"))) & (F.col(ts) >= F.lit(start)))
    if end is not None:
        df = df.where((hour_key <= int(end.strftime("%Y%m%d%H"))) & (F.col(ts) < F.lit(end)))
    return df.select(*columns) if columns else df


def export_recent(df: DataFrame, path: str, as_of: datetime, hours: int, ts: str = "ts") -> None:
    """Append the last ``hours`` of a table to the lake, partitioned by event time."""
    recent = df.where(
        (F.col(ts) >= F.lit(as_of - timedelta(hours=hours))) & (F.col(ts) < F.lit(as_of))
    )
    write_lake(with_partitions(recent, ts), path)


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    partition_by: Sequence[str] = PARTITIONS,
    max_records_per_file: int = 1_000_000,
) -> None:
    """Rewrite a lake with fewer, larger files into a new folder.

    Plain Parquet has no transaction log, so the caller swaps the folders.
    """
    write_lake(spark.read.parquet(source), target, "overwrite", partition_by, max_records_per_file)


def census(spark: SparkSession, path: str, partition_by: Sequence[str] = PARTITIONS) -> DataFrame:
    """(partition columns, files, bytes) of a lake; only footers are read."""
    files = spark.read.parquet(path).select(*partition_by, "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy(*partition_by).agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def pack_small_files(
    spark: SparkSession, path: str, target_bytes: int = 128 << 20, partition_by: Sequence[str] = PARTITIONS
) -> int:
    """Rewrite, in place, the partitions with more files than their bytes need; returns how many there were.

    The rows of such a partition are dealt over as many files as `target_bytes`
    asks for, so one large partition is written by several tasks.  New folders
    are made beside the table and then take the places of the old ones, which are
    kept under the hidden folder until all have moved; a run that was cut short
    before that leaves the table as it was.  Run it while nothing writes to the
    table.
    """
    needed = F.ceil(F.col("bytes") / target_bytes).cast("int")
    plan = census(spark, path, partition_by).where(F.col("files") > needed).select(*partition_by, needed.alias("_files"))
    stage = f"{path}/.packing-{uuid.uuid4().hex}"
    plan.write.parquet(f"{stage}/plan")
    plan = spark.read.parquet(f"{stage}/plan")
    rewritten = plan.count()
    fs, at = _file_system(spark, path)
    if rewritten:
        rows = spark.read.parquet(path)
        columns = rows.columns
        dealt = rows.join(plan, list(partition_by)).withColumn("_file", F.pmod(F.xxhash64(*columns), F.col("_files")))
        # A row's file follows from the row, so a task that runs again writes the same rows.
        written = dealt.repartition(*partition_by, "_file").select(*columns)
        written.write.partitionBy(*partition_by).option("compression", "snappy").parquet(f"{stage}/new")
        new = at(f"{stage}/new")
        for status in fs.globStatus(at(f"{stage}/new" + "/*=*" * len(partition_by))):
            below = status.getPath().toString()[len(fs.makeQualified(new).toString()) :]
            fs.mkdirs(at(f"{stage}/old{below}").getParent())
            fs.rename(at(path + below), at(f"{stage}/old{below}"))
            fs.rename(at(f"{stage}/new{below}"), at(path + below))
    fs.delete(at(stage), True)
    return rewritten


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_results(results: dict[str, DataFrame], path: str, fmt: str = "json") -> dict[str, str]:
    """One folder per result table; returns the error text of each table that failed."""
    errors: dict[str, str] = {}
    for name, df in results.items():
        try:
            df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
        except Exception as error:  # one broken table must not stop the report
            errors[name] = str(error).splitlines()[0]
    return errors


def keep(df: DataFrame) -> DataFrame:
    """Persist a prepared table that several operators read; spills to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
