"""A keyed table kept by a stream, by day: readers of a time range open its days only.

``live/day=D/batch_id=N`` holds the rows of day D that batch N changed.  A batch
overwrites its own folders, so a repeated one changes nothing.  Once the stream has
moved on, a day is closed: its newest row per key goes to ``closed/day=D/batch_id=N``
under the last batch number it had, then the folders it came from are removed.  A
reader takes the newest batch per key from both places, so what it sees is the same
before, during and after that step, and a step that was cut short is simply done
again.  A row that comes after its day was closed opens it again.
"""

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.streaming import events as stream

FOLDER = re.compile(r"/(live|closed)/day=(\d{4}-\d\d-\d\d)/batch_id=(\d+)$")


class Folders:
    """The folders of a table in whatever file system it lies."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm, self.table = spark.sparkContext._jvm, table
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for place in ("live", "closed"):
            self.fs.mkdirs(self.path(f"/{place}"))

    def path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.table + below)

    def batches(self) -> list[tuple[str, date, int]]:
        """(place, day, batch) of every folder, from the names alone."""
        found = self.fs.globStatus(self.path("/*/day=*/batch_id=*")) or []
        names = (FOLDER.search(str(status.getPath())) for status in found)
        return sorted((m[1], date.fromisoformat(m[2]), int(m[3])) for m in names if m)

    def remove(self, place: str, day: date, batch: int) -> None:
        self.fs.delete(self.path(f"/{place}/day={day}/batch_id={batch}"), True)


def _read(spark: SparkSession, table: str, schema: T.StructType, place: str) -> DataFrame:
    keyed = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(keyed).option("basePath", f"{table}/{place}").parquet(f"{table}/{place}")


def newest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per day and key the values of the newest batch."""
    best = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return rows.groupBy("day", *keys).agg(best).select("day", *keys, "_v.*")


def close_days(spark: SparkSession, table: str, schema: T.StructType, keys: list[str], before: date) -> list[date]:
    """Bring days before a date down to one folder each; returns those that were."""
    folders = Folders(spark, table)
    by_day: dict[date, list[tuple[str, int]]] = {}
    for place, day, batch in folders.batches():
        if day < before:
            by_day.setdefault(day, []).append((place, batch))
    todo = {day: parts for day, parts in sorted(by_day.items()) if len(parts) > 1 or parts[0][0] == "live"}
    last = {day: max(batch for _, batch in parts) for day, parts in todo.items()}
    values = [f.name for f in schema.fields if f.name not in keys]
    live, old = (_read(spark, table, schema, place) for place in ("live", "closed"))

    first = [day for day, parts in todo.items() if all(place == "live" for place, _ in parts)]
    if first:
        rows = newest(live.where(F.col("day").isin(first)), keys, values)
        number = F.create_map(*(F.lit(x) for day in first for x in (day, last[day])))[F.col("day")]
        writer = rows.withColumn("batch_id", number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch_id").parquet(f"{table}/closed")
    for day, parts in todo.items():
        if day not in first and ("closed", last[day]) not in parts:  # a late row has opened it again
            rows = newest(live.unionByName(old).where(F.col("day") == F.lit(day)), keys, values).drop("day")
            rows.write.mode("overwrite").parquet(f"{table}/closed/day={day}/batch_id={last[day]}")
        for place, batch in parts:
            if (place, batch) != ("closed", last[day]):
                folders.remove(place, day, batch)
    return list(todo)


def daily_sink(
    changes: DataFrame, table: str, checkpoint: str, time: str, keys: list[str], open_days: int = 1, trigger: dict | None = None
):
    """Start writing an update-mode aggregate as a table by the day of ``time``.

    Days more than ``open_days`` before the newest one are closed after each
    batch; the watermark's delay has to fit into that.
    """
    schema = changes.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folders = Folders(spark, table)
        placed = batch.withColumn("day", F.to_date(time)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch_id").parquet(f"{table}/live")
        days = [day for _, day, _ in folders.batches()]
        if days:
            close_days(spark, table, schema, keys, max(days) - timedelta(days=open_days))

    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_daily(
    spark: SparkSession, table: str, schema: T.StructType, keys: list[str], time: str,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Current rows with start <= time <= end; the bounds also choose the day folders."""
    rows = _read(spark, table, schema, "live").unionByName(_read(spark, table, schema, "closed"))
    if start is not None:
        rows = rows.where((F.col("day") >= F.lit(start.date())) & (F.col(time) >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("day") <= F.lit(end.date())) & (F.col(time) <= F.lit(end)))
    values = [f.name for f in schema.fields if f.name not in keys]
    return newest(rows, keys, values).select(*schema.names)


MINUTES = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
        T.StructField("page", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("count", T.LongType()),
    ]
)


def run_daily_minutes(messages: DataFrame, table: str, checkpoint: str, delay: str = "10 minutes", open_days: int = 1):
    """Messages to the minute table by day: decode, validate, drop repeats, count, upsert."""
    counts = stream.minute_counts(stream.accepted(stream.decode(messages), delay), delay=None)
    return daily_sink(counts, table, checkpoint, "window_start", stream.MINUTE_KEYS, open_days)


def read_daily_minutes(spark: SparkSession, table: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of the minute table whose minute begins in the range."""
    return read_daily(spark, table, MINUTES, stream.MINUTE_KEYS, "window_start", start, end)
