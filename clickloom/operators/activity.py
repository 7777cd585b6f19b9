"""Counts over time: histograms, trends, minute totals."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import percent
from clickloom.operators.kpis import between


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per calendar day and hour: at most 24 rows per day."""
    return events.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.count("*").alias("events")
    )


def time_distribution(events: DataFrame) -> DataFrame:
    """Events per hour of day and per day, as (kind, bucket, events) rows."""
    grid = hourly_counts(events.where(F.col("ts").isNotNull()))
    hours = grid.groupBy(F.lpad(F.col("hour").cast("string"), 2, "0").alias("bucket"))
    days = grid.groupBy(F.date_format("day", "yyyy-MM-dd").alias("bucket"))
    total = F.sum("events").alias("events")
    return (
        hours.agg(total).select(F.lit("hour").alias("kind"), "bucket", "events")
        .unionByName(days.agg(total).select(F.lit("day").alias("kind"), "bucket", "events"))
    )


def peaks(events: DataFrame) -> DataFrame:
    """The busiest hour of day and the busiest day; ties go to the earlier one."""
    spread = time_distribution(events)
    best = F.struct(F.col("events"), -F.unix_date(F.to_date("bucket")))
    hour_best = F.struct(F.col("events"), -F.col("bucket").cast("int"))
    hours = spread.where(F.col("kind") == "hour").groupBy("kind").agg(
        F.max_by("bucket", hour_best).alias("bucket"), F.max("events").alias("events")
    )
    days = spread.where(F.col("kind") == "day").groupBy("kind").agg(
        F.max_by("bucket", best).alias("bucket"), F.max("events").alias("events")
    )
    return hours.unionByName(days)


FACETS = ("hourly", "dow", "by_date", "peak_day", "peak_hour", "top_hours", "top_days")


def activity_report(
    events: DataFrame, start: datetime, end: datetime, tz_offset_minutes: int = 0, n: int = 3
) -> DataFrame:
    """Activity in local time as (facet, bucket, events, pct) rows.

    Facets: hourly, dow (0 is Sunday), by_date, peak_day, peak_hour (inside the
    peak day), top_hours, top_days (after the peak day).  The events are read
    and shuffled once, into the day × hour grid; everything else works on that
    grid, whose size depends on the window alone.
    """
    local = F.col("ts") - F.make_dt_interval(mins=F.lit(tz_offset_minutes))
    grid = hourly_counts(events.where(between("ts", start, end)).withColumn("ts", local))
    busiest = F.max(F.struct(F.col("events"), (-F.col("hour")).alias("_hour"))).alias("best")
    days = grid.groupBy("day").agg(F.sum("events").alias("events"), busiest)
    no_best = F.lit(None).cast("struct<events: bigint, _hour: int>").alias("best")

    def zeros(name, size):
        ids = F.explode(F.array(*[F.lit(i) for i in range(size)])).alias(name)
        return events.sparkSession.range(1).select(ids, F.lit(0).cast("long").alias("events"))

    def level(name, rows, key, bucket):
        every = rows.select(key, "events").unionByName(zeros(key, 24 if key == "hour" else 7))
        counted = every.groupBy(key).agg(F.sum("events").alias("events"))
        return counted.select(F.lit(name).alias("level"), bucket.alias("bucket"), "events", no_best)

    two_digits = F.lpad(F.col("hour").cast("string"), 2, "0")
    with_dow = days.withColumn("dow", F.dayofweek("day") - 1)
    levels = (
        level("hour", grid, "hour", two_digits)
        .unionByName(level("dow", with_dow, "dow", F.col("dow").cast("string")))
        .unionByName(
            days.select(
                F.lit("day").alias("level"), F.date_format("day", "yyyy-MM-dd").alias("bucket"), "events", "best"
            )
        )
    )
    by_level = Window.partitionBy("level")
    ranked = levels.withColumns(
        {
            "place": F.row_number().over(by_level.orderBy(F.desc("events"), "bucket")),
            "total": F.sum("events").over(by_level),
        }
    )

    def row(condition, facet, bucket=None, count=None):
        count = F.col("events") if count is None else count
        values = F.struct(
            F.lit(facet).alias("facet"),
            (F.col("bucket") if bucket is None else bucket).alias("bucket"),
            count.alias("events"),
            percent(count, F.col("total"), 4).alias("pct"),
        )
        return F.when(condition, values)

    hour, dow, day = (F.col("level") == name for name in ("hour", "dow", "day"))
    place = F.col("place")
    peak_hour = F.concat(F.lpad((-F.col("best._hour")).cast("string"), 2, "0"), F.lit(":00"))
    rows = F.array(
        row(hour, "hourly"),
        row(hour & (place <= n), "top_hours"),
        row(dow, "dow"),
        row(day, "by_date"),
        row(day & (place == 1), "peak_day"),
        row(day & (place == 1), "peak_hour", peak_hour, F.col("best.events")),
        row(day & (place > 1) & (place <= n + 1), "top_days"),
    )
    return ranked.select(F.inline(F.array_compact(rows)))


def activity_histogram(
    events: DataFrame,
    start: datetime,
    end: datetime,
    tz_offset_minutes: int = 0,
    facet: str = "hourly",
    n: int = 3,
) -> DataFrame:
    """One facet of activity_report()."""
    if facet not in FACETS:
        raise ValueError(f"unknown facet {facet!r}")
    report = activity_report(events, start, end, tz_offset_minutes, n)
    return report.where(F.col("facet") == facet).drop("facet")


# Bucket lengths of a trend, in seconds.
PERIODS = {"hourly": 3_600, "daily": 86_400, "weekly": 604_800, "monthly": 2_592_000}


def trend(events: DataFrame, metric: str, period: str, start: datetime, end: datetime) -> DataFrame:
    """A metric per bucket of the window, empty buckets included.

    Buckets are half open and counted from ``start``.  Metrics: events,
    page_views, sessions, purchases, or orders for a frame with one order a row.
    """
    size = PERIODS[period]
    span = int((end - start).total_seconds())
    buckets = span // size + 1
    inside = events.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    if metric == "page_views":
        inside = inside.where(F.col("event_type") == "pageview")
    elif metric == "purchases":
        inside = inside.where(F.col("event_type") == "purchase")
    elif metric not in ("events", "orders", "sessions"):
        raise ValueError(f"unknown metric {metric!r}")
    elapsed = F.unix_seconds("ts") - F.unix_seconds(F.lit(start))
    index = F.floor(elapsed / F.lit(size)).cast("long").alias("bucket")
    value = F.countDistinct("session_id") if metric == "sessions" else F.count("*")
    counted = inside.groupBy(index).agg(value.alias("value"))
    calendar = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    begin = F.timestamp_seconds(F.unix_seconds(F.lit(start)) + F.col("bucket") * size)
    return calendar.join(counted, "bucket", "left").select(
        F.lit(metric).alias("metric"),
        begin.alias("bucket_start"),
        F.coalesce("value", F.lit(0)).alias("value"),
    )


def minute_counts(events: DataFrame) -> DataFrame:
    """Events per minute, page and type: the batch form of the stream's table."""
    return (
        events.groupBy(F.window("ts", "1 minute").alias("w"), "page", "event_type")
        .agg(F.count("*").alias("count"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "page",
            "event_type",
            "count",
        )
    )


def minute_totals(minutes: DataFrame, as_of: datetime, last: int = 60) -> DataFrame:
    """Totals of the last minutes by minute, by page and by type, in one pass."""
    start = as_of - timedelta(minutes=last)
    recent = minutes.where((F.col("window_start") >= F.lit(start)) & (F.col("window_start") <= F.lit(as_of)))
    sets = [["window_start"], ["page"], ["event_type"]]
    grouped = recent.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("window_start"), F.col("page"), F.col("event_type")
    ).agg(F.sum("count").alias("events"), F.grouping_id().alias("_set"))
    kind = (
        F.when(F.col("_set") == 3, F.lit("minute"))
        .when(F.col("_set") == 5, F.lit("page"))
        .otherwise(F.lit("event_type"))
    )
    key = F.coalesce(
        F.date_format("window_start", "yyyy-MM-dd HH:mm"), F.col("page"), F.col("event_type")
    )
    return grouped.select(kind.alias("kind"), key.alias("bucket"), "events")
