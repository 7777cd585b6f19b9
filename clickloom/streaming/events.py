"""The event stream: sources, decoding, minute counts, sessions, upsert sink."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.functions import values
from clickloom.operators import cleaning


def kafka_source(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None
) -> DataFrame:
    """Messages of a Kafka topic as a ``value`` text column."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def text_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of one JSON message per line, in place of a topic."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def decode(messages: DataFrame) -> DataFrame:
    """Event columns of JSON messages, plus the message text as ``raw``.

    The id is ``event_id``, else ``_id``, else a digest of the message, so that
    only equal messages count as repeats.  A message that is no JSON object or
    has no event gives null columns, which validation then rejects.
    """
    parsed = F.from_json("value", schema.STREAM_MESSAGE)
    event = messages.select(F.col("value").alias("raw"), parsed.alias("m")).select(
        "raw", F.col("m.event").isNotNull().alias("_there"), "m.event.*"
    )
    own = [F.nullif(F.trim(name), F.lit("")) for name in ("event_id", "_id")]
    named = F.coalesce(*own, F.when(F.col("_there"), F.sha2("raw", 256)))
    return event.withColumn("event_id", named).drop("_id", "_there")


def checked(decoded: DataFrame) -> DataFrame:
    """Decoded events with their event time and reject reason."""
    return cleaning.validate(decoded).withColumn("ts", values.epoch_time(F.col("timestamp")))


def accepted(decoded: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Valid events, each event id once within the watermark delay."""
    good = cleaning.valid(checked(decoded)).drop("raw")
    return good.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def refused(decoded: DataFrame) -> DataFrame:
    """Messages that fail validation, with the reason: the dead-letter branch."""
    return cleaning.rejected(checked(decoded)).select("raw", "reject_reason")


def enrich(events: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Stream-static left joins with product and user details."""
    named = events.withColumn("product_id", F.col("properties")["product_id"])
    return cleaning.enrich(named, products, users)


def minute_counts(events: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """Events per minute, page and type.

    The watermark lets Spark drop the state of finished minutes; rows later
    than it are ignored.  Pass ``delay=None`` when the stream carries one.
    """
    timed = events.withWatermark("ts", delay) if delay else events
    counted = timed.groupBy(F.window("ts", "1 minute").alias("w"), "page", "event_type").count()
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "page", "event_type", "count"
    )


def session_state(events: DataFrame, gap: str = "24 hours", delay: str | None = "10 minutes") -> DataFrame:
    """Running totals per user visit; a visit closes after the gap."""
    timed = events.withWatermark("ts", delay) if delay else events
    visits = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("event_count"), F.max("ts").alias("last_event_at")
    )
    return visits.select("user_id", F.col("w.start").alias("first_event_at"), "last_event_at", "event_count")


SESSION_KEYS = ["session_id", "span_start"]
SESSION_VALUES = ["first_event_at", "last_event_at", "event_count"]


def session_totals(events: DataFrame, span: str = "1 day") -> DataFrame:
    """Running totals per tracker session id and span of time, for update mode.

    The watermark of ``events`` ends a span's state, so state stays bounded
    while a session id may come back at any time; read_sessions() adds up.
    """
    totals = events.groupBy(F.window("ts", span).alias("w"), "session_id").agg(
        F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("event_count")
    )
    return totals.select("session_id", F.col("w.start").alias("span_start"), *SESSION_VALUES)


def read_sessions(spark: SparkSession, table: str) -> DataFrame:
    """One row per session of the table session_totals() keeps."""
    spans = read_upserts(spark, table, SESSION_KEYS, SESSION_VALUES)
    return spans.groupBy("session_id").agg(
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.sum("event_count").alias("event_count"),
    )


def upsert_sink(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Start writing an update-mode aggregate as a keyed table.

    Every batch writes its changed rows under its own ``batch_id`` folder.  A
    repeated batch overwrites the same folder, so a restart adds nothing twice,
    and read_upserts() keeps the newest value per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserts(spark: SparkSession, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Current rows of an upsert table: per key, the values of the newest batch."""
    rows = spark.read.parquet(table)
    newest = F.max_by(F.struct(*columns), F.col("batch_id")).alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def compact_upserts(
    spark: SparkSession, table: str, target: str, keys: list[str], columns: list[str]
) -> None:
    """Rewrite an upsert table into a new folder with one batch of current rows.

    Run it between stream runs; the stream goes on with higher batch numbers.
    """
    last = spark.read.parquet(table).agg(F.max("batch_id")).scalar()
    current = read_upserts(spark, table, keys, columns).withColumn("batch_id", last)
    current.write.mode("overwrite").partitionBy("batch_id").parquet(target)


MINUTE_KEYS = ["window_start", "window_end", "page", "event_type"]


def read_minutes(spark: SparkSession, table: str) -> DataFrame:
    """The minute table the stream maintains."""
    return read_upserts(spark, table, MINUTE_KEYS, ["count"])


def run_minute_job(messages: DataFrame, table: str, checkpoint: str, delay: str = "10 minutes"):
    """Messages to minute table: decode, validate, drop repeats, count, upsert."""
    counts = minute_counts(accepted(decode(messages), delay), delay=None)
    return upsert_sink(counts, table, checkpoint)
