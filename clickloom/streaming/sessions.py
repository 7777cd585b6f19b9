"""Sessions of the event stream as an upsert table: totals, last user and visited pages.

Each session keeps its first and last time, its number of events, the user of its
last event and the pages it has seen.  A session is dealt over ``parts`` states by
the event id, so one that holds a third of all events still has several tasks; the
reader adds the parts up.  A state ends by an event-time timer, ``gap`` after the
part's last event; a session that comes back later starts another span, which the
reader adds up too.  Pages leave the state once, as (session, page) rows, so no row
holds the pages of a session.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickloom.streaming import events as stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Times are microseconds; a row with a page is a page seen for the first time, any other one the totals so far.
CHANGE = (
    "session_id string, part int, started long, page string, first_us long, last_us long, "
    "last_id string, last_user string, event_count long"
)
TOTALS = ["started", "first_us", "last_us", "last_id", "last_user", "event_count"]


class SessionPart(StatefulProcessor):
    """The state of one part of one session."""

    def __init__(self, gap_seconds: int):
        self.gap_us = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = "started long, first_us long, last_us long, last_id string, last_user string, event_count long"
        self.totals = handle.getValueState("totals", kinds)
        self.pages = handle.getMapState("pages", "page string", "seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        totals = dict(zip(TOTALS, self.totals.get())) if self.totals.exists() else None
        visited: dict[str, int] = {}
        for chunk in rows:
            us = chunk["us"]
            first, last = int(us.min()), int(us.max())
            if totals is None:
                totals = dict(started=first, first_us=first, last_us=None, event_count=0)
            totals["first_us"] = min(totals["first_us"], first)
            newest = chunk[us == last].sort_values("event_id").iloc[-1]
            if totals["last_us"] is None or (last, newest["event_id"]) >= (totals["last_us"], totals["last_id"]):
                totals.update(last_us=last, last_id=newest["event_id"], last_user=newest["user_id"])
            totals["event_count"] += len(chunk)
            for page, seen in chunk.dropna(subset=["page"]).groupby("page", sort=False)["us"].min().items():
                visited[page] = min(visited.get(page, int(seen)), int(seen))
        # The state is asked once a page, however many chunks hold it: every question is a call to the JVM.
        fresh = [page for page in visited if not self.pages.containsKey((page,))]
        for page in fresh:
            self.pages.updateValue((page,), (visited[page],))
        if totals is None:
            return
        self.totals.update(tuple(totals[c] for c in TOTALS))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((totals["last_us"] + self.gap_us) // 1000)
        out = pd.DataFrame([{"session_id": key[0], "part": key[1], "page": page, **totals} for page in [None, *fresh]])
        yield out[["session_id", "part", "started", "page", *TOTALS[1:]]].astype({"event_count": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.pages.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_changes(events: DataFrame, gap_seconds: int = 86_400, parts: int = 4) -> DataFrame:
    """Changed totals and new pages of a watermarked stream of events, for append mode."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")
    keyed = events.select(
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"), part.alias("part"), "event_id", "user_id", "page",
        "ts", F.unix_micros("ts").alias("us"),
    )
    return keyed.groupBy("session_id", "part").transformWithStateInPandas(
        statefulProcessor=SessionPart(gap_seconds), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"
    )


def session_sink(changes: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Start writing session changes; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kind = F.when(F.col("page").isNull(), F.lit("totals")).otherwise(F.lit("pages"))
        batch.withColumn("kind", kind).write.partitionBy("kind").mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    conf = changes.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)  # the store that keeps timers and maps; a query keeps the one it started with
    try:
        return (
            changes.writeStream.outputMode("append")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        conf.set(PROVIDER, before)


def run_session_job(
    messages: DataFrame, table: str, checkpoint: str, delay: str = "10 minutes", gap_seconds: int = 86_400, parts: int = 4
):
    """Messages to session table: decode, validate, drop repeats, fold, upsert."""
    accepted = stream.accepted(stream.decode(messages), delay)
    return session_sink(session_changes(accepted, gap_seconds, parts), table, checkpoint)


def _rows(spark: SparkSession, table: str, kind: str) -> DataFrame:
    schema = f"{CHANGE}, batch_id long, kind string"
    return spark.read.schema(schema).parquet(table).where(F.col("kind") == kind)


def _time(us: str) -> Column:
    return F.timestamp_micros(us)


def read_sessions(spark: SparkSession, table: str) -> DataFrame:
    """One row per session: (session_id, user_id of the last event, first_event_at, last_event_at, event_count)."""
    latest = F.max_by(F.struct(*TOTALS[1:]), "batch_id").alias("v")
    spans = _rows(spark, table, "totals").groupBy("session_id", "part", "started").agg(latest).select("session_id", "v.*")
    return spans.groupBy("session_id").agg(
        F.max_by("last_user", F.struct("last_us", "last_id")).alias("user_id"),
        _time(F.min("first_us")).alias("first_event_at"),
        _time(F.max("last_us")).alias("last_event_at"),
        F.sum("event_count").alias("event_count"),
    )


def read_session_pages(spark: SparkSession, table: str) -> DataFrame:
    """The pages of the sessions, as (session_id, page) rows."""
    return _rows(spark, table, "pages").select("session_id", "page").distinct()
