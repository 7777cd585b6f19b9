"""Sessions: build from events, repair, audit, browse."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import count_if, event_order


def sessionize(events: DataFrame, gap_seconds: int = 86_400) -> DataFrame:
    """Number each user's visits: a pause longer than the gap starts a new one.

    Time is cut into slots as long as the gap.  Two events in one slot are less
    than the gap apart, so a visit can only end between slots.  It is enough to
    order each user's few slots (their first and last event) and join the visit
    number back on (user, slot).  The events themselves are never sorted, and a
    user with a third of all events is spread over that user's slots.  Events
    without a user share the visits of "unknown"; events without a time belong
    to no visit and are left out.
    """
    width = gap_seconds * 1_000_000
    micros = F.unix_micros("ts")
    slotted = events.withColumn("_slot", micros - F.pmod(micros, F.lit(width)))
    slots = slotted.groupBy("user_id", "_slot").agg(
        F.min(F.unix_micros("ts")).alias("_first"), F.max(F.unix_micros("ts")).alias("_last")
    )
    by_user = Window.partitionBy("user_id").orderBy("_slot")
    previous = F.lag("_last").over(by_user)
    breaks = F.when(F.col("_first") - previous > width, 1).otherwise(0)
    running = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = slots.withColumn("_break", breaks).select(
        F.col("user_id").alias("_user"), F.col("_slot").alias("_at"), F.sum("_break").over(running).alias("_n")
    )
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_slot") == F.col("_at"))
    name = F.coalesce(F.col("user_id").cast("string"), F.lit("unknown"))
    return (
        slotted.join(numbered, same)
        .withColumn("session_id", F.concat_ws("-", name, F.col("_n").cast("string")))
        .drop("_slot", "_user", "_at", "_n")
    )


def rollup(events: DataFrame) -> DataFrame:
    """One row per session: user of the newest event, time span, count, pages."""
    return events.groupBy("session_id").agg(
        F.max_by("user_id", event_order()).alias("user_id"),
        F.min("ts").alias("first_event_at"),
        F.max("ts").alias("last_event_at"),
        F.count("*").alias("event_count"),
        F.sort_array(F.collect_set("page")).alias("pages"),
    )


def session_pages(events: DataFrame) -> DataFrame:
    """One row per session and page, with its events: the form of a session's pages that has no upper size."""
    return events.groupBy("session_id", "page").agg(F.count("*").alias("events"))


def backfill(events: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Sessions rebuilt from the last ``days`` of events."""
    start = as_of - timedelta(days=days)
    return rollup(events.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(as_of))))


def merge_duplicates(sessions: DataFrame) -> DataFrame:
    """One row per session id: counts added, pages united, times widened.

    The user comes from the row with most events, then the earliest one.
    """
    keeper = F.struct(F.col("event_count"), -F.unix_micros("first_event_at"), F.col("user_id"))
    return sessions.groupBy("session_id").agg(
        F.max_by("user_id", keeper).alias("user_id"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.sum("event_count").alias("event_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"),
        F.count("*").alias("merged_rows"),
    )


def repair_empty(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Refill sessions that hold no events from the event table, marking orphans."""
    actual = rollup(events).select(
        "session_id",
        F.col("first_event_at").alias("_first"),
        F.col("last_event_at").alias("_last"),
        F.col("event_count").alias("_count"),
        F.col("pages").alias("_pages"),
    )
    empty = F.coalesce(F.col("event_count"), F.lit(0)) == 0
    refill = empty & F.col("_count").isNotNull()

    def pick(new: str, old: str):
        return F.when(refill, F.col(new)).otherwise(F.col(old)).alias(old)

    return sessions.join(actual, "session_id", "left").select(
        "session_id",
        "user_id",
        pick("_first", "first_event_at"),
        pick("_last", "last_event_at"),
        pick("_count", "event_count"),
        pick("_pages", "pages"),
        (empty & F.col("_count").isNull()).alias("is_orphan"),
    )


def audit(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Count every kind of disagreement between the session and the event table."""
    actual = events.groupBy("session_id").agg(
        F.count("*").alias("_count"), F.max_by("user_id", event_order()).alias("_user")
    )
    stored = sessions.select(
        "session_id",
        F.col("user_id").alias("_stored_user"),
        F.col("event_count").alias("_stored_count"),
        F.size("pages").alias("_pages"),
        F.lit(True).alias("_stored"),
    )
    both = stored.join(actual, "session_id", "full_outer")
    in_sessions = F.col("_stored").isNotNull()
    in_events = F.col("_count").isNotNull()
    checks = {
        "sessions": count_if(in_sessions),
        "empty_pages": count_if(in_sessions & (F.coalesce(F.col("_pages"), F.lit(0)) <= 0)),
        "zero_events": count_if(in_sessions & (F.coalesce(F.col("_stored_count"), F.lit(0)) == 0)),
        "orphan_sessions": count_if(in_sessions & ~in_events),
        "sessions_missing": count_if(~in_sessions & in_events),
        "orphan_events": F.sum(F.when(~in_sessions, F.col("_count")).otherwise(0)),
        "count_mismatch": count_if(in_sessions & in_events & (F.col("_stored_count") != F.col("_count"))),
        "user_mismatch": count_if(in_sessions & in_events & (F.col("_stored_user") != F.col("_user"))),
    }
    totals = both.agg(*[value.cast("long").alias(name) for name, value in checks.items()])
    return totals.unpivot([], list(checks), "check_name", "n").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0))
    )


def summary(events: DataFrame, sample: int = 10) -> DataFrame:
    """Count, time span and the first few page names of every session.

    Only the first names are ever brought together, however many pages the
    session of unknown visitors has.
    """
    spans = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at")
    )
    in_order = Window.partitionBy("session_id").orderBy("page")
    named = session_pages(events).where(F.col("page").isNotNull())
    first = named.withColumn("_nth", F.row_number().over(in_order)).where(F.col("_nth") <= sample)
    names = first.groupBy(F.col("session_id").alias("_session")).agg(F.sort_array(F.collect_list("page")).alias("_pages"))
    same = F.col("session_id").eqNullSafe(F.col("_session"))
    none = F.array().cast("array<string>")
    return spans.join(names, same, "left").select(
        "session_id", "event_count", "first_event_at", "last_event_at", F.coalesce("_pages", none).alias("sample_pages")
    )


def recent(events: DataFrame, n: int = 20, user_contains: str | None = None) -> DataFrame:
    """Sessions by newest event, with the user of their first event."""
    sessions = events.groupBy("session_id").agg(
        F.max("ts").alias("last_event_at"),
        F.min_by("user_id", event_order()).alias("user_id"),
        F.count("*").alias("event_count"),
    )
    if user_contains:
        sessions = sessions.where(F.lower("user_id").contains(user_contains.lower()))
    return sessions.orderBy(F.desc("last_event_at"), "session_id").limit(n)


def of_users(events: DataFrame, user: str | None = None) -> DataFrame:
    """Every user's sessions with their first event and event count."""
    out = events if user is None else events.where(F.col("user_id") == user)
    return out.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("first_event_at"),
        F.min_by("event_type", event_order()).alias("first_event_type"),
        F.count("*").alias("event_count"),
    )
