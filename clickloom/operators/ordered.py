"""Ordered work inside sessions that stays even when one session is huge.

A window over a whole session sorts that session in one task.  Here a session
is cut into time slots: slots are ordered independently and only one small row
per slot is carried on to the session level.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 3_600


def with_slot(events: DataFrame, seconds: int = SLOT_SECONDS) -> DataFrame:
    """Add ``_slot``, the start of the event's time slot in epoch seconds."""
    time = F.unix_seconds("ts")
    return events.withColumn("_slot", time - F.pmod(time, F.lit(seconds)))


def in_slot():
    """Event order inside one (session, slot)."""
    return Window.partitionBy("session_id", "_slot").orderBy("ts", "event_id")


def across_slots():
    """Slot order inside one session."""
    return Window.partitionBy("session_id").orderBy("_slot")


def keep_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of the given sessions (one row per session_id).

    The semi join runs on (session, slot) rather than session, so the events of
    a huge session that is about to be dropped never meet in one task.  The
    slots are found by an inner join, as Spark would push a semi join below
    the distinct and shuffle all events by session after all.
    """
    slotted = with_slot(events)
    pairs = slotted.select("session_id", "_slot").distinct()
    wanted = pairs.join(sessions.select("session_id"), "session_id")
    return slotted.join(wanted, ["session_id", "_slot"], "left_semi").drop("_slot")
