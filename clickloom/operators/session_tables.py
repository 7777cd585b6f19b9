"""Sessions in two tables, so that no row grows with a session: heads and (session, page) rows.

A head holds the user, the time span, the number of events, the first few pages by
name and a sketch of all of them (HyperLogLog), which tells their number within a
few per cent and can be merged.  The exact pages are rows of their own.  Build,
merge and repair are folds by session and by (session, page) that combine on the
map side; a session with a third of all events and any number of pages has no large
row, and its page rows are spread by their own key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import event_order
from clickloom.operators.sessions import session_pages

#: Pages named in a head; the sketch's size as a power of two (a standard error of 1.6 % at 12).
NAMED, SKETCH_LOG2 = 10, 12
HEAD = ["session_id", "user_id", "first_event_at", "last_event_at", "event_count", "page_sketch"]


def heads(events: DataFrame) -> DataFrame:
    """One row per session: user of the newest event, time span, count, sketch of the pages."""
    return events.groupBy("session_id").agg(
        F.max_by("user_id", event_order()).alias("user_id"),
        F.min("ts").alias("first_event_at"),
        F.max("ts").alias("last_event_at"),
        F.count("*").alias("event_count"),
        F.hll_sketch_agg("page", SKETCH_LOG2).alias("page_sketch"),
    )


def pages(events: DataFrame) -> DataFrame:
    """(session_id, page, events), a row per page of a session; events without a page have none."""
    return session_pages(events).where(F.col("page").isNotNull())


def merge_heads(rows: DataFrame) -> DataFrame:
    """One head per session id: counts added, times widened, sketches united.

    The user comes from the row with most events, then the earliest one.
    """
    keeper = F.struct(F.col("event_count"), -F.unix_micros("first_event_at"), F.col("user_id"))
    return rows.groupBy("session_id").agg(
        F.max_by("user_id", keeper).alias("user_id"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.sum("event_count").alias("event_count"),
        F.hll_union_agg("page_sketch").alias("page_sketch"),
        F.count("*").alias("merged_rows"),
    )


def merge_pages(rows: DataFrame) -> DataFrame:
    """One row per session and page, events added."""
    return rows.groupBy("session_id", "page").agg(F.sum("events").alias("events"))


def repair(stored: DataFrame, stored_pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads without events refilled from the event table, orphans marked; and the page rows that go with them."""
    actual = heads(events).select("session_id", *[F.col(c).alias(f"_{c}") for c in HEAD[2:]])
    empty = F.coalesce(F.col("event_count"), F.lit(0)) == 0
    refill = empty & F.col("_event_count").isNotNull()
    both = stored.join(actual, "session_id", "left")
    repaired = both.select(
        "session_id", "user_id", *[F.when(refill, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in HEAD[2:]],
        (empty & F.col("_event_count").isNull()).alias("is_orphan"),
    )
    refilled = both.where(refill).select("session_id")
    fresh = pages(events).join(refilled, "session_id")
    return repaired, merge_pages(stored_pages).join(refilled, "session_id", "left_anti").unionByName(fresh)


def estimate(sketch: str = "page_sketch") -> Column:
    """The number of pages that a sketch stands for."""
    return F.hll_sketch_estimate(sketch)


def named_pages(page_rows: DataFrame, n: int = NAMED) -> DataFrame:
    """(session_id, n_pages, first_pages): the exact number of pages, and the first ones by name."""
    in_order = Window.partitionBy("session_id").orderBy("page")
    first = page_rows.withColumn("_nth", F.row_number().over(in_order)).where(F.col("_nth") <= n)
    names = first.groupBy("session_id").agg(F.sort_array(F.collect_list("page")).alias("first_pages"))
    return page_rows.groupBy("session_id").agg(F.count("*").alias("n_pages")).join(names, "session_id")
