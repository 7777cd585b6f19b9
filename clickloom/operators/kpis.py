"""Headline numbers: totals, rates, business and behaviour KPIs."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import pages
from clickloom.functions.values import count_if, flag, percent, ratio


def between(ts: str, start: datetime, end: datetime) -> Column:
    """Closed interval on a plain column, so the scan can use it."""
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end))


def event_totals(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Events, distinct sessions and distinct users.

    Rows are first folded to one per (session, user), so the distinct counts
    run on that far smaller set.  ``approximate`` needs no second shuffle.
    """
    if approximate:
        return events.agg(
            F.count("*").alias("total_events"),
            F.approx_count_distinct("session_id").alias("sessions"),
            F.approx_count_distinct("user_id").alias("users"),
        )
    pairs = events.groupBy("session_id", "user_id").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("user_id").alias("users"),
    )


def top_pages(events: DataFrame, n: int = 10) -> DataFrame:
    return (
        events.groupBy("page").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "page").limit(n)
    )


def event_type_shares(events: DataFrame) -> DataFrame:
    counts = events.groupBy("event_type").agg(F.count("*").alias("events"))
    total = counts.agg(F.sum("events")).scalar()
    return counts.withColumn("share_pct", percent(F.col("events"), total))


def session_stats(events: DataFrame) -> DataFrame:
    """Averages, maxima and exact medians of session size and duration; bounce rate."""
    sessions = events.groupBy("session_id", "user_id").agg(
        F.count("*").alias("events"),
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds"),
    )
    return sessions.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("user_id").alias("total_users"),
        F.round(F.avg("events"), 2).alias("avg_events_per_session"),
        F.max("events").alias("max_events_per_session"),
        F.percentile("events", 0.5).alias("median_events_per_session"),
        F.round(F.avg("seconds"), 2).alias("avg_session_seconds"),
        F.max("seconds").alias("max_session_seconds"),
        F.percentile("seconds", 0.5).alias("median_session_seconds"),
        F.round(
            ratio(count_if(F.col("events") == 1), F.countDistinct("session_id")), 4
        ).alias("bounce_rate"),
    )


def session_table_stats(sessions: DataFrame) -> DataFrame:
    """Session count, mean size and bounce rate from a sessions table."""
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.round(F.avg("event_count"), 4).alias("avg_events_per_session"),
        F.round(ratio(count_if(F.col("event_count") == 1), F.count("*")), 4).alias("bounce_rate"),
    )


def session_detail(events: DataFrame) -> DataFrame:
    """Duration, page count and distinct pages of sessions with several events."""
    sessions = events.groupBy("session_id").agg(
        F.round(
            (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6), 3
        ).alias("duration_seconds"),
        F.count("*").alias("page_count"),
        F.countDistinct("page").alias("unique_pages"),
    )
    return sessions.where(F.col("page_count") > 1)


def session_detail_means(events: DataFrame) -> DataFrame:
    return session_detail(events).agg(
        F.round(F.avg("duration_seconds"), 2).alias("avg_session_duration"),
        F.round(F.avg("page_count"), 2).alias("avg_pages_per_session"),
        F.count("*").alias("sessions"),
    )


def user_detail(events: DataFrame) -> DataFrame:
    """Sessions, events and distinct pages per user.

    Folding to one row per (user, session, page) first keeps the two distinct
    counts from multiplying the event rows.
    """
    folded = events.groupBy("user_id", "session_id", "page").agg(F.count("*").alias("n"))
    return folded.groupBy("user_id").agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.sum("n").alias("total_events"),
        F.countDistinct("page").alias("unique_pages"),
    ).withColumn(
        "avg_events_per_session", F.round(ratio(F.col("total_events"), F.col("total_sessions")), 4)
    )


def user_means(events: DataFrame) -> DataFrame:
    pairs = events.groupBy("user_id", "session_id").agg(F.count("*").alias("n"))
    users = pairs.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
    return users.agg(
        F.count("*").alias("users"),
        F.round(F.avg("sessions"), 4).alias("avg_sessions_per_user"),
        F.round(F.avg("events"), 4).alias("avg_events_per_user"),
    )


def purchases(events: DataFrame) -> DataFrame:
    """Purchase events, whatever the case and spacing of their type."""
    return events.where(F.lower(F.trim("event_type")) == "purchase")


def purchase_revenue(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return purchases(events.where(between("ts", start, end))).agg(
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("revenue"),
        F.count("*").alias("purchases"),
    )


def business_kpis(events: DataFrame, orders: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Revenue, orders, order value, conversion, traffic.

    Revenue and orders come from the orders table when the window holds any
    order, otherwise from purchase events; they are never added together.
    """
    bought = F.lower(F.trim("event_type")) == "purchase"
    folded = (
        events.where(between("ts", start, end))
        .groupBy("session_id", "user_id")
        .agg(
            F.count("*").alias("n"),
            count_if(bought).alias("bought"),
            F.sum(F.when(bought, F.col("amount")).otherwise(0.0)).alias("spent"),
            F.max("ts").alias("last_ts"),
        )
    )
    ordered = orders.where(between("created_at", start, end)).agg(
        F.struct(F.count("*").alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    )
    totals = folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("user_id").alias("total_users"),
        F.coalesce(F.sum("bought"), F.lit(0)).alias("bought"),
        F.coalesce(F.sum("spent"), F.lit(0.0)).alias("spent"),
        F.max("last_ts").alias("last_event_ts"),
    ).withColumn("ordered", ordered.scalar())
    has_orders = F.col("ordered.n") > 0
    return totals.select(
        F.when(has_orders, F.col("ordered.total")).otherwise(F.col("spent")).alias("revenue"),
        F.when(has_orders, F.col("ordered.n")).otherwise(F.col("bought")).alias("orders"),
        F.round(ratio(F.col("bought"), F.col("total_users")), 4).alias("conversion_rate"),
        "total_users",
        "total_sessions",
        "total_events",
        "last_event_ts",
    ).select(
        F.round("revenue", 2).alias("revenue"),
        "orders",
        F.round(ratio(F.col("revenue"), F.col("orders")), 2).alias("average_order_value"),
        "conversion_rate",
        "total_users",
        "total_sessions",
        "total_events",
        "last_event_ts",
    )


def behavior_kpis(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Sessions, page views and the share of one-event sessions."""
    sessions = (
        events.where(between("ts", start, end))
        .groupBy("session_id")
        .agg(F.count("*").alias("n"), count_if(F.col("event_type") == "pageview").alias("views"))
    )
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("page_views"),
        F.round(ratio(count_if(F.col("n") == 1), F.count("*")), 4).alias("bounce_rate"),
    )


def success_rate(logs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Info against error lines of a log table (ts, level)."""
    counted = logs.where(between("ts", start, end)).agg(
        count_if(F.col("level") == "info").alias("success_count"),
        count_if(F.col("level").isin("error", "exception")).alias("error_count"),
    )
    total = F.col("success_count") + F.col("error_count")
    return counted.withColumn("success_rate", F.round(ratio(F.col("success_count"), total), 4))


def page_rates(events: DataFrame) -> DataFrame:
    """Share of sessions that saw each page."""
    pairs = events.select("session_id", "page").distinct()
    visits = pairs.groupBy("page").agg(F.count("*").alias("sessions"))
    total = pairs.agg(F.countDistinct("session_id")).scalar()
    return visits.withColumn("visit_rate", F.round(ratio(F.col("sessions"), total), 6))


def revisit_rates(events: DataFrame) -> DataFrame:
    """Share of sessions with several pages, and with a page seen twice."""
    sessions = events.groupBy("session_id").agg(
        F.count("page").alias("views"), F.countDistinct("page").alias("pages")
    )
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.round(ratio(count_if(F.col("pages") > 1), F.count("*")), 6).alias("multi_page_rate"),
        F.round(ratio(count_if(F.col("views") > F.col("pages")), F.count("*")), 6).alias("revisit_rate"),
    )


def active_users(events: DataFrame, min_interactions: int = 5, n: int | None = 20) -> DataFrame:
    """Users with enough product interactions, busiest first."""
    touched = events.where(F.coalesce(F.col("product_id"), F.lit("")) != "")
    folded = touched.groupBy("user_id", "product_id").agg(
        F.count("*").alias("n"),
        count_if(F.col("event_type") == "pageview").alias("pageviews"),
        count_if(F.col("event_type") == "add_to_cart").alias("adds"),
        count_if(F.col("event_type") == "purchase").alias("buys"),
    )
    users = folded.groupBy("user_id").agg(
        F.sum("n").alias("total_interactions"),
        F.sum("pageviews").alias("pageviews"),
        F.sum("adds").alias("add_to_carts"),
        F.sum("buys").alias("purchases"),
        F.count("*").alias("unique_products"),
    )
    found = users.where(F.col("total_interactions") >= min_interactions)
    if n is None:
        return found
    return found.orderBy(F.desc("total_interactions"), "user_id").limit(n)


def activity_buckets(events: DataFrame, min_interactions: int = 5) -> DataFrame:
    """How many users fall into each activity band."""
    x = F.col("total_interactions")
    band = (
        F.when(x <= 10, F.lit("5-10"))
        .when(x <= 50, F.lit("11-50"))
        .when(x <= 100, F.lit("51-100"))
        .when(x <= 500, F.lit("101-500"))
        .otherwise(F.lit("500+"))
    )
    users = active_users(events, min_interactions, n=None)
    return users.groupBy(band.alias("bucket")).agg(F.count("*").alias("users"))


def user_interactions(events: DataFrame, user: str) -> DataFrame:
    """One user's interactions per event type."""
    own = events.where((F.col("user_id") == user) & (F.coalesce(F.col("product_id"), F.lit("")) != ""))
    return own.groupBy("event_type").agg(
        F.count("*").alias("interactions"), F.countDistinct("product_id").alias("products")
    )


def product_view_share(events: DataFrame) -> DataFrame:
    on_product = pages.is_product_page(F.col("page"))
    return events.agg(
        count_if(on_product).alias("product_views"),
        F.count("*").alias("total_events"),
        percent(count_if(on_product), F.count("*")).alias("view_rate_pct"),
    )


def top_viewed_products(events: DataFrame, n: int = 10) -> DataFrame:
    views = events.where(pages.is_product_page(F.col("page")))
    return (
        views.groupBy("product_name")
        .agg(F.count("*").alias("views"), F.min("page").alias("page"))
        .orderBy(F.desc("views"), "product_name")
        .limit(n)
    )


def interaction_density(events: DataFrame) -> DataFrame:
    """Size and fill of the user × product matrix a recommender would train on."""
    touched = events.where(F.coalesce(F.col("product_id"), F.lit("")) != "")
    cells = touched.groupBy("user_id", "product_id").agg(F.count("*").alias("n"))
    sized = cells.agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("product_id").alias("products"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("interactions"),
        F.count("*").alias("cells"),
    )
    possible = F.col("users") * F.col("products")
    return sized.withColumn("density_pct", percent(F.col("cells"), possible, 4))


def data_quality(events: DataFrame) -> DataFrame:
    """Volume, newest time, and the share of missing and repeated events.

    An event repeats another when user, session, time, type and page agree.
    """
    key = ["user_id", "session_id", "ts", "event_type", "page"]
    missing = sum((flag(F.col(c).isNull()) for c in key[1:]), flag(F.col(key[0]).isNull()))
    folded = events.groupBy(*key).agg(F.count("*").alias("n")).withColumn("missing", missing)
    return folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.max("ts").alias("last_event_ts"),
        percent(F.sum(F.col("missing") * F.col("n")), F.sum("n") * len(key), 4).alias("missing_values_pct"),
        percent(F.sum("n") - F.count("*"), F.sum("n"), 4).alias("duplicate_events_pct"),
    )


def orders_from_purchases(events: DataFrame) -> DataFrame:
    """An order row per purchase event."""
    return events.where(F.col("event_type") == "purchase").select(
        "user_id",
        "session_id",
        F.col("amount").alias("total"),
        F.col("ts").alias("created_at"),
        F.lit("shop").alias("source"),
        "event_id",
    )


def recent_counts(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Events in the last hour before ``as_of`` and the last five minutes before the newest."""
    # The newest time is one bounded value; as a constant it lets the second scan skip old partitions.
    last = events.agg(F.max("ts")).first()[0]
    newest = F.lit(last).cast("timestamp")
    hour_end = F.lit(as_of) if as_of is not None else newest
    start = F.least(newest - F.expr("interval 5 minutes"), hour_end - F.expr("interval 60 minutes"))
    return events.where(F.col("ts") >= start).agg(
        count_if(
            (F.col("ts") >= hour_end - F.expr("interval 60 minutes")) & (F.col("ts") <= hour_end)
        ).alias("last_60_minutes"),
        count_if(F.col("ts") >= newest - F.expr("interval 5 minutes")).alias("last_5_minutes"),
        F.max("ts").alias("newest_ts"),
    )


def reconcile(
    events: DataFrame, sessions: DataFrame, orders: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """One agreed set of KPIs where the tables disagree.

    Sessions come from first, else last event times, else page views.  Users
    and conversion fall back to the event stream; orders are the larger of the
    table and the purchase step; order value is the first positive estimate.
    """
    base = business_kpis(events, orders, start, end)
    started = sessions.agg(
        F.struct(
            count_if(between("first_event_at", start, end)).alias("first"),
            count_if(between("last_event_at", start, end)).alias("last"),
        )
    ).scalar()
    seen = events.where(between("ts", start, end)).agg(
        F.struct(
            count_if(F.col("event_type").isin("pageview", "search")).alias("views"),
            count_if(F.col("event_type") == "purchase").alias("bought"),
        )
    ).scalar()
    wide = base.withColumns({"_s": started, "_e": seen})
    zero = F.lit(0)
    per_order = ratio(F.col("revenue"), F.col("orders"))
    per_purchase = ratio(F.col("revenue"), F.col("_e.bought"))
    return wide.select(
        F.coalesce(
            F.nullif(F.col("_s.first"), zero), F.nullif(F.col("_s.last"), zero), F.col("_e.views")
        ).alias("total_sessions"),
        "total_users",
        F.when(F.col("conversion_rate") > 0, F.col("conversion_rate"))
        .otherwise(F.round(ratio(F.col("_e.bought"), F.col("_e.views")), 4))
        .alias("conversion_rate"),
        "revenue",
        F.greatest("orders", F.col("_e.bought")).alias("orders"),
        F.round(F.when(per_order > 0, per_order).otherwise(per_purchase), 2).alias("average_order_value"),
    )


def compare_periods(
    events: DataFrame, current: tuple[datetime, datetime], previous: tuple[datetime, datetime]
) -> DataFrame:
    """Events, sessions, users, purchases and revenue of two half-open periods."""

    def inside(period):
        return (F.col("ts") >= F.lit(period[0])) & (F.col("ts") < F.lit(period[1]))

    label = F.when(inside(current), F.lit("current")).when(inside(previous), F.lit("previous"))
    bought = F.col("event_type") == "purchase"
    folded = (
        events.where(inside(current) | inside(previous))
        .groupBy(label.alias("period"), "session_id", "user_id")
        .agg(
            F.count("*").alias("n"),
            count_if(bought).alias("bought"),
            F.sum(F.when(bought, F.col("amount")).otherwise(0.0)).alias("spent"),
        )
    )
    metrics = ["events", "sessions", "users", "purchases", "revenue"]
    by_period = folded.groupBy("period").agg(
        F.sum("n").cast("double").alias("events"),
        F.countDistinct("session_id").cast("double").alias("sessions"),
        F.countDistinct("user_id").cast("double").alias("users"),
        F.sum("bought").cast("double").alias("purchases"),
        F.sum("spent").alias("revenue"),
    )
    long = by_period.unpivot("period", metrics, "metric", "value")

    def side(name):
        picked = F.max(F.when(F.col("period") == name, F.col("value")))
        return F.round(F.coalesce(picked, F.lit(0.0)), 2).alias(name)

    both = long.groupBy("metric").agg(side("current"), side("previous"))
    delta = F.col("current") - F.col("previous")
    return both.select(
        "metric",
        "current",
        "previous",
        F.round(delta, 2).alias("delta"),
        percent(delta, F.col("previous")).alias("change_pct"),
    )


def new_and_returning(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Users of the window by whether they were first seen inside it; sessions per user."""
    inside = between("ts", start, end)
    pairs = events.where(F.col("ts") <= F.lit(end)).groupBy("user_id", "session_id").agg(
        F.min("ts").alias("first_ts"), F.max(inside).alias("inside")
    )
    users = pairs.groupBy("user_id").agg(
        F.min("first_ts").alias("first_ts"), count_if(F.col("inside")).alias("sessions")
    ).where(F.col("sessions") > 0)
    is_new = F.col("first_ts") >= F.lit(start)
    return users.agg(
        count_if(is_new).alias("new_users"),
        count_if(~is_new).alias("returning_users"),
        F.round(F.avg("sessions"), 4).alias("sessions_per_user"),
    )
