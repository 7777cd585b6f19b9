"""Traffic sources, landing pages, bounce and conversion by channel."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import traffic as rules
from clickloom.functions.values import count_if, event_order, flag, percent, ratio


def with_channel(events: DataFrame, rule: str = "marketing") -> DataFrame:
    """Add ``channel`` by one of the rules: marketing, source or referral."""
    channel: Column
    if rule == "marketing":
        channel = rules.marketing_channel(F.col("referrer"), F.col("utm_source"), F.col("source"))
    elif rule == "source":
        channel = rules.traffic_source(F.col("referrer"), F.col("source"))
    elif rule == "referral":
        channel = rules.referral_channel(F.col("referrer"))
    else:
        raise ValueError(f"unknown channel rule {rule!r}")
    return events.withColumn("channel", channel)


def traffic_by(events: DataFrame, key: str = "channel") -> DataFrame:
    """Visits, users and sessions per channel (or per raw source).

    Folding to (key, session, user) first lets the two distinct counts work on
    sessions instead of events.
    """
    folded = events.groupBy(key, "session_id", "user_id").agg(F.count("*").alias("n"))
    return folded.groupBy(key).agg(
        F.sum("n").alias("visits"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("session_id").alias("sessions"),
    )


def landing_pages(events: DataFrame, n: int = 20) -> DataFrame:
    """First page view of each session, by page and channel."""
    first = F.min_by(F.struct("page", "channel", "user_id"), event_order())
    starts = events.where(F.col("event_type") == "pageview").groupBy("session_id").agg(first.alias("s"))
    return (
        starts.groupBy(F.col("s.page").alias("landing_page"), F.col("s.channel").alias("channel"))
        .agg(F.count("*").alias("sessions"), F.countDistinct("s.user_id").alias("unique_users"))
        .orderBy(F.desc("sessions"), "landing_page", "channel")
        .limit(n)
    )


def landing_conversion(events: DataFrame) -> DataFrame:
    """Path of each session's first event: sessions, visitors, share that bought."""
    sessions = events.groupBy("session_id").agg(
        F.min_by(F.struct("path", "user_id"), event_order()).alias("s"),
        F.max(flag(F.col("event_type") == "purchase")).alias("converted"),
    )
    return sessions.groupBy(F.col("s.path").alias("landing_page")).agg(
        F.count("*").alias("sessions"),
        F.countDistinct("s.user_id").alias("unique_visitors"),
        F.round(F.avg("converted"), 4).alias("conversion_rate"),
    )


def bounce_by(events: DataFrame, key: str = "channel") -> DataFrame:
    """Share of sessions that viewed a single distinct page."""
    sessions = (
        events.where(F.col("event_type") == "pageview")
        .groupBy("session_id", key)
        .agg(F.countDistinct("page").alias("pages"))
    )
    bounced = count_if(F.col("pages") == 1)
    return sessions.groupBy(key).agg(
        F.count("*").alias("total_sessions"),
        bounced.alias("bounced_sessions"),
        percent(bounced, F.count("*")).alias("bounce_rate"),
    )


def conversion_by(events: DataFrame, key: str = "channel") -> DataFrame:
    """Share of sessions with a purchase."""
    sessions = events.groupBy(key, "session_id").agg(
        F.max(flag(F.col("event_type") == "purchase")).alias("bought")
    )
    return sessions.groupBy(key).agg(
        F.count("*").alias("total_sessions"),
        F.sum("bought").alias("converted_sessions"),
        percent(F.sum("bought"), F.count("*")).alias("conversion_rate"),
    )


def channel_distribution(events: DataFrame) -> DataFrame:
    """Views and searches per referral channel, channels without any included."""
    seen = with_channel(events.where(F.col("event_type").isin("pageview", "search")), "referral")
    counted = seen.groupBy("channel").agg(F.count("*").alias("events"))
    labels = events.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in rules.REFERRAL_CHANNELS])).alias("channel")
    )
    return labels.join(counted, "channel", "left").select(
        "channel", F.coalesce("events", F.lit(0)).alias("events")
    )


def hourly_traffic(events: DataFrame) -> DataFrame:
    """Page views and visitors per hour of day."""
    views = events.where(F.col("event_type") == "pageview")
    return views.groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("visits"), F.countDistinct("user_id").alias("unique_visitors")
    )


def channel_daily(events: DataFrame) -> DataFrame:
    """Daily seo, direct and social views, side by side."""
    seen = with_channel(events.where(F.col("event_type").isin("pageview", "search")), "referral")
    names = ["seo", "direct", "social"]
    wide = seen.groupBy(F.to_date("ts").alias("day")).pivot("channel", names).agg(F.count(F.lit(1)))
    return wide.fillna(0, names)


def site_totals(events: DataFrame) -> DataFrame:
    """Views over the charted channels and all visitors."""
    seen = with_channel(events, "referral")
    charted = F.col("event_type").isin("pageview", "search") & F.col("channel").isin("seo", "direct", "social")
    users = seen.groupBy("user_id").agg(count_if(charted).alias("views"))
    return users.agg(
        F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"),
        F.count("*").alias("unique_visitors"),
        F.round(ratio(F.sum("views"), F.count("*")), 4).alias("views_per_visitor"),
    )
