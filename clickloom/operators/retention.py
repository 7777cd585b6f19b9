"""Cohorts, retention and customer stages."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import count_if, flag, money, percent, ratio


def _user_days(events: DataFrame) -> DataFrame:
    """One row per user and active day: all that day-grained retention needs."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))


def _user_months(events: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    return events.select("user_id", month).distinct()


def _spans(events: DataFrame) -> DataFrame:
    """Active days and days from first to last event per user."""
    return _user_days(events).groupBy("user_id").agg(
        F.min("day").alias("first_day"),
        F.count("*").alias("active_days"),
        F.datediff(F.max("day"), F.min("day")).alias("days_retained"),
    )


def signup_cohorts(events: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The latest signup dates with their size, activity and 7/30-day retention."""
    dated = users.where(F.col("created_at").isNotNull()).select(
        "user_id", F.to_date("created_at").alias("cohort_date")
    )
    cohorts = _spans(events).join(dated, "user_id").groupBy("cohort_date").agg(
        F.count("*").alias("cohort_size"),
        F.round(F.avg("active_days"), 2).alias("avg_active_days"),
        F.round(F.avg("days_retained"), 2).alias("avg_days_retained"),
        count_if(F.col("days_retained") >= 7).alias("retained_7d"),
        count_if(F.col("days_retained") >= 30).alias("retained_30d"),
    )
    return (
        cohorts.withColumns(
            {
                "retention_7d_rate": percent(F.col("retained_7d"), F.col("cohort_size")),
                "retention_30d_rate": percent(F.col("retained_30d"), F.col("cohort_size")),
            }
        )
        .orderBy(F.desc("cohort_date"))
        .limit(n)
    )


def overall_retention(events: DataFrame) -> DataFrame:
    kept7, kept30 = count_if(F.col("days_retained") >= 7), count_if(F.col("days_retained") >= 30)
    return _spans(events).agg(
        F.count("*").alias("total_users"),
        kept7.alias("retained_7d"),
        kept30.alias("retained_30d"),
        percent(kept7, F.count("*")).alias("retention_7d_rate"),
        percent(kept30, F.count("*")).alias("retention_30d_rate"),
    )


def _periods(events: DataFrame, period_days: int) -> DataFrame:
    by_user = Window.partitionBy("user_id")
    days = _user_days(events).withColumn("first_day", F.min("day").over(by_user))
    elapsed = F.datediff("day", "first_day")
    return days.select(
        "user_id",
        F.date_trunc("week", "first_day").cast("date").alias("cohort"),
        F.floor(elapsed / F.lit(period_days)).cast("int").alias("period"),
        elapsed.alias("elapsed"),
        "events",
    )


def weekly_cohorts(events: DataFrame, period_days: int = 7) -> DataFrame:
    """Active users per first week and period after the first day."""
    seen = _periods(events, period_days).select("cohort", "period", "user_id").distinct()
    return seen.groupBy("cohort", "period").agg(F.count("*").alias("users"))


def weekly_cohort_matrix(
    events: DataFrame, period_days: int = 7, n_periods: int | None = None
) -> DataFrame:
    """weekly_cohorts() with one column per period; empty cells are zero.

    Without ``n_periods`` there is a column for every period up to the last one seen.
    """
    long = weekly_cohorts(events, period_days)
    if n_periods is None:
        n_periods = (long.agg(F.max("period")).first()[0] or 0) + 1
    long = long.withColumn("period", F.concat(F.lit("p"), F.col("period").cast("string")))
    names = [f"p{i}" for i in range(n_periods)]
    return long.groupBy("cohort").pivot("period", names).agg(F.sum("users")).fillna(0, names)


def weekly_retention_totals(events: DataFrame, period_days: int = 7) -> DataFrame:
    """Users active again at least one period after their first day; mean period of all events."""
    users = _periods(events, period_days).groupBy("user_id").agg(
        F.max(flag(F.col("elapsed") >= period_days)).alias("kept"),
        F.sum(F.col("period") * F.col("events")).alias("period_sum"),
        F.sum("events").alias("events"),
    )
    return users.agg(
        F.count("*").alias("total_users"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("retained_users"),
        F.round(ratio(F.sum("kept"), F.count("*")), 4).alias("retention_rate"),
        F.round(ratio(F.sum("period_sum"), F.sum("events")), 4).alias("avg_periods"),
    )


def monthly_retention(events: DataFrame, start: datetime) -> DataFrame:
    """Share of the previous month's users active again, months without users included.

    Consecutive months of one user are neighbours in that user's short list of
    months, so no self-join is needed.
    """
    months = _user_months(events.where(F.col("ts") >= F.lit(start)))
    by_user = Window.partitionBy("user_id").orderBy("month")
    previous = F.lag("month").over(by_user)
    marked = months.withColumn("again", flag(F.add_months(previous, 1) == F.col("month")))
    active = marked.groupBy("month").agg(
        F.count("*").alias("active_users"), F.sum("again").alias("returning_users")
    )
    calendar = active.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month")
    )
    before = active.select(
        F.add_months("month", 1).alias("month"), F.col("active_users").alias("previous_users")
    )
    joined = calendar.join(active, "month", "left").join(before, "month", "left")
    is_first = F.col("month") == active.agg(F.min("month")).scalar()
    kept = F.round(ratio(F.coalesce("returning_users", F.lit(0)), F.coalesce("previous_users", F.lit(0))), 4)
    return joined.select(
        F.date_format("month", "yyyy-MM").alias("month"),
        F.coalesce("active_users", F.lit(0)).alias("active_users"),
        F.when(is_first, 0.0).otherwise(kept).alias("retention"),
        F.when(is_first, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - kept), 4)).alias("churn"),
    )


def monthly_cohorts(events: DataFrame, start: datetime, horizon: int = 6) -> DataFrame:
    """Share of each first-month cohort active in each of the next months."""
    months = _user_months(events.where(F.col("ts") >= F.lit(start)))
    first = F.min("month").over(Window.partitionBy("user_id"))
    aged = months.withColumn("cohort", first).withColumn(
        "age", F.round(F.months_between("month", "cohort")).cast("int")
    )
    active = aged.where(F.col("age") < horizon).groupBy("cohort", "age").agg(F.count("*").alias("n"))
    sizes = active.where(F.col("age") == 0).select("cohort", F.col("n").alias("size"))
    grid = sizes.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    return grid.join(active, ["cohort", "age"], "left").select(
        F.date_format("cohort", "yyyy-MM").alias("cohort"),
        "size",
        F.col("age").alias("month_no"),
        F.round(ratio(F.coalesce("n", F.lit(0)), F.col("size")), 4).alias("share"),
    )


def monthly_cohort_table(events: DataFrame) -> DataFrame:
    """Active users per cohort month and age, with the rate against the cohort's first row."""
    months = _user_months(events)
    first = F.min("month").over(Window.partitionBy("user_id"))
    aged = months.withColumn("cohort_month", first).withColumn(
        "month_number", F.round(F.months_between("month", "cohort_month")).cast("int")
    )
    counted = aged.groupBy("cohort_month", "month_number").agg(F.count("*").alias("active_users"))
    by_cohort = (
        Window.partitionBy("cohort_month")
        .orderBy("month_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    size = F.first_value("active_users").over(by_cohort)
    return counted.withColumn("cohort_size", size).withColumn(
        "retention_rate", percent(F.col("active_users"), F.col("cohort_size"))
    )


def daily_engagement(events: DataFrame) -> DataFrame:
    """Active users per day and what each of them did on average."""
    folded = events.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("n")
    )
    users = folded.groupBy("user_id", "day").agg(
        F.sum("n").alias("events"),
        F.count("*").alias("actions"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(0)).alias("purchases"),
    )
    return users.groupBy("day").agg(
        F.count("*").alias("active_users"),
        F.round(F.avg("events"), 4).alias("avg_events_per_user"),
        F.round(F.avg("actions"), 4).alias("avg_unique_actions"),
        F.sum("purchases").alias("total_purchases"),
    )


def customer_stages(events: DataFrame) -> DataFrame:
    """New, growing and established users by their lifetime in days."""
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), count_if(F.col("event_type") == "purchase").alias("bought")
    )
    users = days.groupBy("user_id").agg(
        F.datediff(F.max("day"), F.min("day")).alias("lifetime"),
        F.count("*").alias("active_days"),
        F.sum("n").alias("events"),
        F.sum("bought").alias("purchases"),
    )
    stage = (
        F.when(F.col("lifetime") < 30, F.lit("New"))
        .when(F.col("lifetime") < 90, F.lit("Growing"))
        .otherwise(F.lit("Established"))
    )
    return users.groupBy(stage.alias("customer_stage")).agg(
        F.count("*").alias("users"),
        F.round(F.avg("lifetime"), 4).alias("avg_lifetime_days"),
        F.round(F.avg("active_days"), 4).alias("avg_active_days"),
        F.round(F.avg("events"), 4).alias("avg_total_events"),
        F.round(F.avg("purchases"), 4).alias("avg_purchases"),
    )


def user_patterns(events: DataFrame, n: int = 1000) -> DataFrame:
    """The busiest users: volume, active days, action types, purchases."""
    bought = F.col("event_type") == "purchase"
    folded = events.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.when(bought, money(F.col("price")))).alias("spent"),
        F.count(F.when(bought, F.col("price"))).alias("priced"),
    )
    users = folded.groupBy("user_id").agg(
        F.sum("n").alias("total_events"),
        F.countDistinct("day").alias("active_days"),
        F.countDistinct("event_type").alias("action_types"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.sum(F.when(bought, F.col("n")).otherwise(0)).alias("purchases"),
        F.round(F.try_divide(F.sum("spent").cast("double"), F.sum("priced")), 9).alias("avg_purchase_value"),
    )
    return users.orderBy(F.desc("total_events"), "user_id").limit(n)
