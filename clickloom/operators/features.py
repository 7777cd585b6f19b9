"""Feature tables: user–product ratings, user profiles, session outcomes, baskets."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import pages
from clickloom.functions.values import count_if, flag, money, ratio

# Rating weight per event type; other types weigh 1.
WEIGHTS = {"pageview": 1.0, "add_to_cart": 3.0, "checkout": 4.0, "purchase": 8.0}


def _weight(weights: dict[str, float], default: float):
    kind = F.col("event_type")
    chain = None
    for name, value in weights.items():
        chain = (F if chain is None else chain).when(kind == name, F.lit(float(value)))
    return chain.otherwise(F.lit(default))


def interactions(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Summed rating per user and product.

    An event with a product counts for it; a checkout that only lists
    ``product_ids`` counts for each of them at the checkout weight.
    """
    table = {**WEIGHTS, **(weights or {})}
    own = F.coalesce("product_id", F.lit("")) != ""
    items = F.when(own, F.array("product_id")).otherwise(
        F.coalesce("product_ids", F.array().cast("array<string>"))
    )
    rating = F.when(own, _weight(table, 1.0)).otherwise(F.lit(table["checkout"]))
    rated = events.select("user_id", rating.alias("rating"), F.explode(items).alias("product_id"))
    return rated.groupBy("user_id", "product_id").agg(F.sum("rating").alias("rating"))


def max_ratings(events: DataFrame) -> DataFrame:
    """Strongest interaction per user and product: view 1, cart 3, purchase 5."""
    kinds = {"product_view": 1.0, "pageview": 1.0, "add_to_cart": 3.0, "purchase": 5.0}
    rated = events.where(F.col("event_type").isin(*kinds) & F.col("product_id").isNotNull())
    return rated.groupBy("user_id", "product_id").agg(F.max(_weight(kinds, 0.0)).alias("rating"))


def capped_ratings(events: DataFrame) -> DataFrame:
    """Implicit rating on a 0–5 scale: half the weighted count, 5 above ten."""
    weight = (
        F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "add_to_cart", 2).otherwise(1)
    )
    folded = events.where(F.col("product_id").isNotNull()).groupBy("user_id", "product_id").agg(
        F.count("*").alias("view_count"), F.sum(weight).alias("implicit")
    )
    scaled = F.when(F.col("implicit") > 10, 5.0).otherwise(F.round(F.col("implicit") * 5.0 / 10.0, 1))
    return folded.select("user_id", "product_id", "view_count", scaled.alias("rating"))


def rating_stats(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("product_id").alias("total_items"),
        F.count("*").alias("total_interactions"),
        F.round(F.avg("rating"), 4).alias("avg_rating"),
    )


def user_features_basic(events: DataFrame) -> DataFrame:
    """Events, sessions and rates per user."""
    sessions = events.groupBy("user_id", "session_id").agg(
        F.count("*").alias("n"),
        count_if(F.col("event_type") == "purchase").alias("bought"),
        count_if(F.col("event_type") == "add_to_cart").alias("added"),
    )
    users = sessions.groupBy("user_id").agg(
        F.sum("n").alias("total_events"),
        F.count("*").alias("sessions_count"),
        F.sum("bought").alias("bought"),
        F.sum("added").alias("added"),
    )
    return users.select(
        "user_id",
        "total_events",
        "sessions_count",
        F.round(ratio(F.col("total_events"), F.col("sessions_count")), 6).alias("avg_events_per_session"),
        F.round(ratio(F.col("bought"), F.col("total_events")), 6).alias("conversion_rate"),
        F.round(ratio(F.col("added"), F.col("total_events")), 6).alias("cart_rate"),
    )


BASIC_FEATURES = ["total_events", "sessions_count", "avg_events_per_session", "conversion_rate", "cart_rate"]


def user_features(events: DataFrame, as_of: datetime) -> DataFrame:
    """Volume, purchases, revenue, order value and recency per user."""
    kind = F.col("event_type")
    sessions = events.groupBy("user_id", "session_id").agg(
        F.count("*").alias("n"),
        count_if(kind == "pageview").alias("views"),
        count_if(kind == "add_to_cart").alias("carts"),
        count_if(kind == "checkout").alias("checkouts"),
        count_if(kind == "purchase").alias("purchases"),
        F.sum(F.when(kind == "purchase", F.col("amount")).otherwise(0.0)).alias("revenue"),
        F.max("ts").alias("last_ts"),
    )
    users = sessions.groupBy("user_id").agg(
        F.count("*").alias("sessions"),
        F.sum("n").alias("events"),
        *[F.sum(c).alias(c) for c in ("views", "carts", "checkouts", "purchases", "revenue")],
        F.max("last_ts").alias("last_ts"),
    )
    recency = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_ts")) / F.lit(86400.0)
    return users.select(
        "user_id", "sessions", "events", "views", "carts", "checkouts", "purchases",
        F.round("revenue", 2).alias("revenue"),
        F.round(ratio(F.col("revenue"), F.col("purchases")), 9).alias("aov"),
        F.round(F.coalesce(recency, F.lit(0.0)), 4).alias("recency_days"),
    )


FULL_FEATURES = [
    "sessions", "events", "views", "carts", "checkouts", "purchases", "revenue", "aov", "recency_days",
]


def customer_features(events: DataFrame, min_events: int = 5) -> DataFrame:
    """Fourteen behaviour features of users with enough events."""
    bought = F.col("event_type") == "purchase"
    folded = events.groupBy("user_id", F.to_date("ts").alias("day"), "event_type", "category").agg(
        F.count("*").alias("n"),
        F.sum(F.when(bought, money(F.col("price")))).alias("spend"),
    )
    kind = F.col("event_type")

    def total(name):
        return F.sum(F.when(kind == name, F.col("n")).otherwise(0))

    users = folded.groupBy("user_id").agg(
        F.sum("n").alias("total_events"),
        F.countDistinct("day").alias("active_days"),
        F.countDistinct("event_type").alias("unique_actions"),
        total("purchase").alias("purchases"),
        F.coalesce(F.sum("spend").cast("double"), F.lit(0.0)).alias("total_spend"),
        total("add_to_cart").alias("cart_adds"),
        total("pageview").alias("page_views"),
        F.countDistinct("category").alias("categories_viewed"),
        F.datediff(F.max("day"), F.min("day")).alias("customer_age_days"),
    ).where(F.col("total_events") >= min_events)

    def per(value, base):
        return F.round(F.col(value) / F.greatest(F.col(base), F.lit(1)), 6)

    return users.withColumns(
        {
            "total_spend": F.round("total_spend", 2),
            "avg_order_value": per("total_spend", "purchases"),
            "purchase_frequency": per("purchases", "active_days"),
            "cart_abandon_ratio": per("cart_adds", "purchases"),
            "daily_activity": per("total_events", "active_days"),
            "category_exploration": per("categories_viewed", "active_days"),
        }
    )


CUSTOMER_FEATURES = [
    "total_events", "active_days", "unique_actions", "purchases", "total_spend", "cart_adds",
    "page_views", "categories_viewed", "customer_age_days", "avg_order_value",
    "purchase_frequency", "cart_abandon_ratio", "daily_activity", "category_exploration",
]


def session_features(events: DataFrame) -> DataFrame:
    """Behaviour of a session and whether it bought.

    ``has_history`` says the user bought in an earlier session.  It compares
    each session with the user's first purchasing one, a plain aggregate, so no
    user's sessions are sorted together.
    """
    kind = F.col("event_type")
    sessions = events.groupBy("session_id").agg(
        F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"),
        F.min("ts").alias("start"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)).alias("duration"),
        count_if(kind == "pageview").cast("double").alias("page_views"),
        count_if(pages.is_product_page(F.col("page"))).cast("double").alias("product_views"),
        count_if(kind == "add_to_cart").cast("double").alias("cart_adds"),
        F.max(flag(kind == "purchase")).cast("double").alias("label"),
    )
    order = F.struct("start", "session_id")
    first_buy = sessions.where(F.col("label") == 1).groupBy("user_id").agg(F.min(order).alias("_first"))
    return sessions.join(first_buy, "user_id", "left").select(
        "session_id",
        "user_id",
        F.round("duration", 3).alias("duration"),
        "page_views",
        "product_views",
        "cart_adds",
        flag(order > F.col("_first")).cast("double").alias("has_history"),
        "label",
    )


SESSION_FEATURES = ["duration", "page_views", "product_views", "cart_adds"]


def page_baskets(events: DataFrame) -> DataFrame:
    """Distinct page families per session, for sessions with at least two."""
    seen = events.select("session_id", pages.pattern_page(F.col("page")).alias("item")).where(
        F.col("item") != ""
    )
    baskets = seen.groupBy("session_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return baskets.where(F.size("items") >= 2)


def product_baskets(events: DataFrame) -> DataFrame:
    """Products per checkout, and single products of purchases, repeats removed."""
    kind = F.col("event_type")
    listed = F.when(kind == "checkout", F.col("product_ids")).when(
        kind == "purchase", F.array("product_id")
    )
    named = F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != "")
    baskets = events.where(kind.isin("checkout", "purchase")).select(
        "event_id", F.array_distinct(named).alias("items")
    )
    return baskets.where(F.size("items") > 0)


def item_baskets(items: DataFrame) -> DataFrame:
    """(basket_id, product_id) rows as one sorted item array per basket."""
    return items.groupBy("basket_id").agg(F.sort_array(F.collect_set("product_id")).alias("items"))
