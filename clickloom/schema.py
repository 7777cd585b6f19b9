"""Canonical table schemas and the fixed event vocabulary."""

from pyspark.sql import types as T

# Event types the shop's tracker may send.
EVENT_TYPES = (
    "pageview",
    "search",
    "product_view",
    "add_to_cart",
    "remove_from_cart",
    "checkout",
    "purchase",
    "login",
    "signup",
    "logout",
)

# Other spellings of an event type, folded on load.
EVENT_TYPE_ALIASES = {
    "page_view": "pageview",
    "view_product": "product_view",
    "checkout_start": "checkout",
    "conversion": "purchase",
}

# Sources that mark generated test traffic.
NOISY_SOURCES = ("simulation", "basic_sim", "seed_demo")

# Property keys that may carry a purchase total, best first.
AMOUNT_KEYS = ("total_amount", "total", "amount", "value", "cart_total")

# Property keys that prepare() lifts out of the map into typed columns.
STRING_PROPERTIES = (
    "product_id",
    "product_name",
    "category",
    "referrer",
    "utm_source",
    "source",
    "search_term",
    "path",
)

# Fields that may carry an event's time, best first.
TIME_FIELDS = ("occurred_at", "processed_at", "occurred_at_iso", "timestamp")

# Properties that name the page a visitor saw, best first.
LABEL_PROPERTIES = ("page", "title", "name")

# Ids are text: numbers, object ids or whatever the tracker sends.
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("processed_at", T.StringType()),
        T.StructField("occurred_at_iso", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("noisy", T.BooleanType()),
        T.StructField("flag", T.StructType([T.StructField("noisy", T.BooleanType())])),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("page", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("product_ids", T.ArrayType(T.StringType())),
        T.StructField("referrer", T.StringType()),
        T.StructField("utm_source", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("search_term", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("noisy", T.BooleanType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("first_event_at", T.TimestampType()),
        T.StructField("last_event_at", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("pages", T.ArrayType(T.StringType())),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

USERS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CARTS = T.StructType(
    [
        T.StructField("cart_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
    ]
)

# One message on the event topic: {"event": {...}, "metadata": {...}}.
STREAM_MESSAGE = T.StructType(
    [
        T.StructField(
            "event",
            T.StructType(
                [
                    T.StructField("event_id", T.StringType()),
                    T.StructField("_id", T.StringType()),
                    T.StructField("session_id", T.StringType()),
                    T.StructField("user_id", T.StringType()),
                    T.StructField("page", T.StringType()),
                    T.StructField("event_type", T.StringType()),
                    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("timestamp", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
