"""Event readers and the preparation step every operator builds on."""

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickloom import schema
from clickloom.functions import pages, traffic, values


def read_events(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: StructType = schema.RAW_EVENTS
) -> DataFrame:
    """Raw events with the declared schema; no inference pass over the files.

    Pass your own ``columns`` for Parquet whose ids are numbers.
    """
    return spark.read.format(fmt).schema(columns).load(path)


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """CSV with a header row and a declared schema."""
    return spark.read.csv(path, header=True, schema=columns)


def prepare(raw: DataFrame) -> DataFrame:
    """Typed events from raw ones: times parsed, ids defaulted, properties lifted.

    The time is the first of TIME_FIELDS that parses, the id ``event_id`` or
    ``_id``, and a noise flag may stand at the top or under ``flag``; fields
    that ``raw`` does not have are passed over.

    Lifting the property map into columns lets later scans of a prepared table
    read only the properties a query names.
    """
    props = F.col("properties")
    product_ids = F.from_json(props["product_ids"], "array<string>")
    times = [values.any_time(F.col(name)) for name in schema.TIME_FIELDS if name in raw.columns]
    flags = [F.col(name) for name, own in (("noisy", "noisy"), ("flag.noisy", "flag")) if own in raw.columns]
    ids = [name for name in ("event_id", "_id") if name in raw.columns]
    event_id = F.col(ids[0])
    if len(ids) > 1:  # two fields meet as text
        event_id = F.coalesce(*[F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) for name in ids])
    return raw.select(
        event_id.alias("event_id"),
        F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.lit("unknown")).alias("user_id"),
        F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.lit("unknown")).alias("session_id"),
        F.coalesce(*times).alias("ts"),
        pages.normal_page(F.col("page")).alias("page"),
        traffic.canonical_event_type(F.col("event_type")).alias("event_type"),
        props["product_id"].alias("product_id"),
        props["product_name"].alias("product_name"),
        props["category"].alias("category"),
        values.number(props["price"]).alias("price"),
        props["quantity"].try_cast("int").alias("quantity"),
        values.purchase_amount(props).alias("amount"),
        product_ids.alias("product_ids"),
        props["referrer"].alias("referrer"),
        props["utm_source"].alias("utm_source"),
        props["source"].alias("source"),
        props["search_term"].alias("search_term"),
        props["path"].alias("path"),
        F.coalesce(*[F.nullif(F.trim(props[key]), F.lit("")) for key in schema.LABEL_PROPERTIES]).alias("label"),
        (F.coalesce(*flags) if flags else F.lit(None).cast("boolean")).alias("noisy"),
    )


def time_faults(raw: DataFrame) -> DataFrame:
    """(reason, events): how many raw events prepare() can place in time, and why it cannot place the others.

    Without a time an event is in the totals, but in no window, session or series.
    """
    fields = [F.trim(F.col(name).cast("string")) for name in schema.TIME_FIELDS if name in raw.columns]
    placed = F.coalesce(*[values.any_time(text) for text in fields]).isNotNull()
    given = F.coalesce(*[F.nullif(text, F.lit("")) for text in fields]).isNotNull()
    far = F.coalesce(*[values.out_of_range(text) for text in fields], F.lit(False))
    reason = (
        F.when(placed, F.lit("placed"))
        .when(~given, F.lit("no time"))
        .when(far, F.lit("out of range"))
        .otherwise(F.lit("unreadable"))
    )
    return raw.groupBy(reason.alias("reason")).agg(F.count("*").alias("events"))


def drop_noise(events: DataFrame) -> DataFrame:
    """Real traffic only; events without the flags are kept."""
    return events.where(traffic.is_clean(F.col("noisy"), F.col("source")))


def filter_events(
    events: DataFrame,
    user: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    event_types: Iterable[str] | None = None,
    channel: str | None = None,
    segment: str | None = None,
    users: DataFrame | None = None,
    user_segments: DataFrame | None = None,
) -> DataFrame:
    """The filters common to all reports, composed so that scans can push them down.

    ``users`` (username, user_id, role) resolves a name: an unknown name gives
    an empty frame and an administrator sees everyone.  ``segment`` keeps users
    listed under it in ``user_segments``.
    """
    out = events
    if date_from is not None:
        out = out.where(F.col("ts") >= F.lit(date_from))
    if date_to is not None:
        out = out.where(F.col("ts") <= F.lit(date_to))
    if event_types is not None:
        out = out.where(F.col("event_type").isin(*event_types))
    if channel and channel != "all":
        out = out.where(F.col("referrer").rlike(f"(?i){channel}"))
    if user is not None:
        if users is None:
            out = out.where(F.col("user_id") == user)
        else:
            named = users.where(F.col("username") == user).select(
                F.col("user_id").alias("_id"), (F.col("role") == "admin").alias("_admin")
            )
            sees_all = named.agg(F.coalesce(F.bool_or("_admin"), F.lit(False))).scalar()
            own_id = named.agg(F.max("_id")).scalar()
            out = out.where(sees_all | (F.col("user_id") == own_id))
    if segment and segment != "all":
        members = user_segments.where(F.col("segment") == segment).select("user_id")
        out = out.join(members, "user_id", "left_semi")
    return out


def load_events(
    events: DataFrame,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    event_types: Iterable[str] | None = None,
    exclude_noisy: bool = True,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered, projected events; ``limit`` keeps the first by time."""
    out = filter_events(events, date_from=date_from, date_to=date_to, event_types=event_types)
    if exclude_noisy:
        out = drop_noise(out)
    if limit is not None:
        out = out.orderBy("ts", "event_id").limit(limit)
    return out.select(*columns) if columns else out


def latest_events(
    events: DataFrame, user: str | None = None, session: str | None = None, n: int = 100
) -> DataFrame:
    """A user's or session's events, newest first."""
    out = events
    if user is not None:
        out = out.where(F.col("user_id") == user)
    if session is not None:
        out = out.where(F.col("session_id") == session)
    return out.orderBy(F.desc("ts"), "event_id").limit(n)
