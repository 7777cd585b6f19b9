"""Event validation, enrichment, catalogue browsing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.functions import pages, values


def validate(raw: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first rule an event breaks, or null.

    Works on batch and streaming frames alike.
    """
    reasons = [
        F.when(F.col(name).isNull(), F.lit(f"missing {name}"))
        for name in ("user_id", "session_id", "event_type", "page", "timestamp", "properties")
    ]
    epoch = F.col("timestamp").try_cast("double")
    reasons += [
        F.when(epoch.isNull(), F.lit("bad type timestamp")),
        F.when(~F.col("event_type").isin(*schema.EVENT_TYPES), F.lit("bad event_type")),
        F.when((epoch <= 0) | values.epoch_time(epoch).isNull(), F.lit("bad timestamp")),
        F.when(~F.col("page").startswith("/"), F.lit("bad page")),
    ]
    return raw.withColumn("reject_reason", F.coalesce(*reasons))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())


def normalize_pages(events: DataFrame) -> DataFrame:
    """Normal form and family of every page."""
    return events.withColumns(
        {"page": pages.normal_page(F.col("page")), "page_base": pages.page_base(F.col("page"))}
    )


def canonical_pages(events: DataFrame, id_length: int | None = None) -> DataFrame:
    """Product and category URLs that agree with the event's properties."""
    product = pages.canonical_product_page(F.col("page"), F.col("product_id"), id_length)
    return events.withColumn("page", product).withColumn(
        "page", pages.canonical_category_page(F.col("page"), F.col("category"))
    )


def enrich(events: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``product_details`` and ``user_details`` structs, null where unknown.

    Plain left joins: Spark broadcasts a side that is small enough by its own
    size estimate and otherwise shuffles, so a large user table stays safe.
    A repeated product or user is used once.
    """
    details = values.one_per_id(products, "product_id", ["name", "category", "price"]).select(
        "product_id", F.struct("name", "category", "price").alias("product_details")
    )
    people = values.one_per_id(users, "user_id", ["username", "created_at"]).select(
        "user_id", F.struct("username", "created_at").alias("user_details")
    )
    return events.join(details, "product_id", "left").join(people, "user_id", "left")


def canonical_ids(df: DataFrame, column: str) -> DataFrame:
    """Replace an id by its 24-digit form, null when it is none."""
    return df.withColumn(column, values.object_id(F.col(column)))


def browse(
    products: DataFrame,
    category: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    tags: list[str] | None = None,
    search: str | None = None,
    sort: str = "name",
    descending: bool = False,
    offset: int = 0,
    n: int = 20,
) -> DataFrame:
    """One page of the catalogue, with the number of all matches as ``total``."""
    found = products
    if category is not None:
        found = found.where(F.col("category") == category)
    if min_price is not None:
        found = found.where(F.col("price") >= min_price)
    if max_price is not None:
        found = found.where(F.col("price") <= max_price)
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if search:
        pattern = f"(?i){search}"
        found = found.where(
            F.col("name").rlike(pattern)
            | F.col("category").rlike(pattern)
            | F.exists("tags", lambda tag: tag.rlike(pattern))
        )
    key = F.desc(sort) if descending else F.asc(sort)
    total = found.agg(F.count("*")).scalar()
    return found.orderBy(key, "product_id").offset(offset).limit(n).withColumn("total", total)


def categories(products: DataFrame) -> DataFrame:
    """Distinct category names, sorted."""
    return products.where(F.col("category").isNotNull()).select("category").distinct().orderBy("category")
