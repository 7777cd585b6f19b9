"""Cart abandonment, value, timing and totals."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import traffic
from clickloom.functions.values import count_if, event_order, flag, money, one_per_id, percent, ratio
from clickloom.operators.ordered import across_slots, in_slot, with_slot
from clickloom.session import shuffled_over, written

_OPEN = ("abandoned", "active")
#: Items that a task of a join holds.
TASK = 1_000_000


def abandonment(events: DataFrame) -> DataFrame:
    """Sessions that added to the cart and those of them that never bought."""
    kind = F.col("event_type")
    sessions = events.where(kind.isin("add_to_cart", "purchase")).groupBy("session_id", "user_id").agg(
        count_if(kind == "add_to_cart").alias("adds"), count_if(kind == "purchase").alias("buys")
    )
    left = (F.col("adds") > 0) & (F.col("buys") == 0)
    return sessions.where(F.col("adds") > 0).agg(
        F.count("*").alias("total_sessions"),
        count_if(left).alias("abandoned_sessions"),
        percent(count_if(left), F.count("*")).alias("abandonment_rate"),
    )


def abandonment_flags(events: DataFrame) -> DataFrame:
    """Session counts with cart and purchase, and the conversion of cart sessions."""
    sessions = events.groupBy("session_id").agg(
        F.max(flag(F.col("event_type") == "add_to_cart")).alias("had_cart"),
        F.max(flag(F.col("event_type") == "purchase")).alias("purchased"),
    )
    conversion = F.avg(F.when(F.col("had_cart") == 1, F.col("purchased")))
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.sum("had_cart").alias("cart_sessions"),
        F.sum("purchased").alias("purchase_sessions"),
        F.round(conversion, 4).alias("conversion_rate"),
        F.round(1 - conversion, 4).alias("abandonment_rate"),
    )


def cart_sessions(events: DataFrame) -> DataFrame:
    """Largest cart size, last event and products of every session with cart events.

    The running size is summed inside time slots; a session then only adds up
    its slots, so no session is sorted as a whole.
    """
    kind = F.col("event_type")
    actions = with_slot(
        events.where(kind.isin("add_to_cart", "remove_from_cart", "checkout", "purchase"))
    )
    delta = F.when(kind == "add_to_cart", 1).when(kind == "remove_from_cart", -1).otherwise(0)
    running = in_slot().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = actions.withColumn("_delta", delta).withColumn("_size", F.sum("_delta").over(running))
    slots = sized.groupBy("session_id", "_slot").agg(
        F.max("_size").alias("_peak"),
        F.sum("_delta").alias("_net"),
        F.max(event_order()).alias("_time"),
        F.max_by("event_type", event_order()).alias("_last"),
        F.collect_set("product_id").alias("_products"),
    )
    before = across_slots().rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("_start", F.coalesce(F.sum("_net").over(before), F.lit(0)))
    return carried.groupBy("session_id").agg(
        F.max(F.col("_start") + F.col("_peak")).alias("max_items"),
        F.max_by("_last", "_time").alias("last_event"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_products")))).alias("products"),
    )


def cart_metrics(sessions: DataFrame) -> DataFrame:
    """Totals over cart_sessions()."""
    done = F.col("last_event") == "purchase"
    return sessions.agg(
        F.count("*").alias("total_carts"),
        count_if(done).alias("completed_carts"),
        F.round(1 - ratio(count_if(done), F.count("*")), 4).alias("abandonment_rate"),
        F.round(F.avg("max_items"), 4).alias("avg_items"),
    )


def abandoned_carts(sessions: DataFrame) -> DataFrame:
    """Cart sessions that held an item and did not end in a purchase."""
    return sessions.where((F.col("last_event") != "purchase") & (F.col("max_items") > 0)).select(
        "session_id", "products"
    )


def never_purchased(events: DataFrame) -> DataFrame:
    """Sessions with an add and no purchase at all."""
    kind = F.col("event_type")
    sessions = events.where(kind.isin("add_to_cart", "purchase")).groupBy("session_id").agg(
        F.bool_or(kind == "add_to_cart").alias("added"), F.bool_or(kind == "purchase").alias("bought")
    )
    return sessions.where(F.col("added") & ~F.col("bought")).select("session_id")


def most_abandoned(carts: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """Products left in open carts most often.

    ``names`` (product_id, product_name) is reduced to one name per product, so
    quantities are not multiplied; it joins the ``n`` result rows only.
    """
    top = (
        carts.where(F.col("status").isin(*_OPEN))
        .groupBy("product_id")
        .agg(
            F.countDistinct("cart_id").alias("times_abandoned"),
            F.sum("quantity").alias("total_quantity"),
            F.round(F.avg("price"), 2).alias("avg_price"),
        )
        .orderBy(F.desc("times_abandoned"), F.desc("total_quantity"), "product_id")
        .limit(n)
    )
    asked = top.select(F.col("product_id").alias("_asked"))
    wanted = names.join(asked, F.col("product_id") == F.col("_asked"))
    unique = wanted.groupBy("product_id").agg(F.max("product_name").alias("product_name"))
    return top.join(unique, "product_id", "left")


def time_to_abandon(carts: DataFrame) -> DataFrame:
    """Minutes from creation to the last change of open carts."""
    minutes = (F.unix_seconds("updated_at") - F.unix_seconds("created_at")) / F.lit(60.0)
    left = carts.where(F.col("status").isin(*_OPEN) & (F.col("updated_at") > F.col("created_at")))
    return left.agg(
        F.round(F.avg(minutes), 2).alias("avg_minutes_to_abandon"),
        F.round(F.min(minutes), 2).alias("min_minutes"),
        F.round(F.max(minutes), 2).alias("max_minutes"),
    )


def abandoned_value(carts: DataFrame) -> DataFrame:
    value = F.col("quantity") * F.col("price")
    return carts.where(F.col("status").isin(*_OPEN)).agg(
        F.round(F.sum(value), 2).alias("total_abandoned_value"),
        F.round(F.avg(value), 2).alias("avg_item_value"),
        F.countDistinct("cart_id").alias("abandoned_carts"),
    )


def value_buckets(events: DataFrame) -> DataFrame:
    """Sessions and conversion by the value added to the cart."""
    added = F.when(F.col("event_type") == "add_to_cart", money(F.col("price")))
    sessions = events.groupBy("session_id").agg(
        F.max(flag(F.col("event_type") == "purchase")).alias("purchased"),
        F.sum(added).alias("cart_value"),
    )
    value = F.col("cart_value")
    bucket = (
        F.when(value < 50, F.lit("Under $50"))
        .when(value < 100, F.lit("$50-$100"))
        .when(value < 200, F.lit("$100-$200"))
        .otherwise(F.lit("Over $200"))
    )
    return sessions.where(value > 0).groupBy(bucket.alias("value_range")).agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("purchased"), 4).alias("conversion_rate"),
        F.round(F.avg(value).cast("double"), 2).alias("avg_value"),
    )


def recovery_opportunities(events: DataFrame, n: int = 100) -> DataFrame:
    """Users with more than one abandoned cart, most valuable first.

    A cart is abandoned when nobody bought in its session.  One aggregation
    finds adds and purchases per session and user; the sessions with a purchase
    come from its rows and are taken out by a join, which Spark can split where
    one session id holds many users.
    """
    kind = F.col("event_type")
    added = kind == "add_to_cart"
    carts = events.where(kind.isin("add_to_cart", "purchase")).groupBy("session_id", "user_id").agg(
        F.max(F.when(added, F.col("price"))).alias("cart_value"),
        F.max(F.when(added, F.col("ts"))).alias("last_activity"),
        F.bool_or(kind == "purchase").alias("bought"),
    )
    sold = carts.groupBy(F.coalesce("session_id", F.lit("")).alias("_sold")).agg(F.bool_or("bought").alias("_any")).where("_any")
    adds = carts.where(F.col("last_activity").isNotNull())
    left = adds.join(sold, F.coalesce("session_id", F.lit("")) == F.col("_sold"), "left").where(F.col("_any").isNull())
    users = left.groupBy("user_id").agg(
        F.count("*").alias("abandoned_carts"),
        F.round(F.avg("cart_value"), 4).alias("avg_cart_value"),
        F.max("last_activity").alias("latest_abandonment"),
    )
    return (
        users.where(F.col("abandoned_carts") > 1).orderBy(F.desc("avg_cart_value"), "user_id").limit(n)
    )


def cart_timing(events: DataFrame) -> DataFrame:
    """Mean seconds from the first add to the purchase, or to the session's end."""
    kind = F.col("event_type")
    sessions = events.groupBy("session_id").agg(
        F.min(F.when(kind == "add_to_cart", F.col("ts"))).alias("first_add"),
        F.max(F.when(kind == "purchase", F.col("ts"))).alias("bought_at"),
        F.max("ts").alias("last_ts"),
    )
    outcome = F.when(F.col("bought_at").isNotNull(), F.lit("Purchased")).otherwise(F.lit("Abandoned"))
    seconds = F.unix_seconds(F.coalesce("bought_at", "last_ts")) - F.unix_seconds("first_add")
    return sessions.where(F.col("first_add").isNotNull()).groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("sessions"), F.round(F.avg(seconds), 2).alias("avg_time_seconds")
    )


def abandonment_by_channel(events: DataFrame) -> DataFrame:
    """1 − purchases / checkouts per channel.

    An event without a referrer counts for its session's first channel.  Rows
    are folded to a handful per session before the first channel is looked up.
    """
    named = F.coalesce(F.col("referrer"), F.lit("")) != ""
    channel = traffic.referral_channel(F.col("referrer"))
    own = F.when(named, channel)
    folded = events.groupBy("session_id", own.alias("own")).agg(
        count_if(F.col("event_type") == "checkout").alias("checkouts"),
        count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.min(F.struct("ts", "event_id", channel.alias("channel"))).alias("first"),
    )
    first = F.min("first").over(Window.partitionBy("session_id"))
    by_channel = (
        folded.withColumn("first", first)
        .groupBy(F.coalesce("own", F.col("first.channel")).alias("channel"))
        .agg(F.sum("checkouts").alias("checkouts"), F.sum("purchases").alias("purchases"))
        .where((F.col("checkouts") > 0) | (F.col("purchases") > 0))
    )
    rate = F.when(F.col("checkouts") > 0, 1 - F.col("purchases") / F.col("checkouts"))
    return by_channel.withColumn("abandonment_rate", F.round(rate, 4))


def worst_channels(by_channel: DataFrame, n: int = 3) -> DataFrame:
    """Channels with the highest positive abandonment."""
    lost = by_channel.where(F.col("abandonment_rate") > 0)
    return lost.orderBy(F.desc("abandonment_rate"), "channel").limit(n)


def _item_count():
    """Quantity of an add; a missing or zero quantity means one item."""
    return F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1))


def cart_size_distribution(events: DataFrame) -> DataFrame:
    """Carts by number of items added, all five sizes listed; mean items."""
    carts = events.where(F.col("event_type") == "add_to_cart").groupBy("session_id").agg(
        F.sum(_item_count()).alias("items")
    )
    size = F.when(F.col("items") >= 5, F.lit("5+")).otherwise(
        F.greatest(F.col("items"), F.lit(1)).cast("string")
    )
    counted = carts.groupBy(size.alias("size")).agg(F.count("*").alias("carts"))
    labels = events.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in ("1", "2", "3", "4", "5+")])).alias("size")
    )
    return labels.join(counted, "size", "left").select("size", F.coalesce("carts", F.lit(0)).alias("carts"))


def cart_size_totals(events: DataFrame) -> DataFrame:
    """Number of carts, items and the mean items per cart."""
    adds = events.where(F.col("event_type") == "add_to_cart")
    return adds.agg(
        F.countDistinct("session_id").alias("total_carts"),
        F.coalesce(F.sum(_item_count()), F.lit(0)).alias("items"),
    ).withColumn("avg_items_per_cart", F.round(ratio(F.col("items"), F.col("total_carts")), 4))


def latest_adds(events: DataFrame, n: int = 20, skip: int = 0) -> DataFrame:
    adds = events.where(F.col("event_type") == "add_to_cart")
    return (
        adds.orderBy(F.desc("ts"), "event_id")
        .offset(skip)
        .limit(n)
        .select("event_id", "ts", "user_id", "session_id", "product_id", "price", "quantity")
    )


def cart_items(carts: DataFrame) -> DataFrame:
    """Cart documents with an ``items`` array as one row per item."""
    return carts.select("*", F.inline("items")).drop("items")


def enriched_items(carts: DataFrame, products: DataFrame, rows: int | None = None) -> DataFrame:
    """Cart items with their product's name, category and line value.

    With ``rows``, the number of items, a task of the joins holds about ``TASK`` of
    them; where that takes more tasks than the session plans, the result is written.
    """
    details = one_per_id(products, "product_id", ["name", "category"])
    quantity = F.greatest(F.lit(1), F.coalesce("quantity", F.lit(1)))
    items = carts.join(details, "product_id", "left").select(
        "cart_id", "product_id", "name", "category", quantity.alias("quantity"), "price",
        F.round(F.coalesce("price", F.lit(0.0)) * quantity, 2).alias("line_value"),
    )
    spark, tasks = carts.sparkSession, -(-(rows or 0) // TASK)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return items
    with shuffled_over(spark, tasks):
        return written(items, "items")


def cart_totals(carts: DataFrame) -> DataFrame:
    """Order value per cart: Σ price × max(1, quantity)."""
    quantity = F.greatest(F.lit(1), F.coalesce("quantity", F.lit(1)))
    value = F.coalesce("price", F.lit(0.0)) * quantity
    return carts.groupBy("cart_id").agg(
        F.sum(quantity).alias("items"), F.round(F.sum(value), 2).alias("total")
    )
