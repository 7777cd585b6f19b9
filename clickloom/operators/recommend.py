"""Recommendations without a model: trending, affinity, cross-sell, session context."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import count_if, one_per_id, ratio
from clickloom.operators.baskets import top_partners
from clickloom.operators.kpis import between
from clickloom.session import written

# Seconds per trending window.
TIMEFRAMES = {"hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000}


def _sales(events: DataFrame, as_of: datetime, within: str | None = None) -> DataFrame:
    """Every product's purchases in each window before ``as_of``, and its latest one, from one pass.

    With ``within`` only that window's events are read, and longer windows count no more than it.
    """
    inside = {name: between("ts", as_of - timedelta(seconds=s), as_of) for name, s in TIMEFRAMES.items()}
    bought = events.where(F.col("event_type") == "purchase")
    if within is not None:
        bought = bought.where(inside[within])
    return bought.groupBy("product_id", "product_name", "category").agg(
        *[count_if(window).alias(name) for name, window in inside.items()], F.max(F.struct("ts", "event_id")).alias("latest")
    )


def _sold(sales: DataFrame, timeframe: str) -> DataFrame:
    return sales.where(F.col(timeframe) > 0).select(
        "product_id", "product_name", "category", F.col(timeframe).alias("purchases")
    )


def _trending(sales: DataFrame, timeframe: str, n: int) -> DataFrame:
    return _sold(sales, timeframe).orderBy(F.desc("purchases"), "product_id", "category").limit(n)


def _trending_by_category(sales: DataFrame, timeframe: str, n: int) -> DataFrame:
    best = Window.partitionBy("category").orderBy(F.desc("purchases"), "product_id")
    sold = _sold(sales, timeframe).where(F.coalesce("category", F.lit("")) != "")
    return sold.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def trending(
    events: DataFrame, as_of: datetime, timeframe: str = "day", n: int = 10, category: str | None = None
) -> DataFrame:
    """Most purchased products of the last hour, day, week or month."""
    source = events if category is None else events.where(F.col("category") == category)
    return _trending(_sales(source, as_of, timeframe), timeframe, n)


def trending_by_category(events: DataFrame, as_of: datetime, timeframe: str = "week", n: int = 10) -> DataFrame:
    """trending() for every category at once."""
    return _trending_by_category(_sales(events, as_of, timeframe), timeframe, n)


def category_affinity(events: DataFrame) -> DataFrame:
    """Share of each user's events that fall into each category."""
    counted = events.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return (
        counted.withColumn("affinity", F.round(ratio(F.col("n"), total), 6))
        .where(F.col("category").isNotNull())
        .select("user_id", "category", F.col("n").alias("events"), "affinity")
    )


def _similar(sales: DataFrame, n: int) -> DataFrame:
    own = sales.groupBy("product_id").agg(F.max_by("category", "latest").alias("category"))
    leaders = _trending_by_category(sales, "week", n + 1).select(
        "category", F.col("product_id").alias("similar_id"), "purchases"
    )
    ranked = Window.partitionBy("product_id").orderBy(F.desc("purchases"), "similar_id")
    return (
        own.join(leaders, "category")
        .where(F.col("product_id") != F.col("similar_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
    )


def similar_products(events: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """For every purchased product: what trends in its category, without itself.

    The category is that of the product's latest purchase.  A category's first
    ``n + 1`` products hold every product's ``n`` others.
    """
    return _similar(_sales(events, as_of), n)


def cross_sell(events: DataFrame, n: int = 5) -> DataFrame:
    """For every purchased product: what else those sessions purchased."""
    items = events.where(F.col("event_type") == "purchase").select(
        F.col("session_id").alias("basket_id"), "product_id"
    )
    return top_partners(items, n, count_repeats=True).select(
        "product_id", "partner_id", F.col("together").alias("purchases"), "rank"
    )


def cross_sell_for(events: DataFrame, product_id: str, n: int = 5) -> DataFrame:
    """cross_sell() for one product: its sessions joined with their purchases."""
    bought = events.where(F.col("event_type") == "purchase")
    items = bought.groupBy("session_id", "product_id").agg(F.count("*").alias("times"))
    having = items.where(F.col("product_id") == product_id).select("session_id")
    others = items.where(F.col("product_id") != product_id).join(having, "session_id")
    return (
        others.groupBy("product_id").agg(F.sum("times").alias("purchases"))
        .orderBy(F.desc("purchases"), "product_id").limit(n)
    )


def _tastes(events: DataFrame) -> DataFrame:
    """Each user's categories with the adds, checkouts and purchases in them; every user has a row."""
    wanted = count_if(F.col("event_type").isin("add_to_cart", "checkout", "purchase"))
    return events.groupBy("user_id", "category").agg(wanted.alias("n"))


def _preferred(tastes: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "category")
    kept = tastes.where(F.col("n") > 0).withColumn("category_rank", F.row_number().over(order)).where(
        F.col("category_rank") <= n
    )
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return kept.withColumn("affinity", ratio(F.col("n"), total)).drop("n")


def preferred_categories(events: DataFrame, n: int = 5) -> DataFrame:
    """Each user's leading categories by adds, checkouts and purchases."""
    return _preferred(_tastes(events), n)


def _personalized(tastes: DataFrame, sales: DataFrame, n: int) -> DataFrame:
    liked = _preferred(tastes, 5).where(F.coalesce("category", F.lit("")) != "")
    popular = _trending_by_category(sales, "week", n).select(
        "category", "product_id", "purchases", F.col("rank").alias("product_rank")
    )
    order = Window.partitionBy("user_id").orderBy("category_rank", "product_rank")
    own = (
        liked.join(popular, "category")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(
            "user_id",
            "product_id",
            F.col("purchases"),
            F.round(F.greatest(F.lit(0.5), F.col("affinity")), 6).alias("confidence"),
            "rank",
        )
    )
    everyone = tastes.select("user_id").distinct()
    served = own.select("user_id", F.lit(True).alias("served")).distinct()
    without = everyone.join(served, "user_id", "left").where(F.col("served").isNull())
    top = _trending(sales, "week", n)
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("purchases")).alias("_order"), "product_id", "category", "purchases"))
    )
    fallback = without.select("user_id", F.posexplode(top.agg(ranked).scalar()).alias("pos", "item")).select(
        "user_id",
        F.col("item.product_id").alias("product_id"),
        F.col("item.purchases").alias("purchases"),
        F.lit(0.5).alias("confidence"),
        (F.col("pos") + 1).alias("rank"),
    )
    return own.unionByName(fallback)


def personalized(events: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """Trending products of each user's preferred categories; global ones otherwise.

    Categories fill the list in the order of preference.  Users none of whose
    categories sold anything get the global list, read from a one-row array.
    """
    return _personalized(_tastes(events), _sales(events, as_of, "week"), n)


def popular_products(events: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """Catalogue products by distinct viewers."""
    folded = events.where(F.col("product_id").isNotNull()).groupBy("product_id", "user_id").agg(
        F.count("*").alias("n")
    )
    viewed = folded.groupBy("product_id").agg(
        F.sum("n").alias("view_count"), F.count("*").alias("unique_viewers")
    )
    return (
        viewed.join(one_per_id(products, "product_id", ["name", "category", "price"]), "product_id")
        .orderBy(F.desc("unique_viewers"), F.desc("view_count"), "product_id")
        .limit(n)
    )


def _tag_lists(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles of each tag, apart for the tag that is the most frequent one of its profile.

    A profile that shares two tags with a session shares one besides its most
    frequent.  So the lists of most frequent tags only serve profiles with a
    single shared tag, which tie: there the first ones by product are enough, and
    the place in the list (`nth`) says which these are.
    """
    tagged = profiles.select("profile", F.explode("tags").alias("tag"))
    spread = tagged.groupBy("tag").agg(F.count("*").alias("spread"))
    commonest = tagged.join(spread, "tag").groupBy("profile").agg(F.max_by("tag", F.struct("spread", "tag")).alias("common"))
    own = profiles.select("profile", F.col("category").alias("other"), "tags", F.size("members").alias("size")).join(commonest, "profile")
    tag = F.explode(F.filter("tags", lambda t: t != F.col("common"))).alias("tag")
    rare = own.select("profile", "other", "tags", "size", tag)
    first = Window.partitionBy("common").orderBy("profile")
    return rare, own.select("profile", "other", "tags", "size", F.col("common").alias("tag"), F.row_number().over(first).alias("nth"))


def _profile_hits(known: DataFrame, profiles: DataFrame, n: int) -> DataFrame:
    """(session, profile, points) for every profile that can reach the session's top ``n``.

    The profile's number of products and the session's number of touched ones come with them.

    A session's ``least`` is the best score that its categories alone give to ``n``
    untouched products.  A category is out of reach if it stays below even with
    all tags its products have, a profile of another category if twice its tags do.
    """
    sizes = profiles.groupBy("category").agg(F.sum(F.size("members")).alias("size"), F.max(F.size("tags")).alias("most"))
    categories = known.groupBy("session_id", "category").agg(F.count("*").alias("hits")).join(sizes, "category")
    entry = F.struct(
        "category", (F.col("hits") * 5.0).alias("base"), (F.col("size") - F.col("hits")).alias("free"), "most"
    )
    tags = known.select("session_id", F.explode("tags").alias("tag")).groupBy("session_id").agg(
        F.collect_set("tag").alias("own_tags")
    )
    entries = categories.groupBy("session_id").agg(
        F.collect_list(entry).alias("entries"), F.sum("hits").alias("touched")
    )

    def offered(base):
        as_good = F.filter("entries", lambda e: e["base"] >= base)
        return F.aggregate(as_good, F.lit(0).cast("long"), lambda total, e: total + e["free"])

    least = F.array_max(F.transform("entries", lambda e: F.when(offered(e["base"]) >= n, e["base"])))
    context = entries.withColumn("least", F.coalesce(least, F.lit(0.0))).join(tags, "session_id", "left")
    n_tags = F.coalesce(F.size("own_tags"), F.lit(0))

    def shared(own):
        return F.greatest(F.size(F.array_intersect("tags", own)), F.lit(0))

    near = context.select("session_id", "own_tags", "least", "touched", n_tags.alias("n_tags"), F.inline("entries")).where(
        F.col("base") + 2.0 * F.least("most", "n_tags") >= F.col("least")
    )
    size = F.size("members").alias("size")
    by_category = near.join(profiles.select("category", "profile", "tags", size), "category").select(
        "session_id", "profile", (F.col("base") + 2.0 * shared("own_tags")).alias("points"), "size", "touched"
    )
    rare, common = _tag_lists(profiles)
    apart = context.where((n_tags > 0) & (2.0 * n_tags >= F.col("least"))).select(
        "session_id", "own_tags", "least", "touched", "entries.category", F.explode("own_tags").alias("tag")
    )
    first = apart.where(F.col("least") <= 2.0).withColumn("nth", F.explode(F.sequence(F.lit(1), (F.col("touched") + n).cast("int"))))
    columns = ["session_id", "own_tags", "least", "touched", "category", "profile", "other", "tags", "size"]
    by_tag = (
        apart.join(rare.where(F.size("tags") > 0), "tag")
        .where(2.0 * F.size("tags") >= F.col("least"))
        .select(*columns)
        .unionByName(first.join(common, ["tag", "nth"]).select(*columns))
        .where(~F.array_contains("category", F.col("other")))
        .groupBy("session_id", "profile")
        .agg(F.first(2.0 * shared("own_tags")).alias("points"), F.first("size").alias("size"), F.first("touched").alias("touched"))
    )
    return by_category.unionByName(by_tag)


def session_candidates(events: DataFrame, products: DataFrame, n: int = 12) -> DataFrame:
    """Products that fit each session: +5 per category hit, +2 per shared tag,
    −2 if viewed already; products in the cart are left out.

    Products with the same category and tags score alike, so sessions are
    matched with those profiles.  A profile behind better ones that already
    offer ``n`` products the session has not touched cannot add to the list.
    Of the others only the first untouched products by id can, as many as the
    better profiles leave room for, and those the session touched.
    """
    catalogue = products.select("product_id", "category", F.sort_array(F.array_distinct("tags")).alias("tags"))
    profiles = catalogue.groupBy("category", "tags").agg(
        F.min("product_id").alias("profile"), F.sort_array(F.collect_list("product_id")).alias("members")
    )
    touched = events.where(F.col("product_id").isNotNull()).groupBy("session_id", "product_id").agg(
        F.max(F.col("event_type").isin("add_to_cart", "checkout")).alias("in_cart"),
        F.max(F.col("event_type").isin("pageview", "product_view")).alias("viewed"),
    )
    members = profiles.select("profile", "category", "tags", F.explode("members").alias("product_id"))
    known = written(touched.join(members, "product_id"), "known")

    hits = _profile_hits(known, profiles, n)
    product = F.col("product_id")
    used = known.groupBy("session_id", "profile").agg(
        F.count("*").cast("int").alias("used"),
        F.collect_list(product).alias("own"),
        F.collect_list(F.when(~F.coalesce("in_cart", F.lit(False)), product)).alias("kept"),
        F.collect_list(F.when(F.col("viewed"), product)).alias("seen"),
    )
    better = Window.partitionBy("session_id").orderBy(F.desc("points")).rangeBetween(
        Window.unboundedPreceding, -1
    )

    def ahead(free):
        return F.coalesce(F.sum(free).over(better), F.lit(0))

    # Most profiles are out of reach even if all that the session touched were of better ones.
    free = F.col("size") - F.coalesce("used", F.lit(0))
    wanted = (
        hits.withColumn("ahead", ahead(F.col("size")))
        .where(F.col("ahead") - F.col("touched") < n)
        .join(used, ["session_id", "profile"], "left")
        .withColumn("ahead", ahead(free))
        .where(F.col("ahead") < n)
    )
    room = (n - F.col("ahead")).cast("int")
    others = F.filter(F.slice("members", F.lit(1), F.col("used") + room), lambda m: ~F.array_contains("own", m))
    offers = F.when(F.col("own").isNull(), F.slice("members", F.lit(1), room)).otherwise(
        F.concat(F.slice(others, F.lit(1), room), "kept")
    )
    scored = (
        wanted.join(profiles.select("profile", "members"), "profile")
        .select("session_id", "points", "seen", F.explode(offers).alias("product_id"))
        .withColumn("score", F.col("points") - F.when(F.array_contains("seen", F.col("product_id")), 2.0).otherwise(0.0))
    )
    best = Window.partitionBy("session_id").orderBy(F.desc("score"), "product_id")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("session_id", "product_id", "score", "rank")
    )


def keep_history(history: DataFrame, latest: DataFrame, n: int = 5) -> DataFrame:
    """Append new recommendation lists and keep each user's newest ``n``.

    Lists of the same time go by the digest of their other columns.
    """
    both = history.unionByName(latest)
    rest = [F.col(f"`{c}`") for c in both.columns if c not in ("user_id", "created_at")]
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.xxhash64(*rest) if rest else F.lit(0))
    return both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def combined(events: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """Every kind of recommendation in one frame: (kind, key, product_id, score, rank).

    The events are read three times: for sales by product, tastes by user, and
    the purchases of each session.  These tables are written and feed all parts.
    """
    sales, tastes = written(_sales(events, as_of), "sales"), written(_tastes(events), "tastes")

    def shape(df, kind, key, product, score):
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("key") if key else F.lit("all").alias("key"),
            F.col(product).alias("product_id"),
            F.col(score).cast("double").alias("score"),
            F.col("rank").cast("int").alias("rank"),
        )

    order = Window.partitionBy("kind").orderBy(F.desc("purchases"), "product_id", "category")

    def listed(kind, timeframe):
        top = _trending(sales, timeframe, n).withColumn("kind", F.lit(kind))
        return shape(top.withColumn("rank", F.row_number().over(order)), kind, None, "product_id", "purchases")

    return (
        shape(_personalized(tastes, sales, n), "personalized", "user_id", "product_id", "purchases")
        .unionByName(shape(_trending_by_category(sales, "week", n), "category", "category", "product_id", "purchases"))
        .unionByName(listed("trending", "day"))
        .unionByName(listed("seasonal", "month"))
        .unionByName(shape(_similar(sales, n), "similar", "product_id", "similar_id", "purchases"))
        .unionByName(shape(cross_sell(events, n), "cross_sell", "product_id", "partner_id", "purchases"))
    )


def interactions_in_category(events: DataFrame, user: str, category: str) -> DataFrame:
    """One user's affinity to one category."""
    own = events.where(F.col("user_id") == user)
    return own.agg(
        F.round(ratio(count_if(F.col("category") == category), F.count("*")), 6).alias("affinity")
    )
