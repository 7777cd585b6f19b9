"""Funnels, paths, drop-off and transitions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import pages
from clickloom.functions.values import count_if, event_order, flag, percent, ratio
from clickloom.operators.ordered import across_slots, in_slot, keep_sessions, with_slot


def shop_steps() -> dict[str, Column]:
    """The six purchase steps, each a condition on event_type and page_base."""
    base, kind = F.col("page_base"), F.col("event_type")
    return {
        "home_visit": base == "/home",
        "category_view": base.isin("/category", "/search"),
        "product_view": base == "/product",
        "add_to_cart": (kind == "add_to_cart") | (base == "/cart"),
        "checkout_start": (base == "/checkout") | (kind == "checkout"),
        "purchase": kind == "purchase",
    }


def ordered_funnel(events: DataFrame, steps: dict[str, Column] | None = None) -> DataFrame:
    """Sessions reaching each step after every earlier one, and the step rates.

    A session reaches a step when, for each earlier step, some event of the step
    is later than some event of the earlier one.  That holds exactly when the
    step's last time is after the earlier step's first time, so two times per
    step and session decide everything: one aggregation, no self-join.
    Steps may use every event column and ``page_base``.
    """
    steps = steps or shop_steps()
    events = events.withColumn("page_base", pages.page_base(F.col("page")))
    names = list(steps)
    bounds = []
    for i, condition in enumerate(steps.values()):
        time = F.when(condition, F.col("ts"))
        bounds += [F.min(time).alias(f"first{i}"), F.max(time).alias(f"last{i}")]
    sessions = events.groupBy("session_id").agg(*bounds)
    reached = []
    for i in range(len(names)):
        after_all = F.col(f"first{i}").isNotNull()
        for j in range(i):
            after_all = after_all & (F.col(f"last{i}") > F.col(f"first{j}"))
        reached.append(count_if(after_all).alias(f"n{i}"))
    totals = sessions.agg(*reached)
    rows = [
        F.struct(
            F.lit(i + 1).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"n{i}").alias("sessions"),
            (
                F.round(ratio(F.col(f"n{i}") * 100.0, F.col(f"n{i - 1}")), 1) if i else F.lit(100.0)
            ).alias("rate_pct"),
        )
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*rows)))


def event_funnel(events: DataFrame) -> DataFrame:
    """Event counts from views to purchases, each with its rate to the step before."""
    kind = F.col("event_type")
    totals = events.agg(
        count_if(kind.isin("pageview", "search")).alias("n0"),
        count_if(kind == "add_to_cart").alias("n1"),
        count_if(kind == "checkout").alias("n2"),
        count_if(kind == "purchase").alias("n3"),
    )
    names = ("Views", "Add to Cart", "Checkout", "Purchase")
    rows = [
        F.struct(
            F.lit(i + 1).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"n{i}").alias("events"),
            (F.round(ratio(F.col(f"n{i}"), F.col(f"n{i - 1}")), 4) if i else F.lit(1.0)).alias("rate"),
        )
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*rows)))


def session_funnel(events: DataFrame) -> DataFrame:
    """Sessions that viewed, added to cart and purchased, in any order."""
    kind = F.col("event_type")
    sessions = events.where(kind.isin("pageview", "add_to_cart", "purchase")).groupBy("session_id").agg(
        F.max(flag(kind == "pageview")).alias("viewed"),
        F.max(flag(kind == "add_to_cart")).alias("added"),
        F.max(flag(kind == "purchase")).alias("bought"),
    )
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("viewed"), F.lit(0)).alias("viewed"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added_to_cart"),
        F.coalesce(F.sum("bought"), F.lit(0)).alias("purchased"),
        percent(F.sum("added"), F.sum("viewed")).alias("view_to_cart_rate"),
        percent(F.sum("bought"), F.sum("added")).alias("cart_to_purchase_rate"),
    )


def page_funnels(events: DataFrame) -> DataFrame:
    """Sessions with the first page of each pair, and those that have both."""
    page = F.col("page")
    sessions = events.groupBy("session_id").agg(
        F.max(flag(page == "/home")).alias("home"),
        F.max(flag(page.startswith("/product") | page.startswith("/p/"))).alias("product"),
        F.max(flag(page == "/checkout")).alias("checkout"),
        F.max(flag(page == "/search")).alias("search"),
    )
    pairs = (("home", "product"), ("product", "checkout"), ("home", "checkout"), ("search", "product"))
    totals = sessions.agg(
        *[F.coalesce(F.sum(a), F.lit(0)).alias(f"in_{a}_{b}") for a, b in pairs],
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"both_{a}_{b}") for a, b in pairs],
    )
    rows = [
        F.struct(
            F.lit(f"{a}_to_{b}").alias("funnel"),
            F.col(f"in_{a}_{b}").alias("entered"),
            F.col(f"both_{a}_{b}").alias("converted"),
            F.round(ratio(F.col(f"both_{a}_{b}"), F.col(f"in_{a}_{b}")), 4).alias("conversion"),
        )
        for a, b in pairs
    ]
    return totals.select(F.inline(F.array(*rows)))


def common_paths(events: DataFrame, max_steps: int = 5, n: int = 20) -> DataFrame:
    """The first page views of each session as a path; frequency and conversion.

    The row-number limit is applied before the shuffle too, so a session of any
    size sends at most ``max_steps`` rows per input partition.
    """
    first = Window.partitionBy("session_id").orderBy("ts", "event_id")
    views = (
        events.where(F.col("event_type") == "pageview")
        .select("session_id", "page", F.row_number().over(first).alias("step"))
        .where(F.col("step") <= max_steps)
    )
    steps = F.array_sort(F.collect_list(F.struct("step", "page")))
    paths = views.groupBy("session_id").agg(
        F.array_join(F.transform(steps, lambda s: s["page"]), " -> ").alias("path")
    )
    buyers = events.where(F.col("event_type") == "purchase").select("session_id").distinct()
    flagged = paths.join(buyers.withColumn("bought", F.lit(1)), "session_id", "left")
    return (
        flagged.groupBy("path")
        .agg(F.count("*").alias("frequency"), F.count("bought").alias("conversions"))
        .withColumn("conversion_rate", percent(F.col("conversions"), F.col("frequency")))
        .orderBy(F.desc("frequency"), "path")
        .limit(n)
    )


def _frequent_paths(steps: DataFrame, separator: str, min_freq: int) -> DataFrame:
    """Sessions per full path of ``step`` values, for paths seen ``min_freq`` times.

    A path can only be that frequent when as many sessions share its length and
    an order-free checksum of its steps.  Both are cheap sums, so sessions that
    cannot qualify are dropped before any path is put together.  This is exact,
    and a session large enough to hurt has too few equals to survive it.
    """
    checksum = F.sum(F.pmod(F.xxhash64("step"), F.lit(1 << 31)))
    signatures = steps.groupBy("session_id").agg(F.count("*").alias("n"), checksum.alias("sum"))
    shared = signatures.groupBy("n", "sum").agg(F.count("*").alias("sessions"))
    shared = shared.where(F.col("sessions") >= min_freq)
    candidates = signatures.join(shared, ["n", "sum"], "left_semi").select("session_id")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "step")))
    return (
        keep_sessions(steps, candidates)
        .groupBy("session_id")
        .agg(
            F.array_join(F.transform(ordered, lambda s: s["step"]), separator).alias("path"),
            F.max("bought").alias("bought"),
        )
        .groupBy("path")
        .agg(F.count("*").alias("frequency"), F.sum("bought").alias("conversions"))
        .where(F.col("frequency") >= min_freq)
    )


def event_paths(events: DataFrame, min_freq: int = 10) -> DataFrame:
    """Frequent full sequences of event types."""
    steps = events.select(
        "session_id", "ts", "event_id",
        F.col("event_type").alias("step"),
        F.lit(0).alias("bought"),
    )
    return _frequent_paths(steps, "->", min_freq).select("path", "frequency")


def path_length_stats(events: DataFrame) -> DataFrame:
    """Path lengths over all sessions, and the share that reaches checkout."""
    sessions = events.groupBy("session_id").agg(
        F.count("*").alias("n"), F.max(flag(F.col("event_type") == "checkout")).alias("checkout")
    )
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("n"), 4).alias("average_length"),
        F.percentile_approx("n", 0.5).alias("median_length"),
        F.max("n").alias("max_length"),
        F.round(F.avg("checkout"), 4).alias("conversion_rate"),
    )


def conversion_paths(events: DataFrame, min_freq: int = 5) -> DataFrame:
    """Frequent full sequences of 'type:path' steps with their conversion."""
    step = F.concat("event_type", F.coalesce(F.concat(F.lit(":"), F.col("path")), F.lit("")))
    steps = events.select(
        "session_id", "ts", "event_id",
        step.alias("step"),
        flag(F.col("event_type") == "purchase").alias("bought"),
    )
    return _frequent_paths(steps, " > ", min_freq).withColumn(
        "conversion_rate", F.round(ratio(F.col("conversions"), F.col("frequency")), 4)
    )


def drop_off(events: DataFrame) -> DataFrame:
    """How often each (type, path) occurs and how often it ends a session.

    The end of a session is its newest event, a plain aggregate; no window.
    """
    seen = events.groupBy("event_type", "path").agg(F.count("*").alias("occurrences"))
    last = F.max_by(F.struct("event_type", "path"), event_order())
    ends = events.groupBy("session_id").agg(last.alias("e"))
    ended = ends.groupBy("e.event_type", "e.path").agg(F.count("*").alias("dropoffs"))
    same = seen["event_type"].eqNullSafe(ended["event_type"]) & seen["path"].eqNullSafe(ended["path"])
    return seen.join(ended, same).select(
        seen["event_type"],
        seen["path"],
        "occurrences",
        "dropoffs",
        percent(F.col("dropoffs"), F.col("occurrences")).alias("dropoff_rate"),
    )


def length_impact(events: DataFrame) -> DataFrame:
    """Conversion by number of steps in the session."""
    folded = events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    sessions = folded.groupBy("session_id").agg(
        F.sum("n").alias("steps"),
        F.count("*").alias("unique_steps"),
        F.max(flag(F.col("event_type") == "purchase")).alias("converted"),
    )
    bucket = (
        F.when(F.col("steps") < 5, F.lit("Very Short (1-4)"))
        .when(F.col("steps") < 10, F.lit("Short (5-9)"))
        .when(F.col("steps") < 20, F.lit("Medium (10-19)"))
        .otherwise(F.lit("Long (20+)"))
    )
    return sessions.groupBy(bucket.alias("journey_length")).agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("steps"), 4).alias("avg_steps"),
        F.round(F.avg("unique_steps"), 4).alias("avg_unique_steps"),
        F.round(F.avg("converted"), 4).alias("conversion_rate"),
    )


def entry_channels(events: DataFrame) -> DataFrame:
    """Journey length and conversion by the source of a session's first event."""
    sessions = events.groupBy("session_id").agg(
        F.min_by(F.struct("source"), event_order()).alias("first"),
        F.count("*").alias("steps"),
        F.max(flag(F.col("event_type") == "purchase")).alias("converted"),
    )
    return sessions.groupBy(F.col("first.source").alias("entry_channel")).agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("steps"), 4).alias("avg_journey_length"),
        F.sum("converted").alias("conversions"),
        F.round(F.avg("converted"), 4).alias("conversion_rate"),
    )


def _label(kind: Column, seen: Column) -> Column:
    spaced = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    return (
        F.when((kind == "search") | kind.contains("view"), F.coalesce(seen, F.lit("Page")))
        .when(kind == "add_to_cart", F.lit("Add to Cart"))
        .when(kind == "checkout", F.lit("Checkout"))
        .when(kind == "purchase", F.lit("Purchase"))
        .otherwise(F.replace(spaced, F.lit(" "), F.lit("_")))
    )


def _stage(label: Column) -> Column:
    return (
        F.when(label == "Add to Cart", 1).when(label == "Checkout", 2).when(label == "Purchase", 3).otherwise(0)
    )


def transitions(events: DataFrame) -> DataFrame:
    """Forward moves between labelled steps, one row per session and move.

    Neighbours inside a slot come from a window over the slot; the move into
    each slot comes from the last label of the slot before it.
    """
    seen = F.coalesce(*[F.col(c) for c in ("label", "path") if c in events.columns])
    kind = F.lower(F.coalesce("event_type", F.lit("")))
    labelled = with_slot(events).withColumn("label", _label(kind, seen))
    labelled = labelled.where(F.col("label") != "").select("session_id", "_slot", "ts", "event_id", "label")
    inside = labelled.withColumn("source", F.lag("label").over(in_slot())).select(
        "session_id", "source", F.col("label").alias("target")
    )
    ends = labelled.groupBy("session_id", "_slot").agg(
        F.min_by("label", event_order()).alias("target"), F.max_by("label", event_order()).alias("_last")
    )
    between = ends.withColumn("source", F.lag("_last").over(across_slots())).select(
        "session_id", "source", "target"
    )
    moves = inside.unionByName(between)
    return moves.where(_stage(F.col("source")) < _stage(F.col("target"))).where(
        F.col("source").isNotNull()
    ).distinct()


def transition_links(events: DataFrame, top_n: int = 40) -> DataFrame:
    """The busiest links of the journey graph, counted once per session."""
    return (
        transitions(events)
        .groupBy("source", "target")
        .agg(F.count("*").alias("value"))
        .orderBy(F.desc("value"), "source", "target")
        .limit(top_n)
    )


def transition_nodes(events: DataFrame) -> DataFrame:
    """Every label that takes part in a forward move."""
    moves = transitions(events).select(F.explode(F.array("source", "target")).alias("node"))
    return moves.distinct()
