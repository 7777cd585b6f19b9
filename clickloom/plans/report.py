"""Reports: named analyses over prepared tables, insight rules, KPI digest."""

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators import activity, cart, features, journey, kpis, models, recommend, retention, traffic
from clickloom.session import written
from clickloom.sources import lake


@dataclass
class Tables:
    """Prepared inputs of a report."""

    events: DataFrame
    users: DataFrame | None = None
    products: DataFrame | None = None
    carts: DataFrame | None = None
    orders: DataFrame | None = None

    def stored(self) -> "Tables":
        """The tables written once, for reports of many analyses: none prepares its input again."""
        frames = {f.name: getattr(self, f.name) for f in fields(self)}
        return Tables(**{name: df if df is None else written(df, name) for name, df in frames.items()})


@dataclass
class Report:
    """Result frames by name, and the error of each analysis that failed."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def write(self, path: str, fmt: str = "json") -> dict[str, str]:
        """One folder per frame plus a ``summary`` of what was produced."""
        failed = {**self.errors, **lake.write_results(self.frames, path, fmt)}
        if self.frames:
            spark = next(iter(self.frames.values())).sparkSession
            rows = [(n, failed.get(n)) for n in sorted({*self.frames, *failed})]
            summary = spark.createDataFrame(rows, "analysis string, error string")
            summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")
        return failed


Analysis = Callable[[Tables], DataFrame]

# Name → analysis; add your own with register().
ANALYSES: dict[str, Analysis] = {}


def register(name: str) -> Callable[[Analysis], Analysis]:
    """Decorator: offer a Tables → DataFrame function under a name."""

    def add(analysis: Analysis) -> Analysis:
        ANALYSES[name] = analysis
        return analysis

    return add


def _channelled(tables: Tables) -> DataFrame:
    return traffic.with_channel(tables.events)


register("totals")(lambda t: kpis.event_totals(t.events))
register("top_pages")(lambda t: kpis.top_pages(t.events))
register("sessions")(lambda t: kpis.session_stats(t.events))
register("time")(lambda t: activity.time_distribution(t.events))
register("seo_traffic")(lambda t: traffic.traffic_by(_channelled(t)))
register("seo_landing")(lambda t: traffic.landing_pages(_channelled(t)))
register("seo_bounce")(lambda t: traffic.bounce_by(_channelled(t)))
register("seo_conversion")(lambda t: traffic.conversion_by(_channelled(t)))
register("cart_abandonment")(lambda t: cart.abandonment(t.events))
register("cart_sizes")(lambda t: cart.cart_size_distribution(t.events))
register("cart_value")(lambda t: cart.abandoned_value(t.carts))
register("retention")(lambda t: retention.overall_retention(t.events))
register("retention_weekly")(lambda t: retention.weekly_cohorts(t.events))
register("retention_signup")(lambda t: retention.signup_cohorts(t.events, t.users))
register("journey_funnel")(lambda t: journey.ordered_funnel(t.events))
register("journey_paths")(lambda t: journey.common_paths(t.events))


def _segmentation(tables: Tables) -> DataFrame:
    table = features.user_features_basic(tables.events)
    model = models.fit_segments(table, features.BASIC_FEATURES, k=3)
    return models.segment_stats(model, table, features.BASIC_FEATURES)


def _purchase(tables: Tables) -> DataFrame:
    sessions = features.session_features(tables.events)
    return models.fit_tree(sessions, features.SESSION_FEATURES)[1]


def _patterns(tables: Tables) -> DataFrame:
    return models.association_rules(models.fit_patterns(features.page_baskets(tables.events), 0.1, 0.3))


register("conversion")(lambda t: journey.event_funnel(t.events))
register("conversion_sessions")(lambda t: journey.session_funnel(t.events))
register("segmentation")(_segmentation)
register("purchase")(_purchase)
register("patterns")(_patterns)
register("recommendations")(lambda t: recommend.popular_products(t.events, t.products))


def build_report(tables: Tables, names: list[str] | None = None) -> Report:
    """The named analyses; one that fails is recorded and the rest go on."""
    report = Report()
    for name in names or list(ANALYSES):
        try:
            report.frames[name] = ANALYSES[name](tables)
        except Exception as error:  # a missing table or column must not stop the others
            report.errors[name] = f"{type(error).__name__}: {error}".splitlines()[0]
    return report


def _rule(condition: Column, kind: str, metric: Column, value: Column) -> Column:
    row = F.struct(F.lit(kind).alias("kind"), metric.alias("metric"), value.cast("double").alias("value"))
    return F.when(condition, row)


def insight_rules(totals: DataFrame, funnels: DataFrame) -> DataFrame:
    """Findings, alerts and recommendations from one KPI row and the page funnels.

    ``totals`` needs bounce_rate and avg_session_seconds; ``funnels`` needs
    funnel, entered and conversion.
    """
    bounce, seconds = F.col("bounce_rate"), F.col("avg_session_seconds")
    overall = [
        _rule(bounce > 0.7, "finding_high_bounce", F.lit("bounce_rate"), bounce),
        _rule(bounce < 0.3, "finding_low_bounce", F.lit("bounce_rate"), bounce),
        _rule(seconds > 300, "finding_long_sessions", F.lit("avg_session_seconds"), seconds),
        _rule(seconds < 60, "finding_short_sessions", F.lit("avg_session_seconds"), seconds),
        _rule(bounce > 0.5, "recommend_reduce_bounce", F.lit("bounce_rate"), bounce),
        _rule(seconds < 120, "recommend_engagement", F.lit("avg_session_seconds"), seconds),
    ]
    rate = F.col("conversion")
    per_funnel = [
        _rule(rate > 0.3, "finding_strong_funnel", F.col("funnel"), rate),
        _rule((rate > 0) & (rate < 0.1), "alert_weak_funnel", F.col("funnel"), rate),
        _rule(
            (rate < 0.1) & F.col("funnel").startswith("home_") & (F.col("entered") > 10),
            "recommend_fix_funnel", F.col("funnel"), rate,
        ),
    ]

    def fired(df: DataFrame, rules: list[Column]) -> DataFrame:
        return df.select(F.inline(F.array_compact(F.array(*rules))))

    return fired(totals, overall).unionByName(fired(funnels, per_funnel))


def kpi_digest(events: DataFrame, start: datetime, n_sources: int = 5) -> DataFrame:
    """The largest funnel drop, the leading sources and the latest retention."""
    funnel = journey.event_funnel(events)
    drops = funnel.where(F.col("step_no") > 1).select(
        F.lit("largest_drop").alias("kind"),
        F.col("step").alias("name"),
        F.round((1 - F.col("rate")) * 100, 2).alias("value"),
    )
    top_drop = drops.orderBy(F.desc("value"), "name").limit(1)
    sources = traffic.channel_distribution(events)
    total = sources.agg(F.sum("events")).scalar()
    shares = (
        sources.select(
            F.lit("top_source").alias("kind"),
            F.col("channel").alias("name"),
            F.round(F.coalesce(F.try_divide(F.col("events") * 100.0, total), F.lit(0.0)), 2).alias("value"),
        )
        .orderBy(F.desc("value"), "name")
        .limit(n_sources)
    )
    months = retention.monthly_retention(events, start)
    latest = months.groupBy(F.lit("latest_retention").alias("kind")).agg(
        F.max("month").alias("name"), F.round(F.max_by("retention", "month") * 100, 2).alias("value")
    )
    return top_drop.unionByName(shares).unionByName(latest)
