from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import activity, kpis
from clickloom.plans import report
from clickloom.sources import adapter
from frames import DAY, at, records


def orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, user_id string, total double, created_at timestamp")


def test_totals_and_shares(make_events):
    events = make_events([{"session_id": "a"}, {"session_id": "b", "user_id": "u2"}, {"event_type": "search", "session_id": "a"}])
    assert records(kpis.event_totals(events)) == [(3, 2, 2)]
    assert records(kpis.event_totals(events.limit(0))) == [(0, 0, 0)]
    assert records(kpis.event_totals(events, approximate=True)) == [(3, 2, 2)]
    shares = {r.event_type: r.share_pct for r in kpis.event_type_shares(events).collect()}
    assert shares == {"pageview": 66.67, "search": 33.33}


def test_session_stats_medians(make_events):
    rows = [{"session_id": "a", "ts": at(m)} for m in (0, 1, 4)] + [{"session_id": "b", "ts": at(2)}]
    stats = kpis.session_stats(make_events(rows)).first()
    assert (stats.total_events, stats.total_sessions, stats.median_events_per_session) == (4, 2, 2.0)
    assert (stats.max_session_seconds, stats.median_session_seconds, stats.bounce_rate) == (240, 120.0, 0.5)
    detail = kpis.session_detail(make_events(rows)).collect()
    assert [(r.session_id, r.duration_seconds, r.unique_pages) for r in detail] == [("a", 240.0, 1)]


def test_revenue_is_never_counted_twice(spark, make_events):
    events = make_events([{"event_type": " Purchase ", "amount": 40.0}, {"event_type": "purchase", "amount": 2.5}, {}])
    end = DAY + timedelta(days=1)
    none = kpis.business_kpis(events, orders(spark, []), DAY, end).first()
    assert (none.revenue, none.orders, none.average_order_value, none.conversion_rate) == (42.5, 2, 21.25, 2.0)
    some = kpis.business_kpis(events, orders(spark, [(1, "u", 99.0, at(1))]), DAY, end).first()
    assert (some.revenue, some.orders) == (99.0, 1)
    empty = kpis.business_kpis(events.limit(0), orders(spark, []), DAY, end).first()
    assert (empty.revenue, empty.orders, empty.conversion_rate, empty.last_event_ts) == (0.0, 0, 0.0, None)


def test_reconcile_takes_fallbacks(spark, make_events):
    events = make_events([{}, {"event_type": "purchase", "amount": 8.0}])
    late = spark.createDataFrame([("s", "u", at(-5000), at(1), 1, ["/"])], schema.SESSIONS)
    row = kpis.reconcile(events, late, orders(spark, [(1, "u", 6.0, at(0))]), DAY, DAY + timedelta(days=1)).first()
    assert (row.total_sessions, row.orders, row.revenue, row.average_order_value) == (1, 1, 6.0, 6.0)
    unseen = kpis.reconcile(events, late.limit(0), orders(spark, []), DAY, DAY + timedelta(days=1)).first()
    assert unseen.total_sessions == 1


def test_trend_buckets_are_half_open(make_events):
    end = DAY + timedelta(days=2)
    events = make_events([{"ts": DAY}, {"ts": DAY + timedelta(days=1)}, {"ts": end}, {"ts": end + timedelta(seconds=1)}])
    rows = records(activity.trend(events, "events", "daily", DAY, end).orderBy("bucket_start"))
    assert [r[2] for r in rows] == [1, 1, 1]
    assert [r.value for r in activity.trend(events.limit(0), "sessions", "weekly", DAY, end).collect()] == [0]
    with pytest.raises(ValueError):
        activity.trend(events, "nonsense", "daily", DAY, end)


def test_histogram_facets_agree(make_events):
    events = make_events([{"ts": at(60 * h + d * 1440)} for d, h in ((0, 3), (0, 3), (0, 5), (1, 5), (2, 23), (2, 22), (2, 1))])
    end = DAY + timedelta(days=5)

    def facet(name):
        return [(r.bucket, r.events) for r in activity.activity_histogram(events, DAY, end, 0, name).orderBy("bucket").collect()]

    assert len(facet("hourly")) == 24 and sum(n for _, n in facet("hourly")) == 7
    assert len(facet("dow")) == 7 and sum(n for _, n in facet("dow")) == 7
    assert facet("peak_day") == [("2024-01-01", 3)] and facet("peak_hour") == [("03:00", 2)]
    assert facet("top_days") == [("2024-01-02", 1), ("2024-01-03", 3)]
    shifted = activity.activity_histogram(events, DAY, end, tz_offset_minutes=60, facet="peak_hour").first()
    assert shifted.bucket == "02:00"


def test_minute_totals_sum_alike(make_events):
    minutes = activity.minute_counts(make_events([{"ts": at(m / 2), "page": f"/{m % 2}"} for m in range(10)]))
    totals = activity.minute_totals(minutes, at(60), 60)
    sums = {r.kind: r.n for r in totals.groupBy("kind").agg(F.sum("events").alias("n")).collect()}
    assert sums == {"minute": 10, "page": 10, "event_type": 10}


def test_rates_density_quality(make_events):
    events = make_events(
        [
            {"session_id": "a", "page": "/x", "product_id": "1"},
            {"session_id": "a", "page": "/x", "product_id": "1"},
            {"session_id": "b", "page": "/y", "product_id": "2", "user_id": "u2"},
            {"session_id": "b", "page": None, "product_id": None, "user_id": None},
        ]
    )
    assert {r.page: r.visit_rate for r in kpis.page_rates(events).collect()}["/x"] == 0.5
    assert records(kpis.revisit_rates(events)) == [(2, 0.0, 0.5)]
    assert records(kpis.interaction_density(events)) == [(2, 2, 3, 2, 50.0)]
    same = events.withColumn("ts", F.lit(at(0)))
    quality = kpis.data_quality(same).first()
    assert (quality.total_events, quality.missing_values_pct, quality.duplicate_events_pct) == (4, 10.0, 25.0)


def test_active_users_threshold(make_events):
    rows = [{"user_id": "busy", "product_id": str(i % 3)} for i in range(12)]
    rows += [{"user_id": "idle", "product_id": "1"}] * 4 + [{"user_id": "none", "product_id": ""}] * 9
    events = make_events(rows)
    got = kpis.active_users(events).collect()
    assert [(r.user_id, r.total_interactions, r.unique_products) for r in got] == [("busy", 12, 3)]
    assert records(kpis.activity_buckets(events)) == [("11-50", 1)]


def test_compare_and_new_users(make_events):
    rows = [{"ts": at(-10), "user_id": "old"}, {"ts": at(10), "user_id": "old"}, {"ts": at(20), "user_id": "new"}]
    rows.append({"ts": at(30), "user_id": "new", "event_type": "purchase", "amount": 5.0})
    events = make_events(rows)
    end = at(100)
    got = {r.metric: (r.current, r.previous, r.change_pct) for r in kpis.compare_periods(events, (DAY, end), (at(-60), DAY)).collect()}
    assert got["events"] == (3.0, 1.0, 200.0) and got["revenue"] == (5.0, 0.0, 0.0)
    assert records(kpis.new_and_returning(events, DAY, end)) == [(1, 1, 1.0)]
    assert records(kpis.recent_counts(events)) == [(4, 1, at(30))]


def test_insight_rules_fire_once_each(spark):
    totals = spark.createDataFrame([(0.8, 30.0)], "bounce_rate double, avg_session_seconds double")
    funnels = spark.createDataFrame(
        [("home_to_product", 20, 0.05), ("search_to_product", 20, 0.5), ("home_to_checkout", 5, 0.0)],
        "funnel string, entered long, conversion double",
    )
    kinds = sorted(r.kind for r in report.insight_rules(totals, funnels).collect())
    assert kinds == [
        "alert_weak_funnel", "finding_high_bounce", "finding_short_sessions", "finding_strong_funnel",
        "recommend_engagement", "recommend_fix_funnel", "recommend_reduce_bounce",
    ]


def test_report_goes_on_after_an_error(spark, tables, tmp_path):
    built = report.build_report(report.Tables(adapter.events(spark, tables)), ["totals", "cart_value", "nonsense"])
    assert set(built.frames) == {"totals"} and set(built.errors) == {"cart_value", "nonsense"}
    failed = built.write(str(tmp_path))
    assert set(failed) == {"cart_value", "nonsense"}
    assert spark.read.json(f"{tmp_path}/totals").count() == 1
    assert spark.read.json(f"{tmp_path}/summary").count() == 3


def test_registering_an_analysis(spark, make_events):
    @report.register("test_only")
    def count(tables):
        return tables.events.groupBy("page").count()

    try:
        assert report.build_report(report.Tables(make_events([{}])), ["test_only"]).frames["test_only"].count() == 1
    finally:
        report.ANALYSES.pop("test_only")


def test_stored_tables_are_prepared_once(spark, tables):
    """The analyses of a long report read written tables, not the plan that prepares them."""
    given = report.Tables(adapter.events(spark, tables), products=adapter.products(spark, tables))
    kept = given.stored()
    assert kept.users is None and kept.events.columns == given.events.columns
    assert all("/events-" in f for f in kept.events.inputFiles()) and kept.events.count() == given.events.count()
    assert all("/products-" in f for f in kept.products.inputFiles())
