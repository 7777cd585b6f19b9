"""A and D rows: KPIs, activity, insight rules."""

from datetime import datetime

from pyspark.sql import functions as F

from clickloom.operators import activity, journey, kpis, sessions
from clickloom.plans import report
from clickloom.sources import adapter
from contract.common import END, MIDDLE, START, add, big, over_events, ts_text

WINDOW = "ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'"
PAIRS = "SELECT session_id, user_id, count(*) AS n, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS secs FROM ev GROUP BY 1, 2"

add(
    "a1_event_totals",
    lambda s, d: kpis.event_totals(adapter.events(s, d)),
    over_events(
        """SELECT count(*) AS total_events, count(DISTINCT session_id) AS sessions,
        count(DISTINCT user_id) AS users FROM ev"""
    ),
)
add(
    "a2_top_pages",
    lambda s, d: kpis.top_pages(adapter.events(s, d)),
    over_events("SELECT page, count(*) AS views FROM ev GROUP BY 1 ORDER BY views DESC, page LIMIT 10"),
)
add(
    "a3_event_type_shares",
    lambda s, d: kpis.event_type_shares(adapter.events(s, d)),
    over_events(
        """SELECT event_type, count(*) AS events, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev), 2) AS share_pct
        FROM ev GROUP BY 1"""
    ),
)
add(
    "a4_session_stats",
    lambda s, d: kpis.session_stats(adapter.events(s, d)),
    over_events(
        f"""SELECT {big('sum(n)')} AS total_events, count(DISTINCT session_id) AS total_sessions,
        count(DISTINCT user_id) AS total_users, round(avg(n), 2) AS avg_events_per_session,
        max(n) AS max_events_per_session, quantile_cont(n::DOUBLE, 0.5) AS median_events_per_session,
        round(avg(secs), 2) AS avg_session_seconds, max(secs) AS max_session_seconds,
        quantile_cont(secs::DOUBLE, 0.5) AS median_session_seconds,
        round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(DISTINCT session_id), 4) AS bounce_rate FROM ({PAIRS})"""
    ),
)
add(
    "a5_session_table_stats",
    lambda s, d: kpis.session_table_stats(sessions.rollup(adapter.events(s, d))),
    over_events(
        """SELECT count(*) AS total_sessions, round(avg(n), 4) AS avg_events_per_session,
        round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*), 4) AS bounce_rate
        FROM (SELECT count(*) AS n FROM ev GROUP BY session_id)"""
    ),
)
DETAIL = """SELECT session_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 3) AS duration_seconds,
  count(*) AS page_count, count(DISTINCT page) AS unique_pages FROM ev GROUP BY 1 HAVING count(*) > 1"""
add("a6_session_detail", lambda s, d: kpis.session_detail(adapter.events(s, d)), over_events(DETAIL))
add(
    "a6_session_detail_means",
    lambda s, d: kpis.session_detail_means(adapter.events(s, d)),
    over_events(
        f"""SELECT round(avg(duration_seconds), 2) AS avg_session_duration,
        round(avg(page_count), 2) AS avg_pages_per_session, count(*) AS sessions FROM ({DETAIL})"""
    ),
)
add(
    "a7_user_detail",
    lambda s, d: kpis.user_detail(adapter.events(s, d)),
    over_events(
        """SELECT user_id, count(DISTINCT session_id) AS total_sessions, count(*) AS total_events,
        count(DISTINCT page) AS unique_pages,
        round(count(*)::DOUBLE / count(DISTINCT session_id), 4) AS avg_events_per_session FROM ev GROUP BY 1"""
    ),
)
add(
    "a7_user_means",
    lambda s, d: kpis.user_means(adapter.events(s, d)),
    over_events(
        """SELECT count(*) AS users, round(avg(s), 4) AS avg_sessions_per_user, round(avg(n), 4) AS avg_events_per_user
        FROM (SELECT count(DISTINCT session_id) AS s, count(*) AS n FROM ev GROUP BY user_id)"""
    ),
)
SPREAD = """SELECT 'hour' AS kind, strftime(ts, '%H') AS bucket, count(*) AS events FROM ev GROUP BY 1, 2
  UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM ev GROUP BY 1, 2"""
add("a8_time_distribution", lambda s, d: activity.time_distribution(adapter.events(s, d)), over_events(SPREAD))
add(
    "a8_peaks",
    lambda s, d: activity.peaks(adapter.events(s, d)),
    over_events(
        f"""SELECT kind, bucket, events FROM ({SPREAD})
        QUALIFY row_number() OVER (PARTITION BY kind ORDER BY events DESC, bucket) = 1"""
    ),
)
add(
    "a9_activity_histograms",
    lambda s, d: activity.activity_report(adapter.events(s, d), START, END, tz_offset_minutes=-420),
    over_events(
        f""", loc AS (SELECT ts + INTERVAL 420 MINUTE AS lt FROM ev WHERE {WINDOW}),
        tot AS (SELECT count(*) AS t FROM loc),
        hourly AS (SELECT lpad(CAST(h AS VARCHAR), 2, '0') AS bucket, count(lt) AS events
                   FROM range(24) r(h) LEFT JOIN loc ON hour(lt) = h GROUP BY 1),
        dow AS (SELECT CAST(w AS VARCHAR) AS bucket, count(lt) AS events FROM range(7) r(w) LEFT JOIN loc ON dayofweek(lt) = w GROUP BY 1),
        days AS (SELECT strftime(lt, '%Y-%m-%d') AS bucket, count(*) AS events FROM loc GROUP BY 1),
        peak AS (SELECT * FROM days ORDER BY events DESC, bucket LIMIT 1),
        peakhour AS (SELECT strftime(lt, '%H') || ':00' AS bucket, count(*) AS events FROM loc
                     WHERE strftime(lt, '%Y-%m-%d') = (SELECT bucket FROM peak) GROUP BY 1 ORDER BY events DESC, bucket LIMIT 1),
        alls AS (
          SELECT 'hourly' AS facet, * FROM hourly UNION ALL SELECT 'dow', * FROM dow UNION ALL SELECT 'by_date', * FROM days
          UNION ALL SELECT 'peak_day', * FROM peak UNION ALL SELECT 'peak_hour', * FROM peakhour
          UNION ALL SELECT 'top_hours', * FROM (SELECT * FROM hourly ORDER BY events DESC, bucket LIMIT 3)
          UNION ALL SELECT 'top_days', * FROM (SELECT * FROM days WHERE bucket <> (SELECT bucket FROM peak) ORDER BY events DESC, bucket LIMIT 3))
        SELECT facet, bucket, events, round(events * 100.0::DOUBLE / t, 4) AS pct FROM alls, tot"""
    ),
)
add(
    "a10_business_kpis",
    lambda s, d: kpis.business_kpis(adapter.events(s, d), adapter.orders(s, d), START, END),
    over_events(
        f""", o AS (SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS t FROM orders
               WHERE o_orderdate >= TIMESTAMP '2024-01-01' AND o_orderdate <= TIMESTAMP '2024-01-31'),
        e AS (SELECT count(*) AS n, count(DISTINCT session_id) AS s, count(DISTINCT user_id) AS u,
              count(*) FILTER (WHERE event_type = 'purchase') AS b,
              coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0) AS r, max(ts) AS m FROM ev WHERE {WINDOW}),
        x AS (SELECT CASE WHEN o.n > 0 THEN o.t ELSE e.r END AS revenue, CASE WHEN o.n > 0 THEN o.n ELSE e.b END AS orders, e.* FROM o, e)
        SELECT round(revenue, 2) AS revenue, orders, round(revenue / nullif(orders, 0), 2) AS average_order_value,
        round(b::DOUBLE / u, 4) AS conversion_rate, u AS total_users, s AS total_sessions, n AS total_events,
        {ts_text('m')} AS last_event_ts FROM x"""
    ),
)
add(
    "a11_purchase_revenue",
    lambda s, d: kpis.purchase_revenue(adapter.events(s, d), START, END),
    over_events(
        f"""SELECT round(sum(amount), 2) AS revenue, count(*) AS purchases FROM ev
        WHERE event_type = 'purchase' AND {WINDOW}"""
    ),
)
add(
    "a12_behavior_kpis",
    lambda s, d: kpis.behavior_kpis(adapter.events(s, d), START, END),
    over_events(
        f"""SELECT count(*) AS sessions, {big('sum(v)')} AS page_views,
        round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*), 4) AS bounce_rate
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'pageview') AS v FROM ev WHERE {WINDOW} GROUP BY session_id)"""
    ),
)


def _logs(spark, sf_dir):
    """The generated events as log lines: type error is an error, the rest is info."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info"))
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), level.alias("level"))


add(
    "a13_success_rate",
    lambda s, d: kpis.success_rate(_logs(s, d), START, END),
    """SELECT count(*) FILTER (WHERE event_type <> 'error') AS success_count,
    count(*) FILTER (WHERE event_type = 'error') AS error_count,
    round(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*), 4) AS success_rate FROM events
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'""",
)


def _trend_sql(metric: str, size: int, buckets: int, value: str, where: str = "TRUE") -> str:
    return over_events(
        f""", c AS (SELECT CAST(floor((epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000) / {size}) AS BIGINT) AS b,
                    {value} AS v FROM ev WHERE {WINDOW} AND {where} GROUP BY 1)
        SELECT '{metric}' AS metric, {ts_text(f"TIMESTAMP '2024-01-01' + to_seconds(i * {size})")} AS bucket_start,
        coalesce(v, 0) AS value FROM range({buckets}) r(i) LEFT JOIN c ON c.b = i"""
    )


add(
    "a14_trend_daily_views",
    lambda s, d: activity.trend(adapter.events(s, d), "page_views", "daily", START, END),
    _trend_sql("page_views", 86400, 31, "count(*)", "event_type = 'pageview'"),
)
add(
    "a14_trend_weekly_sessions",
    lambda s, d: activity.trend(adapter.events(s, d), "sessions", "weekly", START, END),
    _trend_sql("sessions", 604800, 5, "count(DISTINCT session_id)"),
)
add(
    "d1_trend_hourly_events",
    lambda s, d: activity.trend(adapter.events(s, d), "events", "hourly", START, END),
    _trend_sql("events", 3600, 721, "count(*)"),
)
AS_OF = datetime(2024, 1, 30, 12)
RECENT = "date_trunc('minute', ts) >= TIMESTAMP '2024-01-29 12:00:00' AND date_trunc('minute', ts) <= TIMESTAMP '2024-01-30 12:00:00'"
add(
    "a15_minute_totals",
    lambda s, d: activity.minute_totals(activity.minute_counts(adapter.events(s, d)), AS_OF, 1440),
    over_events(
        f""", r AS (SELECT * FROM ev WHERE {RECENT})
        SELECT 'minute' AS kind, strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) AS events FROM r GROUP BY 1, 2
        UNION ALL SELECT 'page', page, count(*) FROM r GROUP BY 1, 2
        UNION ALL SELECT 'event_type', event_type, count(*) FROM r GROUP BY 1, 2"""
    ),
)
add(
    "a16_page_rates",
    lambda s, d: kpis.page_rates(adapter.events(s, d)),
    over_events(
        """SELECT page, count(DISTINCT session_id) AS sessions,
        round(count(DISTINCT session_id)::DOUBLE / (SELECT count(DISTINCT session_id) FROM ev), 6) AS visit_rate FROM ev GROUP BY 1"""
    ),
)
add(
    "a16_revisit_rates",
    lambda s, d: kpis.revisit_rates(adapter.events(s, d)),
    over_events(
        """SELECT count(*) AS sessions, round(count(*) FILTER (WHERE p > 1)::DOUBLE / count(*), 6) AS multi_page_rate,
        round(count(*) FILTER (WHERE n > p)::DOUBLE / count(*), 6) AS revisit_rate
        FROM (SELECT count(*) AS n, count(DISTINCT page) AS p FROM ev GROUP BY session_id)"""
    ),
)
ACTIVE = """SELECT user_id, count(*) AS total_interactions, count(*) FILTER (WHERE event_type = 'pageview') AS pageviews,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(DISTINCT product_id) AS unique_products
  FROM ev GROUP BY 1 HAVING count(*) >= 5"""
add(
    "a17_active_users",
    lambda s, d: kpis.active_users(adapter.events(s, d)),
    over_events(f"SELECT * FROM ({ACTIVE}) ORDER BY total_interactions DESC, user_id LIMIT 20"),
)
add(
    "a17_activity_buckets",
    lambda s, d: kpis.activity_buckets(adapter.events(s, d)),
    over_events(
        f"""SELECT CASE WHEN total_interactions <= 10 THEN '5-10' WHEN total_interactions <= 50 THEN '11-50'
        WHEN total_interactions <= 100 THEN '51-100' WHEN total_interactions <= 500 THEN '101-500' ELSE '500+' END AS bucket,
        count(*) AS users FROM ({ACTIVE}) GROUP BY 1"""
    ),
)
add(
    "a17_user_interactions",
    lambda s, d: kpis.user_interactions(adapter.events(s, d), "7"),
    over_events(
        """SELECT event_type, count(*) AS interactions, count(DISTINCT product_id) AS products
        FROM ev WHERE user_id = '7' GROUP BY 1"""
    ),
)
add(
    "a18_product_view_share",
    lambda s, d: kpis.product_view_share(adapter.events(s, d)),
    over_events(
        """SELECT count(*) FILTER (WHERE page LIKE '/p/%') AS product_views, count(*) AS total_events,
        round(count(*) FILTER (WHERE page LIKE '/p/%') * 100.0::DOUBLE / count(*), 2) AS view_rate_pct FROM ev"""
    ),
)
add(
    "a18_top_viewed_products",
    lambda s, d: kpis.top_viewed_products(adapter.events(s, d)),
    over_events(
        """SELECT product_name, count(*) AS views, min(page) AS page FROM ev WHERE page LIKE '/p/%'
        GROUP BY 1 ORDER BY views DESC, product_name LIMIT 10"""
    ),
)
add(
    "a19_interaction_density",
    lambda s, d: kpis.interaction_density(adapter.events(s, d)),
    over_events(
        """SELECT count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products, count(*) AS interactions,
        count(DISTINCT (user_id, product_id)) AS cells,
        round(count(DISTINCT (user_id, product_id)) * 100.0::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT product_id)), 4)
          AS density_pct FROM ev"""
    ),
)


def _dirty(spark, sf_dir):
    """Minute-grained events with some users unknown, so that repeats and gaps occur."""
    return adapter.events(spark, sf_dir).withColumns(
        {
            "user_id": F.when(F.col("referrer") != "", F.col("user_id")),
            "ts": F.date_trunc("day", "ts"),
        }
    )


add(
    "a20_data_quality",
    lambda s, d: kpis.data_quality(_dirty(s, d)),
    over_events(
        f""", q AS (SELECT CASE WHEN referrer <> '' THEN user_id END AS u, session_id AS s, date_trunc('day', ts) AS t, event_type AS e, page AS p FROM ev)
        SELECT count(*) AS total_events, count(DISTINCT s) AS total_sessions, {ts_text('max(t)')} AS last_event_ts,
        round(count(*) FILTER (WHERE u IS NULL) * 100.0::DOUBLE / (5 * count(*)), 4) AS missing_values_pct,
        round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT u, s, t, e, p FROM q))) * 100.0::DOUBLE / count(*), 4)
          AS duplicate_events_pct FROM q"""
    ),
)
FUNNELS = """fl AS (SELECT max(page = '/home') AS h, max(page LIKE '/product%' OR page LIKE '/p/%') AS p,
    max(page = '/checkout') AS c, max(page = '/search') AS s FROM ev GROUP BY session_id),
  fun AS (
    SELECT 'home_to_product' AS funnel, count(*) FILTER (WHERE h) AS entered, count(*) FILTER (WHERE h AND p) AS converted FROM fl
    UNION ALL SELECT 'product_to_checkout', count(*) FILTER (WHERE p), count(*) FILTER (WHERE p AND c) FROM fl
    UNION ALL SELECT 'home_to_checkout', count(*) FILTER (WHERE h), count(*) FILTER (WHERE h AND c) FROM fl
    UNION ALL SELECT 'search_to_product', count(*) FILTER (WHERE s), count(*) FILTER (WHERE s AND p) FROM fl)"""
add(
    "j5_page_funnels",
    lambda s, d: journey.page_funnels(adapter.events(s, d)),
    over_events(
        f""", {FUNNELS} SELECT funnel, entered, converted, round(converted::DOUBLE / nullif(entered, 0), 4) AS conversion FROM fun"""
    ),
)
add(
    "a21_insight_rules",
    lambda s, d: report.insight_rules(
        kpis.session_stats(adapter.events(s, d)), journey.page_funnels(adapter.events(s, d))
    ),
    over_events(
        f""", {FUNNELS},
        t AS (SELECT round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*), 4) AS b, round(avg(secs), 2) AS s FROM ({PAIRS})),
        f AS (SELECT funnel, entered, round(converted::DOUBLE / nullif(entered, 0), 4) AS c FROM fun)
        SELECT 'finding_high_bounce' AS kind, 'bounce_rate' AS metric, b AS value FROM t WHERE b > 0.7
        UNION ALL SELECT 'finding_low_bounce', 'bounce_rate', b FROM t WHERE b < 0.3
        UNION ALL SELECT 'finding_long_sessions', 'avg_session_seconds', s FROM t WHERE s > 300
        UNION ALL SELECT 'finding_short_sessions', 'avg_session_seconds', s FROM t WHERE s < 60
        UNION ALL SELECT 'recommend_reduce_bounce', 'bounce_rate', b FROM t WHERE b > 0.5
        UNION ALL SELECT 'recommend_engagement', 'avg_session_seconds', s FROM t WHERE s < 120
        UNION ALL SELECT 'finding_strong_funnel', funnel, c FROM f WHERE c > 0.3
        UNION ALL SELECT 'alert_weak_funnel', funnel, c FROM f WHERE c > 0 AND c < 0.1
        UNION ALL SELECT 'recommend_fix_funnel', funnel, c FROM f WHERE c < 0.1 AND entered > 10 AND funnel LIKE 'home%'"""
    ),
)
add(
    "a22_kpi_digest",
    lambda s, d: report.kpi_digest(adapter.events(s, d), START),
    over_events(
        """, f AS (SELECT count(*) FILTER (WHERE event_type IN ('pageview', 'search'))::DOUBLE AS v,
            count(*) FILTER (WHERE event_type = 'add_to_cart')::DOUBLE AS a, count(*) FILTER (WHERE event_type = 'checkout')::DOUBLE AS c,
            count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS p FROM ev),
        dr AS (SELECT 'Add to Cart' AS name, round((1 - round(a / v, 4)) * 100, 2) AS value FROM f
            UNION ALL SELECT 'Checkout', round((1 - round(c / a, 4)) * 100, 2) FROM f
            UNION ALL SELECT 'Purchase', round((1 - round(p / c, 4)) * 100, 2) FROM f),
        ch AS (SELECT CASE WHEN referrer IN ('', 'direct') THEN 'direct' WHEN referrer IN ('google', 'bing') THEN 'seo'
            WHEN referrer IN ('facebook', 'twitter') THEN 'social' WHEN referrer = 'ads' THEN 'paid' ELSE 'referral' END AS name
            FROM ev WHERE event_type IN ('pageview', 'search')),
        m AS (SELECT max(date_trunc('month', ts)) AS lastm, min(date_trunc('month', ts)) AS firstm FROM ev),
        pu AS (SELECT DISTINCT user_id FROM ev, m WHERE date_trunc('month', ts) = lastm - INTERVAL 1 MONTH),
        cu AS (SELECT DISTINCT user_id FROM ev, m WHERE date_trunc('month', ts) = lastm)
        (SELECT 'largest_drop' AS kind, name, value FROM dr ORDER BY value DESC, name LIMIT 1)
        UNION ALL (SELECT 'top_source', name, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ch), 2) FROM ch GROUP BY name)
        UNION ALL SELECT 'latest_retention', strftime(lastm, '%Y-%m'),
          CASE WHEN lastm = firstm THEN 0.0::DOUBLE ELSE coalesce(round(round((SELECT count(*) FROM cu SEMI JOIN pu USING (user_id))::DOUBLE
             / nullif((SELECT count(*) FROM pu), 0), 4) * 100, 2), 0) END FROM m"""
    ),
)
add(
    "a23_orders_from_purchases",
    lambda s, d: kpis.orders_from_purchases(adapter.events(s, d)).withColumn("total", F.round("total", 4)),
    over_events(
        f"""SELECT user_id, session_id, round(amount, 4) AS total, {ts_text('ts')} AS created_at, 'shop' AS source, event_id
        FROM ev WHERE event_type = 'purchase'"""
    ),
)
add(
    "a24_recent_counts",
    lambda s, d: kpis.recent_counts(adapter.events(s, d)),
    over_events(
        f""", m AS (SELECT max(ts) AS t FROM ev)
        SELECT count(*) FILTER (WHERE ts >= t - INTERVAL 60 MINUTE) AS last_60_minutes,
        count(*) FILTER (WHERE ts >= t - INTERVAL 5 MINUTE) AS last_5_minutes, {ts_text('max(ts)')} AS newest_ts FROM ev, m"""
    ),
)
add(
    "a25_reconciled_kpis",
    lambda s, d: kpis.reconcile(
        adapter.events(s, d), sessions.rollup(adapter.events(s, d)), adapter.orders(s, d), START, END
    ),
    over_events(
        f""", o AS (SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS t FROM orders
               WHERE o_orderdate >= TIMESTAMP '2024-01-01' AND o_orderdate <= TIMESTAMP '2024-01-31'),
        e AS (SELECT count(DISTINCT session_id) AS s, count(DISTINCT user_id) AS u,
              count(*) FILTER (WHERE event_type = 'purchase') AS b,
              sum(amount) FILTER (WHERE event_type = 'purchase') AS r FROM ev WHERE {WINDOW}),
        x AS (SELECT round(CASE WHEN o.n > 0 THEN o.t ELSE e.r END, 2) AS revenue, CASE WHEN o.n > 0 THEN o.n ELSE e.b END AS n, e.s, e.u, e.b FROM o, e)
        SELECT s AS total_sessions, u AS total_users, round(b::DOUBLE / u, 4) AS conversion_rate, revenue,
        greatest(n, b) AS orders, round(revenue / n, 2) AS average_order_value FROM x"""
    ),
)
add(
    "d2_compare_periods",
    lambda s, d: kpis.compare_periods(adapter.events(s, d), (MIDDLE, END), (START, MIDDLE)),
    over_events(
        """, p AS (SELECT ts >= TIMESTAMP '2024-01-16' AS cur, * FROM ev WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
        a AS (SELECT cur, count(*)::DOUBLE AS e, count(DISTINCT session_id)::DOUBLE AS s, count(DISTINCT user_id)::DOUBLE AS u,
              (count(*) FILTER (WHERE event_type = 'purchase'))::DOUBLE AS b,
              round(sum(amount) FILTER (WHERE event_type = 'purchase'), 2) AS r FROM p GROUP BY 1),
        l AS (SELECT cur, 'events' AS metric, e AS v FROM a UNION ALL SELECT cur, 'sessions', s FROM a UNION ALL SELECT cur, 'users', u FROM a
              UNION ALL SELECT cur, 'purchases', b FROM a UNION ALL SELECT cur, 'revenue', r FROM a),
        w AS (SELECT metric, max(v) FILTER (WHERE cur) AS current, max(v) FILTER (WHERE NOT cur) AS previous FROM l GROUP BY 1)
        SELECT metric, current, previous, round(current - previous, 2) AS delta,
        round((current - previous) * 100 / previous, 2) AS change_pct FROM w"""
    ),
)
add(
    "d3_realtime_window",
    lambda s, d: activity.minute_totals(activity.minute_counts(adapter.events(s, d)), AS_OF, 180),
    over_events(
        """, x AS (SELECT *, date_trunc('minute', ts) AS m FROM ev
          WHERE date_trunc('minute', ts) >= TIMESTAMP '2024-01-30 09:00:00' AND date_trunc('minute', ts) <= TIMESTAMP '2024-01-30 12:00:00')
        SELECT 'page' AS kind, page AS bucket, count(*) AS events FROM x GROUP BY 2
        UNION ALL SELECT 'event_type', event_type, count(*) FROM x GROUP BY 2
        UNION ALL SELECT 'minute', strftime(m, '%Y-%m-%d %H:%M'), count(*) FROM x GROUP BY 2"""
    ),
)
NEW_FROM = datetime(2024, 1, 3)
add(
    "d4_new_and_returning",
    lambda s, d: kpis.new_and_returning(adapter.events(s, d), NEW_FROM, END),
    over_events(
        """, u AS (SELECT user_id, min(ts) AS f, count(DISTINCT session_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-03') AS s
              FROM ev WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1)
        SELECT count(*) FILTER (WHERE f >= TIMESTAMP '2024-01-03') AS new_users,
        count(*) FILTER (WHERE f < TIMESTAMP '2024-01-03') AS returning_users, round(avg(s), 4) AS sessions_per_user FROM u WHERE s > 0"""
    ),
)
