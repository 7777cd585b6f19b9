"""R, T and P rows: retention, traffic, recommendations without a model."""

from datetime import datetime

from pyspark.sql import functions as F

from clickloom.operators import baskets, recommend, retention, traffic
from clickloom.sources import adapter
from contract.common import (
    END, ORDER_EVENTS_SQL, ORDERS_START, PRODUCTS_SQL, START, USERS_SQL, add, big, over_events, ts_text,
)

SPANS = """, sp AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS active_days,
  date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS kept FROM ev GROUP BY 1)"""

add(
    "r1_signup_cohorts",
    lambda s, d: retention.signup_cohorts(adapter.events(s, d), adapter.users(s, d)),
    over_events(
        """SELECT strftime(created_day, '%Y-%m-%d') AS cohort_date, count(*) AS cohort_size,
        round(avg(active_days), 2) AS avg_active_days, round(avg(kept), 2) AS avg_days_retained,
        count(*) FILTER (WHERE kept >= 7) AS retained_7d, count(*) FILTER (WHERE kept >= 30) AS retained_30d,
        round(count(*) FILTER (WHERE kept >= 7) * 100.0::DOUBLE / count(*), 2) AS retention_7d_rate,
        round(count(*) FILTER (WHERE kept >= 30) * 100.0::DOUBLE / count(*), 2) AS retention_30d_rate
        FROM sp JOIN usr USING (user_id) WHERE created_day IS NOT NULL GROUP BY created_day ORDER BY created_day DESC LIMIT 10""",
        USERS_SQL + SPANS,
    ),
)
OVERALL = """SELECT count(*) AS total_users, count(*) FILTER (WHERE kept >= 7) AS retained_7d,
  count(*) FILTER (WHERE kept >= 30) AS retained_30d,
  round(count(*) FILTER (WHERE kept >= 7) * 100.0::DOUBLE / count(*), 2) AS retention_7d_rate,
  round(count(*) FILTER (WHERE kept >= 30) * 100.0::DOUBLE / count(*), 2) AS retention_30d_rate FROM sp"""
add("r2_overall_retention", lambda s, d: retention.overall_retention(adapter.events(s, d)), over_events(OVERALL, SPANS))
add(
    "r2_overall_retention_orders",
    lambda s, d: retention.overall_retention(adapter.order_events(s, d)),
    ORDER_EVENTS_SQL + SPANS + OVERALL,
)
PERIODS = """, fd AS (SELECT user_id, min(CAST(ts AS DATE)) AS f FROM ev GROUP BY 1),
  pe AS (SELECT user_id, date_trunc('week', f) AS cohort, date_diff('day', f, CAST(ts AS DATE)) // 7 AS period,
         date_diff('day', f, CAST(ts AS DATE)) AS elapsed FROM ev JOIN fd USING (user_id))"""
WEEKLY = """SELECT strftime(cohort, '%Y-%m-%d') AS cohort, CAST(period AS BIGINT) AS period, count(DISTINCT user_id) AS users FROM pe GROUP BY 1, 2"""
add("r3_weekly_cohorts", lambda s, d: retention.weekly_cohorts(adapter.events(s, d)), over_events(WEEKLY, PERIODS))
add(
    "r3_weekly_cohorts_orders",
    lambda s, d: retention.weekly_cohorts(adapter.order_events(s, d)),
    ORDER_EVENTS_SQL + PERIODS + WEEKLY,
)
def _order_matrix(spark, sf_dir):
    """Half-year periods over all years of orders; the cells of a row as one text."""
    matrix = retention.weekly_cohort_matrix(adapter.order_events(spark, sf_dir), 182)
    return matrix.select("cohort", F.concat_ws(",", *[c for c in matrix.columns if c != "cohort"]).alias("counts"))


add(
    "r3_cohort_matrix_orders",
    _order_matrix,
    ORDER_EVENTS_SQL + """, dy AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM ev),
      f AS (SELECT user_id, d, min(d) OVER (PARTITION BY user_id) AS f FROM dy),
      c AS (SELECT CAST(date_trunc('week', f) AS DATE) AS cohort, (d - f) // 182 AS p, count(DISTINCT user_id) AS n FROM f GROUP BY 1, 2)
    SELECT strftime(k.cohort, '%Y-%m-%d') AS cohort, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY i) AS counts
    FROM (SELECT DISTINCT cohort FROM c) k CROSS JOIN (SELECT unnest(range(max(p) + 1)) AS i FROM c) r LEFT JOIN c ON c.cohort = k.cohort AND c.p = i GROUP BY k.cohort""",
)
add(
    "r3_cohort_matrix",
    lambda s, d: retention.weekly_cohort_matrix(adapter.events(s, d)),
    over_events(
        "SELECT strftime(cohort, '%Y-%m-%d') AS cohort, "
        + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE period = {i}) AS p{i}" for i in range(5))
        + " FROM pe GROUP BY 1",
        PERIODS,
    ),
)
add(
    "r3_retention_totals",
    lambda s, d: retention.weekly_retention_totals(adapter.events(s, d)),
    over_events(
        """SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT user_id) FILTER (WHERE elapsed >= 7) AS retained_users,
        round(count(DISTINCT user_id) FILTER (WHERE elapsed >= 7)::DOUBLE / count(DISTINCT user_id), 4) AS retention_rate,
        round(avg(period), 4) AS avg_periods FROM pe""",
        PERIODS,
    ),
)
MONTHLY = """, um AS (SELECT DISTINCT user_id, date_trunc('month', ts) AS m FROM ev),
  cal AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS TIMESTAMP) AS m FROM um)
  SELECT strftime(c.m, '%Y-%m') AS month, (SELECT count(*) FROM um WHERE um.m = c.m) AS active_users,
    coalesce(r.ret, 0) AS retention,
    CASE WHEN c.m = (SELECT min(m) FROM um) THEN 0.0::DOUBLE ELSE round(1 - coalesce(r.ret, 0), 4) END AS churn
  FROM cal c LEFT JOIN (
    SELECT p.m + INTERVAL 1 MONTH AS m, round(count(n.user_id)::DOUBLE / count(*), 4) AS ret
    FROM um p LEFT JOIN um n ON n.user_id = p.user_id AND n.m = p.m + INTERVAL 1 MONTH GROUP BY 1) r ON r.m = c.m"""
add(
    "r4_monthly_retention",
    lambda s, d: retention.monthly_retention(adapter.events(s, d), START),
    over_events("", MONTHLY),
)
add(
    "r4_monthly_retention_orders",
    lambda s, d: retention.monthly_retention(adapter.order_events(s, d), ORDERS_START),
    ORDER_EVENTS_SQL + MONTHLY,
)
COHORTS = """, um AS (SELECT DISTINCT user_id, date_trunc('month', ts) AS m FROM ev),
  co AS (SELECT user_id, min(m) AS c FROM um GROUP BY 1),
  sz AS (SELECT c, count(*) AS size FROM co GROUP BY 1)
  SELECT strftime(c, '%Y-%m') AS cohort, size, CAST(i AS BIGINT) AS month_no,
    round((SELECT count(*) FROM um JOIN co USING (user_id) WHERE co.c = sz.c AND um.m = sz.c + to_months(CAST(i AS INTEGER)))::DOUBLE / size, 4) AS share
  FROM sz, range(6) r(i)"""
add(
    "r5_monthly_cohorts",
    lambda s, d: retention.monthly_cohorts(adapter.events(s, d), START),
    over_events("", COHORTS),
)
add(
    "r5_monthly_cohorts_orders",
    lambda s, d: retention.monthly_cohorts(adapter.order_events(s, d), ORDERS_START),
    ORDER_EVENTS_SQL + COHORTS,
)
TABLE = """, fm AS (SELECT user_id, min(date_trunc('month', ts)) AS c FROM ev GROUP BY 1),
  ag AS (SELECT c, date_diff('month', c, date_trunc('month', ts)) AS age, count(DISTINCT user_id) AS active
         FROM ev JOIN fm USING (user_id) GROUP BY 1, 2)
  SELECT strftime(c, '%Y-%m-%d') AS cohort_month, age AS month_number, active AS active_users,
    first_value(active) OVER w AS cohort_size, round(active * 100.0::DOUBLE / first_value(active) OVER w, 2) AS retention_rate
  FROM ag WINDOW w AS (PARTITION BY c ORDER BY age)"""
add(
    "r6_monthly_cohort_table",
    lambda s, d: retention.monthly_cohort_table(adapter.events(s, d)),
    over_events("", TABLE),
)
add(
    "r6_monthly_cohort_table_orders",
    lambda s, d: retention.monthly_cohort_table(adapter.order_events(s, d)),
    ORDER_EVENTS_SQL + TABLE,
)
add(
    "r7_daily_engagement",
    lambda s, d: retention.daily_engagement(adapter.events(s, d)),
    over_events(
        f""", u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS a,
            count(*) FILTER (WHERE event_type = 'purchase') AS p FROM ev GROUP BY 1, 2)
        SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS active_users, round(avg(n), 4) AS avg_events_per_user,
        round(avg(a), 4) AS avg_unique_actions, {big('sum(p)')} AS total_purchases FROM u GROUP BY u.day"""
    ),
)
STAGES = """, u AS (SELECT user_id, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS life,
    count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM ev GROUP BY 1)
  SELECT CASE WHEN life < 30 THEN 'New' WHEN life < 90 THEN 'Growing' ELSE 'Established' END AS customer_stage, count(*) AS users,
  round(avg(life), 4) AS avg_lifetime_days, round(avg(days), 4) AS avg_active_days, round(avg(n), 4) AS avg_total_events,
  round(avg(p), 4) AS avg_purchases FROM u GROUP BY 1"""
add("r8_customer_stages", lambda s, d: retention.customer_stages(adapter.events(s, d)), over_events("", STAGES))
add(
    "r8_customer_stages_orders",
    lambda s, d: retention.customer_stages(adapter.order_events(s, d)),
    ORDER_EVENTS_SQL + STAGES,
)
add(
    "r9_user_patterns",
    lambda s, d: retention.user_patterns(adapter.events(s, d)),
    over_events(
        f"""SELECT user_id, count(*) AS total_events, count(DISTINCT CAST(ts AS DATE)) AS active_days,
        count(DISTINCT event_type) AS action_types, {ts_text('min(ts)')} AS first_seen, {ts_text('max(ts)')} AS last_seen,
        count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
        round(sum(CASE WHEN event_type = 'purchase' THEN CAST(price AS DECIMAL(10, 2)) END)::DOUBLE
          / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 9) AS avg_purchase_value
        FROM ev GROUP BY 1 ORDER BY total_events DESC, user_id LIMIT 1000"""
    ),
)

RULE_A = """CASE WHEN referrer = '' THEN 'direct' WHEN referrer IN ('google', 'bing') THEN 'organic'
  WHEN referrer IN ('facebook', 'twitter') THEN 'social' WHEN referrer = 'ads' THEN 'paid' ELSE 'referral' END"""
RULE_B = """CASE WHEN referrer IN ('google', 'bing') THEN 'organic_search' WHEN referrer IN ('facebook', 'twitter') THEN 'social'
  WHEN referrer = 'ads' THEN 'paid' WHEN referrer IN ('', 'direct') THEN 'direct' ELSE 'referral' END"""
RULE_C = """CASE WHEN referrer IN ('', 'direct') THEN 'direct' WHEN referrer IN ('google', 'bing') THEN 'seo'
  WHEN referrer IN ('facebook', 'twitter') THEN 'social' WHEN referrer = 'ads' THEN 'paid' ELSE 'referral' END"""
CH = f", ch AS (SELECT *, {RULE_A} AS channel FROM ev)"


def _channels(s, d):
    return traffic.with_channel(adapter.events(s, d))


for name, rule, sql in (
    ("t1_marketing_channels", "marketing", RULE_A),
    ("t2_traffic_sources", "source", RULE_B),
    ("t3_referral_channels", "referral", RULE_C),
):
    add(
        name,
        lambda s, d, rule=rule: traffic.with_channel(adapter.events(s, d), rule)
        .groupBy("referrer", "channel").agg(F.count("*").alias("events")),
        over_events(f"SELECT referrer, {sql} AS channel, count(*) AS events FROM ev GROUP BY 1, 2"),
    )
add(
    "t4_traffic_by_channel",
    lambda s, d: traffic.traffic_by(_channels(s, d)),
    over_events(
        """SELECT channel, count(*) AS visits, count(DISTINCT user_id) AS unique_users,
        count(DISTINCT session_id) AS sessions FROM ch GROUP BY 1""",
        CH,
    ),
)
add(
    "t4_traffic_by_source",
    lambda s, d: traffic.traffic_by(adapter.events(s, d).where(F.col("event_type") == "pageview"), "source"),
    over_events(
        """SELECT source, count(*) AS visits, count(DISTINCT user_id) AS unique_users,
        count(DISTINCT session_id) AS sessions FROM ev WHERE event_type = 'pageview' GROUP BY 1"""
    ),
)
add(
    "t5_landing_pages",
    lambda s, d: traffic.landing_pages(_channels(s, d)),
    over_events(
        """, f AS (SELECT * FROM ch WHERE event_type = 'pageview' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1)
        SELECT page AS landing_page, channel, count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS unique_users
        FROM f GROUP BY 1, 2 ORDER BY sessions DESC, landing_page, channel LIMIT 20""",
        CH,
    ),
)
add(
    "t5_landing_conversion",
    lambda s, d: traffic.landing_conversion(adapter.events(s, d)),
    over_events(
        """, f AS (SELECT session_id, user_id, path FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1),
        b AS (SELECT session_id, max((event_type = 'purchase')::INT) AS c FROM ev GROUP BY 1)
        SELECT path AS landing_page, count(*) AS sessions, count(DISTINCT user_id) AS unique_visitors, round(avg(c), 4) AS conversion_rate
        FROM f JOIN b USING (session_id) GROUP BY 1"""
    ),
)
add(
    "t6_channel_distribution",
    lambda s, d: traffic.channel_distribution(adapter.events(s, d)),
    over_events(
        f""", c AS (SELECT {RULE_C} AS channel, count(*) AS n FROM ev WHERE event_type IN ('pageview', 'search') GROUP BY 1)
        SELECT l.channel, coalesce(n, 0) AS events FROM (VALUES ('seo'), ('direct'), ('social'), ('referral'), ('paid')) l(channel) LEFT JOIN c USING (channel)"""
    ),
)
add(
    "t7_bounce_by_channel",
    lambda s, d: traffic.bounce_by(_channels(s, d)),
    over_events(
        """, x AS (SELECT session_id, channel, count(DISTINCT page) AS p FROM ch WHERE event_type = 'pageview' GROUP BY 1, 2)
        SELECT channel, count(*) AS total_sessions, count(*) FILTER (WHERE p = 1) AS bounced_sessions,
        round(count(*) FILTER (WHERE p = 1) * 100.0::DOUBLE / count(*), 2) AS bounce_rate FROM x GROUP BY 1""",
        CH,
    ),
)
CONVERSION = """SELECT {key}, count(DISTINCT session_id) AS total_sessions,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN session_id END) AS converted_sessions,
  round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN session_id END) * 100.0::DOUBLE / count(DISTINCT session_id), 2) AS conversion_rate
  FROM ch GROUP BY 1"""
add(
    "t8_conversion_by_channel",
    lambda s, d: traffic.conversion_by(_channels(s, d)),
    over_events(CONVERSION.format(key="channel"), CH),
)
add(
    "t8_conversion_by_source",
    lambda s, d: traffic.conversion_by(adapter.events(s, d), "source"),
    over_events(CONVERSION.format(key="source"), CH),
)
add(
    "t9_hourly_traffic",
    lambda s, d: traffic.hourly_traffic(adapter.events(s, d)),
    over_events(
        "SELECT hour(ts) AS hour, count(*) AS visits, count(DISTINCT user_id) AS unique_visitors FROM ev WHERE event_type = 'pageview' GROUP BY 1"
    ),
)
add(
    "t10_channel_daily",
    lambda s, d: traffic.channel_daily(adapter.events(s, d)),
    over_events(
        f""", c AS (SELECT ts, {RULE_C} AS channel FROM ev WHERE event_type IN ('pageview', 'search'))
        SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) FILTER (WHERE channel = 'seo') AS seo,
        count(*) FILTER (WHERE channel = 'direct') AS direct, count(*) FILTER (WHERE channel = 'social') AS social FROM c GROUP BY 1"""
    ),
)
add(
    "t10_site_totals",
    lambda s, d: traffic.site_totals(adapter.events(s, d)),
    over_events(
        f""", c AS (SELECT *, {RULE_C} AS channel FROM ev),
        x AS (SELECT count(*) FILTER (WHERE event_type IN ('pageview', 'search') AND channel IN ('seo', 'direct', 'social')) AS v,
              count(DISTINCT user_id) AS u FROM c)
        SELECT v AS total_views, u AS unique_visitors, round(v::DOUBLE / u, 4) AS views_per_visitor FROM x"""
    ),
)

SOLD = """SELECT product_id, product_name, category, count(*) AS purchases FROM ev
  WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL {days} DAY AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3"""
add(
    "p1_trending_month",
    lambda s, d: recommend.trending(adapter.events(s, d), END, "month"),
    over_events(f"SELECT * FROM ({SOLD.format(days=30)}) ORDER BY purchases DESC, product_id, category LIMIT 10"),
)
add(
    "p1_trending_in_category",
    lambda s, d: recommend.trending(adapter.events(s, d), END, "week", category="cat3"),
    over_events(
        f"SELECT * FROM ({SOLD.format(days=7)}) WHERE category = 'cat3' ORDER BY purchases DESC, product_id LIMIT 10"
    ),
)
BY_CATEGORY = f""", sold AS ({SOLD.format(days=7)}),
  tc AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY purchases DESC, product_id) AS r FROM sold)"""
add(
    "p2_category_leaders",
    lambda s, d: recommend.trending_by_category(adapter.events(s, d), END),
    over_events("SELECT product_id, product_name, category, purchases, r AS rank FROM tc WHERE r <= 10", BY_CATEGORY),
)
add(
    "p2_category_affinity",
    lambda s, d: recommend.category_affinity(adapter.events(s, d)),
    over_events(
        """SELECT user_id, category, count(*) AS events,
        round(count(*)::DOUBLE / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT), 6) AS affinity FROM ev GROUP BY 1, 2"""
    ),
)
add(
    "p3_similar_products",
    lambda s, d: recommend.similar_products(adapter.events(s, d), END),
    over_events(
        """, own AS (SELECT product_id, arg_max(category, (ts, event_id)) AS category FROM ev WHERE event_type = 'purchase' GROUP BY 1),
        x AS (SELECT o.product_id, o.category, s.product_id AS similar_id, s.purchases,
              row_number() OVER (PARTITION BY o.product_id ORDER BY s.purchases DESC, s.product_id) AS rank
              FROM own o JOIN sold s ON s.category = o.category AND s.product_id <> o.product_id)
        SELECT category, product_id, similar_id, purchases, rank FROM x WHERE rank <= 10""",
        BY_CATEGORY,
    ),
)
CROSS = """, pu AS (SELECT session_id, product_id, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
  cr AS (SELECT a.product_id, b.product_id AS partner_id, CAST(sum(b.n) AS BIGINT) AS purchases
         FROM pu a JOIN pu b ON a.session_id = b.session_id AND a.product_id <> b.product_id GROUP BY 1, 2),
  xs AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY purchases DESC, partner_id) AS rank FROM cr)"""
add(
    "p4_cross_sell",
    lambda s, d: recommend.cross_sell(adapter.events(s, d)),
    over_events("SELECT * FROM xs WHERE rank <= 5", CROSS),
)
add(
    "p4_cross_sell_one_product",
    lambda s, d: recommend.cross_sell_for(adapter.events(s, d), "10"),
    over_events(
        """SELECT partner_id AS product_id, purchases FROM cr WHERE product_id = '10'
        ORDER BY purchases DESC, partner_id LIMIT 5""",
        CROSS,
    ),
)


def _priority_items(spark, sf_dir):
    """Baskets of thousands of products: everything ordered at one priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("basket_id"), F.col("o_orderkey").alias("k"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").cast("string").alias("product_id"))
    return lines.join(orders, "k").select("basket_id", "product_id")


add(
    "p4_wide_partners",
    lambda s, d: baskets.top_partners(_priority_items(s, d)),
    """WITH it AS (SELECT DISTINCT o_orderpriority AS b, CAST(l_partkey AS VARCHAR) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    pr AS (SELECT x.p AS product_id, y.p AS partner_id, count(*) AS together FROM it x JOIN it y ON x.b = y.b AND x.p <> y.p GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY together DESC, partner_id) AS rank FROM pr QUALIFY rank <= 5""",
)
PERSONAL = """, lk AS (SELECT user_id, category, count(*) AS n FROM ev WHERE event_type IN ('add_to_cart', 'checkout', 'purchase') GROUP BY 1, 2),
  l5 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS cr FROM lk QUALIFY cr <= 5),
  la AS (SELECT *, n::DOUBLE / CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS aff FROM l5),
  own AS (SELECT user_id, product_id, purchases, round(greatest(0.5, aff), 6) AS confidence,
          row_number() OVER (PARTITION BY user_id ORDER BY cr, r) AS rank
          FROM la JOIN (SELECT * FROM tc WHERE r <= 10) t USING (category) QUALIFY rank <= 10),
  everybody AS (SELECT product_id, purchases, row_number() OVER (ORDER BY purchases DESC, product_id, category) AS rank FROM sold QUALIFY rank <= 10),
  per AS (SELECT * FROM own UNION ALL
    SELECT u.user_id, g.product_id, g.purchases, 0.5, g.rank FROM (SELECT DISTINCT user_id FROM ev) u, everybody g
    WHERE u.user_id NOT IN (SELECT user_id FROM own))"""
add(
    "p5_personalized",
    lambda s, d: recommend.personalized(adapter.events(s, d), END),
    over_events("SELECT * FROM per", BY_CATEGORY + PERSONAL),
)
add(
    "p6_popular_products",
    lambda s, d: recommend.popular_products(adapter.events(s, d), adapter.products(s, d)),
    over_events(
        """SELECT product_id, count(*) AS view_count, count(DISTINCT user_id) AS unique_viewers, p.name, p.category, p.price
        FROM ev JOIN prod p USING (product_id) GROUP BY ALL ORDER BY unique_viewers DESC, view_count DESC, product_id LIMIT 10""",
        PRODUCTS_SQL,
    ),
)
add(
    "p7_session_candidates",
    lambda s, d: recommend.session_candidates(adapter.events(s, d), adapter.products(s, d)),
    over_events(
        """, tch AS (SELECT session_id, product_id, max(event_type IN ('add_to_cart', 'checkout')) AS c,
             max(event_type = 'pageview') AS v FROM ev GROUP BY 1, 2),
        kn AS (SELECT session_id, category, tags FROM tch JOIN prod USING (product_id)),
        sc AS (SELECT session_id, category, count(*) AS n FROM kn GROUP BY 1, 2),
        sg AS (SELECT DISTINCT session_id, unnest(tags) AS tag FROM kn),
        pt AS (SELECT product_id, unnest(tags) AS tag FROM prod),
        pts AS (SELECT session_id, product_id, 5.0::DOUBLE * n AS s FROM sc JOIN prod USING (category)
                UNION ALL SELECT session_id, product_id, 2.0 FROM sg JOIN pt USING (tag)),
        agg AS (SELECT session_id, product_id, sum(s) AS s FROM pts GROUP BY 1, 2),
        fin AS (SELECT a.session_id, a.product_id, a.s - CASE WHEN t.v THEN 2 ELSE 0 END AS score
                FROM agg a LEFT JOIN tch t USING (session_id, product_id) WHERE NOT coalesce(t.c, FALSE))
        SELECT session_id, product_id, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, product_id) AS rank
        FROM fin QUALIFY rank <= 12""",
        PRODUCTS_SQL,
    ),
)


def _histories(spark, sf_dir):
    """Each user's purchases as recommendation lists of the past, and of the last day."""
    lists = adapter.events(spark, sf_dir).where(F.col("event_type") == "purchase").groupBy(
        "user_id", F.col("ts").alias("created_at")
    ).agg(F.count("*").alias("items"))
    cut = F.lit(datetime(2024, 1, 30))
    return lists.where(F.col("created_at") < cut), lists.where(F.col("created_at") >= cut)


add(
    "p8_recommendation_history",
    lambda s, d: recommend.keep_history(*_histories(s, d), 5),
    over_events(
        f"""SELECT user_id, {ts_text('ts')} AS created_at, n AS items FROM
        (SELECT user_id, ts, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2) h
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h.ts DESC) <= 5"""
    ),
)
add(
    "p9_combined",
    lambda s, d: recommend.combined(adapter.events(s, d), END, 5),
    over_events(
        f""", p5 AS (SELECT * FROM per), lists AS (
          SELECT 'category' AS kind, category AS key, product_id, purchases, r AS rank FROM tc WHERE r <= 5
          UNION ALL SELECT 'trending', 'all', product_id, purchases, row_number() OVER (ORDER BY purchases DESC, product_id, category) FROM ({SOLD.format(days=1)}) QUALIFY row_number() OVER (ORDER BY purchases DESC, product_id, category) <= 5
          UNION ALL SELECT 'seasonal', 'all', product_id, purchases, row_number() OVER (ORDER BY purchases DESC, product_id, category) FROM ({SOLD.format(days=30)}) QUALIFY row_number() OVER (ORDER BY purchases DESC, product_id, category) <= 5
          UNION ALL SELECT 'cross_sell', product_id, partner_id, purchases, rank FROM xs WHERE rank <= 5
          UNION ALL SELECT 'similar', product_id, sid, purchases, rank FROM (
            SELECT o.product_id, s.product_id AS sid, s.purchases, row_number() OVER (PARTITION BY o.product_id ORDER BY s.purchases DESC, s.product_id) AS rank
            FROM (SELECT product_id, arg_max(category, (ts, event_id)) AS category FROM ev WHERE event_type = 'purchase' GROUP BY 1) o
            JOIN sold s ON s.category = o.category AND s.product_id <> o.product_id) WHERE rank <= 5
          UNION ALL SELECT 'personalized', user_id, product_id, purchases, rank FROM per WHERE rank <= 5)
        SELECT kind, key, product_id, purchases::DOUBLE AS score, CAST(rank AS BIGINT) AS rank FROM lists""",
        BY_CATEGORY + PERSONAL.replace("r <= 10", "r <= 5").replace("rank <= 10", "rank <= 5") + CROSS,
    ),
)
add(
    "p2_one_affinity",
    lambda s, d: recommend.interactions_in_category(adapter.events(s, d), "7", "cat3"),
    over_events("SELECT round(avg((category = 'cat3')::INT), 6) AS affinity FROM ev WHERE user_id = '7'"),
)
