"""J and C rows: funnels, paths, carts."""

from pyspark.sql import functions as F

from clickloom.operators import baskets, cart, journey
from clickloom.sources import adapter
from contract.common import CARTS_SQL, PRODUCTS_SQL, add, big, over_events, ts_text

STEPS = (
    ("home_visit", "page = '/home'"),
    ("category_view", "(page LIKE '/category%' OR page = '/search')"),
    ("product_view", "page LIKE '/p/%'"),
    ("add_to_cart", "(event_type = 'add_to_cart' OR page = '/cart')"),
    ("checkout_start", "(page = '/checkout' OR event_type = 'checkout')"),
    ("purchase", "event_type = 'purchase'"),
)


def funnel_sql(source: str) -> str:
    """The funnel as correlated EXISTS tests, one per earlier step."""
    counts = []
    for i, (name, condition) in enumerate(STEPS):
        earlier = " ".join(
            f"AND EXISTS (SELECT 1 FROM {source} p{j} WHERE p{j}.session_id = e.session_id AND p{j}.ts < e.ts AND {_on(STEPS[j][1], f'p{j}')})"
            for j in range(i)
        )
        counts.append(
            f"SELECT {i + 1} AS step_no, '{name}' AS step, count(DISTINCT e.session_id) AS sessions FROM {source} e WHERE {_on(condition, 'e')} {earlier}"
        )
    return f"""SELECT CAST(step_no AS BIGINT) AS step_no, step, sessions,
      CASE WHEN step_no = 1 THEN 100.0 ELSE coalesce(round(sessions * 100.0::DOUBLE / nullif(lag(sessions) OVER (ORDER BY step_no), 0), 1), 0) END AS rate_pct
      FROM ({' UNION ALL '.join(counts)})"""


def _on(condition: str, alias: str) -> str:
    return condition.replace("page", f"{alias}.page").replace("event_type", f"{alias}.event_type")


add("j1_ordered_funnel", lambda s, d: journey.ordered_funnel(adapter.events(s, d)), over_events(funnel_sql("ev")))
add(
    "j1_ordered_funnel_all_traffic",
    lambda s, d: journey.ordered_funnel(adapter.all_events(s, d)),
    over_events(funnel_sql("alle")),
)
add(
    "j2_step_rates",
    lambda s, d: journey.ordered_funnel(adapter.events(s, d)).select("step", "rate_pct"),
    over_events(f", fn AS ({funnel_sql('ev')}) SELECT step, rate_pct FROM fn"),
)
add(
    "j3_event_funnel",
    lambda s, d: journey.event_funnel(adapter.events(s, d)),
    over_events(
        """, c AS (SELECT 1 AS i, 'Views' AS step, count(*) FILTER (WHERE event_type IN ('pageview', 'search')) AS n FROM ev
          UNION ALL SELECT 2, 'Add to Cart', count(*) FILTER (WHERE event_type = 'add_to_cart') FROM ev
          UNION ALL SELECT 3, 'Checkout', count(*) FILTER (WHERE event_type = 'checkout') FROM ev
          UNION ALL SELECT 4, 'Purchase', count(*) FILTER (WHERE event_type = 'purchase') FROM ev)
        SELECT CAST(i AS BIGINT) AS step_no, step, n AS events,
        CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE round(n::DOUBLE / lag(n) OVER (ORDER BY i), 4) END AS rate FROM c"""
    ),
)
add(
    "j4_session_funnel",
    lambda s, d: journey.session_funnel(adapter.events(s, d)),
    over_events(
        """, f AS (SELECT count(DISTINCT session_id) AS t,
          count(DISTINCT CASE WHEN event_type = 'pageview' THEN session_id END) AS v,
          count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN session_id END) AS a,
          count(DISTINCT CASE WHEN event_type = 'purchase' THEN session_id END) AS p
          FROM ev WHERE event_type IN ('pageview', 'add_to_cart', 'purchase'))
        SELECT t AS total_sessions, v AS viewed, a AS added_to_cart, p AS purchased,
        round(a * 100.0::DOUBLE / v, 2) AS view_to_cart_rate, round(p * 100.0::DOUBLE / a, 2) AS cart_to_purchase_rate FROM f"""
    ),
)
add(
    "j6_common_paths",
    lambda s, d: journey.common_paths(adapter.events(s, d)),
    over_events(
        """, v AS (SELECT session_id, page, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM ev WHERE event_type = 'pageview'),
        p AS (SELECT session_id, string_agg(page, ' -> ' ORDER BY r) AS path FROM v WHERE r <= 5 GROUP BY 1),
        b AS (SELECT session_id, max(event_type = 'purchase') AS bought FROM ev GROUP BY 1)
        SELECT path, count(*) AS frequency, count(*) FILTER (WHERE bought) AS conversions,
        round(count(*) FILTER (WHERE bought) * 100.0::DOUBLE / count(*), 2) AS conversion_rate
        FROM p JOIN b USING (session_id) GROUP BY 1 ORDER BY frequency DESC, path LIMIT 20"""
    ),
)
add(
    "j7_event_paths",
    lambda s, d: journey.event_paths(adapter.events(s, d), min_freq=3),
    over_events(
        """SELECT path, count(*) AS frequency FROM
        (SELECT string_agg(event_type, '->' ORDER BY ts, event_id) AS path FROM ev GROUP BY session_id)
        GROUP BY 1 HAVING count(*) >= 3"""
    ),
)
add(
    "j7_path_length_stats",
    lambda s, d: journey.path_length_stats(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT count(*) AS n, max((event_type = 'checkout')::INT) AS c FROM ev GROUP BY session_id)
        SELECT count(*) AS sessions, round(avg(n), 4) AS average_length, quantile_disc(n, 0.5) AS median_length,
        max(n) AS max_length, round(avg(c), 4) AS conversion_rate FROM x"""
    ),
)
add(
    "j8_conversion_paths",
    lambda s, d: journey.conversion_paths(adapter.events(s, d), min_freq=2),
    over_events(
        """, x AS (SELECT string_agg(event_type || coalesce(':' || path, ''), ' > ' ORDER BY ts, event_id) AS path,
          max((event_type = 'purchase')::INT) AS b FROM ev GROUP BY session_id)
        SELECT path, count(*) AS frequency, CAST(sum(b) AS BIGINT) AS conversions, round(avg(b), 4) AS conversion_rate FROM x
        GROUP BY 1 HAVING count(*) >= 2"""
    ),
)
add(
    "j9_drop_off",
    lambda s, d: journey.drop_off(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT event_type, path, lead(event_type) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS nxt FROM ev)
        SELECT event_type, path, count(*) AS occurrences, count(*) FILTER (WHERE nxt IS NULL) AS dropoffs,
        round(count(*) FILTER (WHERE nxt IS NULL) * 100.0::DOUBLE / count(*), 2) AS dropoff_rate
        FROM x GROUP BY 1, 2 HAVING count(*) FILTER (WHERE nxt IS NULL) > 0"""
    ),
)
add(
    "j10_length_impact",
    lambda s, d: journey.length_impact(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT count(*) AS n, count(DISTINCT event_type) AS u, max((event_type = 'purchase')::INT) AS c FROM ev GROUP BY session_id)
        SELECT CASE WHEN n < 5 THEN 'Very Short (1-4)' WHEN n < 10 THEN 'Short (5-9)' WHEN n < 20 THEN 'Medium (10-19)'
          ELSE 'Long (20+)' END AS journey_length, count(*) AS sessions, round(avg(n), 4) AS avg_steps,
        round(avg(u), 4) AS avg_unique_steps, round(avg(c), 4) AS conversion_rate FROM x GROUP BY 1"""
    ),
)
add(
    "j11_entry_channels",
    lambda s, d: journey.entry_channels(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT DISTINCT session_id, first_value(source) OVER w AS entry_channel,
            count(*) OVER (PARTITION BY session_id) AS n,
            max((event_type = 'purchase')::INT) OVER (PARTITION BY session_id) AS c FROM ev
            WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
        SELECT entry_channel, count(*) AS sessions, round(avg(n), 4) AS avg_journey_length,
        CAST(sum(c) AS BIGINT) AS conversions, round(avg(c), 4) AS conversion_rate FROM x GROUP BY 1"""
    ),
)
LINKS = """, lab AS (SELECT session_id, ts, event_id,
    CASE WHEN event_type IN ('pageview', 'search') THEN coalesce(path, 'Page') WHEN event_type = 'add_to_cart' THEN 'Add to Cart'
         WHEN event_type = 'checkout' THEN 'Checkout' WHEN event_type = 'purchase' THEN 'Purchase' ELSE 'Remove_From_Cart' END AS label FROM ev),
  mv AS (SELECT session_id, lag(label) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS source, label AS target FROM lab),
  st AS (SELECT DISTINCT session_id, source, target,
    CASE source WHEN 'Add to Cart' THEN 1 WHEN 'Checkout' THEN 2 WHEN 'Purchase' THEN 3 ELSE 0 END AS a,
    CASE target WHEN 'Add to Cart' THEN 1 WHEN 'Checkout' THEN 2 WHEN 'Purchase' THEN 3 ELSE 0 END AS b
    FROM mv WHERE source IS NOT NULL)"""
add(
    "j12_transition_links",
    lambda s, d: journey.transition_links(adapter.events(s, d)),
    over_events(
        "SELECT source, target, count(*) AS value FROM st WHERE a < b GROUP BY 1, 2 ORDER BY value DESC, source, target LIMIT 40",
        LINKS,
    ),
)
add(
    "j12_transition_nodes",
    lambda s, d: journey.transition_nodes(adapter.events(s, d)),
    over_events("SELECT source AS node FROM st WHERE a < b UNION SELECT target FROM st WHERE a < b", LINKS),
)

add(
    "c1_abandonment",
    lambda s, d: cart.abandonment(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT count(*) FILTER (WHERE event_type = 'add_to_cart') AS a,
          count(*) FILTER (WHERE event_type = 'purchase') AS p FROM ev GROUP BY session_id, user_id)
        SELECT count(*) AS total_sessions, count(*) FILTER (WHERE p = 0) AS abandoned_sessions,
        round(count(*) FILTER (WHERE p = 0) * 100.0::DOUBLE / count(*), 2) AS abandonment_rate FROM x WHERE a > 0"""
    ),
)
add(
    "c1_abandonment_flags",
    lambda s, d: cart.abandonment_flags(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT max((event_type = 'add_to_cart')::INT) AS a, max((event_type = 'purchase')::INT) AS p FROM ev GROUP BY session_id)
        SELECT count(*) AS total_sessions, CAST(sum(a) AS BIGINT) AS cart_sessions, CAST(sum(p) AS BIGINT) AS purchase_sessions,
        round(avg(CASE WHEN a = 1 THEN p END), 4) AS conversion_rate, round(1 - avg(CASE WHEN a = 1 THEN p END), 4) AS abandonment_rate FROM x"""
    ),
)
CART_SESSIONS = """, act AS (SELECT session_id, ts, event_id, event_type, product_id,
    sum(CASE event_type WHEN 'add_to_cart' THEN 1 WHEN 'remove_from_cart' THEN -1 ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS items
    FROM ev WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'checkout', 'purchase')),
  cs AS (SELECT session_id, CAST(max(items) AS BIGINT) AS max_items, arg_max(event_type, (ts, event_id)) AS last_event,
    array_to_string(list_sort(list(DISTINCT product_id)), ',') AS products FROM act GROUP BY 1)"""
add(
    "c2_cart_sessions",
    lambda s, d: cart.cart_sessions(adapter.events(s, d)),
    over_events("SELECT session_id, max_items, last_event, products FROM cs", CART_SESSIONS),
)
add(
    "c2_cart_metrics",
    lambda s, d: cart.cart_metrics(cart.cart_sessions(adapter.events(s, d))),
    over_events(
        """SELECT count(*) AS total_carts, count(*) FILTER (WHERE last_event = 'purchase') AS completed_carts,
        round(1 - count(*) FILTER (WHERE last_event = 'purchase')::DOUBLE / count(*), 4) AS abandonment_rate,
        round(avg(max_items), 4) AS avg_items FROM cs""",
        CART_SESSIONS,
    ),
)


def _cart_items(spark, sf_dir):
    kinds = ("add_to_cart", "remove_from_cart", "checkout", "purchase")
    return adapter.events(spark, sf_dir).where(F.col("event_type").isin(*kinds)).select(
        F.col("session_id").alias("basket_id"), "product_id"
    )


PAIRS = """SELECT a.product_id AS product_a, b.product_id AS product_b, count(*) AS together
  FROM it a JOIN it b ON a.basket_id = b.basket_id AND a.product_id < b.product_id
  GROUP BY 1, 2 ORDER BY together DESC, product_a, product_b LIMIT 10"""
add(
    "c3_cart_pairs",
    lambda s, d: baskets.top_pairs(_cart_items(s, d)),
    over_events(
        PAIRS,
        """, it AS (SELECT DISTINCT session_id AS basket_id, product_id FROM ev
        WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'checkout', 'purchase'))""",
    ),
)
add(
    "c3_order_pairs",
    lambda s, d: baskets.top_pairs(adapter.basket_items(s, d)),
    f"""WITH it AS (SELECT DISTINCT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem) {PAIRS}""",
)


def _monthly_items(spark, sf_dir):
    """Wide baskets: everything shipped in a month."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("basket_id"), F.col("l_partkey").cast("string").alias("product_id")
    )


add(
    "c3_wide_pairs",
    lambda s, d: baskets.top_pairs(_monthly_items(s, d)),
    f"""WITH it AS (SELECT DISTINCT strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS basket_id, CAST(l_partkey AS VARCHAR) AS product_id
    FROM lineitem) {PAIRS}""",
)
add(
    "c4_abandoned_carts",
    lambda s, d: cart.abandoned_carts(cart.cart_sessions(adapter.events(s, d))),
    over_events(
        "SELECT session_id, products FROM cs WHERE last_event <> 'purchase' AND max_items > 0", CART_SESSIONS
    ),
)
add(
    "c4_never_purchased",
    lambda s, d: cart.never_purchased(adapter.events(s, d)),
    over_events(
        """SELECT DISTINCT session_id FROM ev WHERE event_type = 'add_to_cart'
        AND session_id NOT IN (SELECT session_id FROM ev WHERE event_type = 'purchase')"""
    ),
)
add(
    "c5_most_abandoned",
    lambda s, d: cart.most_abandoned(
        adapter.carts(s, d), adapter.products(s, d).select("product_id", F.col("name").alias("product_name"))
    ),
    over_events(
        """SELECT c.product_id, max(p.name) AS product_name, count(DISTINCT cart_id) AS times_abandoned,
        CAST(sum(quantity) AS BIGINT) AS total_quantity, round(avg(c.price), 2) AS avg_price
        FROM crt c LEFT JOIN prod p USING (product_id) WHERE status IN ('abandoned', 'active')
        GROUP BY 1 ORDER BY times_abandoned DESC, total_quantity DESC, c.product_id LIMIT 20""",
        PRODUCTS_SQL + CARTS_SQL,
    ),
)
add(
    "c6_time_to_abandon",
    lambda s, d: cart.time_to_abandon(adapter.carts(s, d)),
    over_events(
        """SELECT round(avg(m), 2) AS avg_minutes_to_abandon, round(min(m), 2) AS min_minutes, round(max(m), 2) AS max_minutes
        FROM (SELECT (epoch(updated_at) - epoch(created_at)) / 60.0::DOUBLE AS m FROM crt
              WHERE status IN ('abandoned', 'active') AND updated_at > created_at)""",
        CARTS_SQL,
    ),
)
add(
    "c7_abandoned_value",
    lambda s, d: cart.abandoned_value(adapter.carts(s, d)),
    over_events(
        """SELECT round(sum(quantity * price), 2) AS total_abandoned_value, round(avg(quantity * price), 2) AS avg_item_value,
        count(DISTINCT cart_id) AS abandoned_carts FROM crt WHERE status IN ('abandoned', 'active')""",
        CARTS_SQL,
    ),
)
add(
    "c8_value_buckets",
    lambda s, d: cart.value_buckets(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT max((event_type = 'purchase')::INT) AS p,
          sum(CASE WHEN event_type = 'add_to_cart' THEN CAST(price AS DECIMAL(10, 2)) ELSE 0 END) AS v FROM ev GROUP BY session_id)
        SELECT CASE WHEN v < 50 THEN 'Under $50' WHEN v < 100 THEN '$50-$100' WHEN v < 200 THEN '$100-$200' ELSE 'Over $200' END AS value_range,
        count(*) AS sessions, round(avg(p), 4) AS conversion_rate, round(avg(v::DOUBLE), 2) AS avg_value FROM x WHERE v > 0 GROUP BY 1"""
    ),
)
add(
    "c9_recovery_opportunities",
    lambda s, d: cart.recovery_opportunities(adapter.events(s, d)),
    over_events(
        f""", x AS (SELECT user_id, session_id, max(price) AS v, max(ts) AS t FROM ev WHERE event_type = 'add_to_cart'
          AND session_id NOT IN (SELECT session_id FROM ev WHERE event_type = 'purchase') GROUP BY 1, 2)
        SELECT user_id, count(*) AS abandoned_carts, round(avg(v), 4) AS avg_cart_value, {ts_text('max(t)')} AS latest_abandonment
        FROM x GROUP BY 1 HAVING count(*) > 1 ORDER BY avg_cart_value DESC, user_id LIMIT 100"""
    ),
)
add(
    "c10_cart_timing",
    lambda s, d: cart.cart_timing(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT min(ts) FILTER (WHERE event_type = 'add_to_cart') AS f, max(ts) FILTER (WHERE event_type = 'purchase') AS p, max(ts) AS l
          FROM ev GROUP BY session_id)
        SELECT CASE WHEN p IS NOT NULL THEN 'Purchased' ELSE 'Abandoned' END AS outcome, count(*) AS sessions,
        round(avg(epoch_us(coalesce(p, l)) // 1000000 - epoch_us(f) // 1000000), 2) AS avg_time_seconds FROM x WHERE f IS NOT NULL GROUP BY 1"""
    ),
)
CHANNEL = """CASE WHEN referrer IN ('', 'direct') THEN 'direct' WHEN referrer IN ('google', 'bing') THEN 'seo'
  WHEN referrer IN ('facebook', 'twitter') THEN 'social' WHEN referrer = 'ads' THEN 'paid' ELSE 'referral' END"""


def _gappy(spark, sf_dir):
    """Events whose referrer is only known at odd products, so the session decides the rest."""
    known = F.col("product_id").cast("int") % 2 == 1
    return adapter.events(spark, sf_dir).withColumn("referrer", F.when(known, F.col("referrer")))


BY_CHANNEL = f""", g AS (SELECT session_id, ts, event_id, event_type, CASE WHEN k % 2 = 1 THEN referrer END AS referrer FROM ev),
  g2 AS (SELECT session_id, event_type, nullif(referrer, '') AS ref,
     first_value(coalesce(referrer, '')) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS fr FROM g),
  g3 AS (SELECT event_type, coalesce(ref, fr) AS referrer FROM g2 WHERE event_type IN ('checkout', 'purchase')),
  bc AS (SELECT {CHANNEL} AS channel, count(*) FILTER (WHERE event_type = 'checkout') AS checkouts,
     count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM g3 GROUP BY 1),
  br AS (SELECT *, CASE WHEN checkouts > 0 THEN round(1 - purchases::DOUBLE / checkouts, 4) END AS abandonment_rate FROM bc)"""
add(
    "c11_abandonment_by_channel",
    lambda s, d: cart.abandonment_by_channel(_gappy(s, d)),
    over_events("SELECT * FROM br", BY_CHANNEL),
)
add(
    "c11_worst_channels",
    lambda s, d: cart.worst_channels(cart.abandonment_by_channel(_gappy(s, d))),
    over_events(
        "SELECT * FROM br WHERE abandonment_rate > 0 ORDER BY abandonment_rate DESC, channel LIMIT 3", BY_CHANNEL
    ),
)
SIZES = ", z AS (SELECT session_id, sum(quantity) AS q FROM ev WHERE event_type = 'add_to_cart' GROUP BY 1)"
add(
    "c12_cart_sizes",
    lambda s, d: cart.cart_size_distribution(adapter.events(s, d)),
    over_events(
        """SELECT l.size, count(z.session_id) AS carts FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4', 4, 4), ('5+', 5, 1000000000)) l(size, lo, hi)
        LEFT JOIN z ON z.q BETWEEN lo AND hi GROUP BY 1""",
        SIZES,
    ),
)
add(
    "c12_cart_size_totals",
    lambda s, d: cart.cart_size_totals(adapter.events(s, d)),
    over_events(
        f"SELECT count(*) AS total_carts, {big('sum(q)')} AS items, round(avg(q), 4) AS avg_items_per_cart FROM z", SIZES
    ),
)
add(
    "c13_latest_adds",
    lambda s, d: cart.latest_adds(adapter.events(s, d), 20, 10),
    over_events(
        f"""SELECT event_id, {ts_text('ts')} AS ts, user_id, session_id, product_id, price, quantity FROM ev
        WHERE event_type = 'add_to_cart' ORDER BY ev.ts DESC, event_id LIMIT 20 OFFSET 10"""
    ),
)
add(
    "c14_cart_totals",
    lambda s, d: cart.cart_totals(adapter.carts(s, d)),
    over_events(
        f"""SELECT cart_id, {big('sum(greatest(1, quantity))')} AS items, round(sum(price * greatest(1, quantity)), 2) AS total
        FROM crt GROUP BY 1""",
        CARTS_SQL,
    ),
)
add(
    "c14_enriched_items",
    lambda s, d: cart.enriched_items(adapter.carts(s, d), adapter.products(s, d), adapter.cart_rows(s, d)).select(
        "cart_id", "product_id", "name", "category", "quantity", "line_value"
    ),
    over_events(
        """SELECT cart_id, product_id, name, category, CAST(quantity AS BIGINT) AS quantity,
        round(crt.price * quantity, 2) AS line_value FROM crt LEFT JOIN prod USING (product_id)""",
        PRODUCTS_SQL + CARTS_SQL,
    ),
)
