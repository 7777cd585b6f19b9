"""F and E rows: cleaning, enrichment, catalogue, sessions."""

from pyspark.sql import functions as F

from clickloom.functions import pages, values
from clickloom.operators import cleaning, session_tables, sessions
from clickloom.sources import adapter
from clickloom.sources import events as source
from contract.common import END, MIDDLE, PRODUCTS_SQL, SQL, START, USERS_SQL, add, over_events, ts_text

SESSION_SQL = """, ses AS (
  SELECT session_id, arg_max(user_id, (ts, event_id)) AS user_id, min(ts) AS first_event_at, max(ts) AS last_event_at,
         count(*) AS event_count, list_sort(list(DISTINCT page)) AS pages
  FROM {source} GROUP BY session_id
)"""

add(
    "s1_prepared_events",
    lambda s, d: source.prepare(adapter.raw_events(s, d)).select(
        "event_id", "user_id", "session_id", "ts", "page", "event_type", "product_id", "category",
        F.round("price", 4).alias("price"), "quantity", F.round("amount", 4).alias("amount"), "referrer",
        "product_name", "product_ids", "utm_source", "source", "search_term", "path", "label", "noisy",
    ),
    """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, 's' || user_id AS session_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN event_type = 'view' AND k % 5 = 0 THEN '/home'
            WHEN event_type = 'view' AND k % 5 = 1 THEN '/category?category=cat' || (k % 8)
            WHEN event_type = 'view' THEN '/p/item-' || k || '?id=' || k
            WHEN event_type = 'click' THEN '/cart' WHEN event_type = 'error' THEN '/search' ELSE '/checkout' END AS page,
       event_type, CAST(k AS VARCHAR) AS product_id, 'cat' || (k % 8) AS category, round(value, 4) AS price,
       CAST(k % 3 + 1 AS BIGINT) AS quantity, round(value, 4) AS amount,
       ['google', 'bing', 'facebook', 'twitter', 'ads', 'direct', 'blog.partner.com', ''][user_id % 8 + 1] AS referrer,
       CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS product_ids, CAST(NULL AS VARCHAR) AS utm_source,
       CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS search_term, CAST(NULL AS VARCHAR) AS path,
       CAST(NULL AS VARCHAR) AS label, CASE WHEN k = 98 THEN TRUE WHEN k % 2 = 0 THEN FALSE END AS noisy
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)

add(
    "s2_filtered_events",
    lambda s, d: source.load_events(
        adapter.all_events(s, d), START, MIDDLE, ["pageview", "purchase"], columns=["event_id", "user_id", "event_type"]
    ),
    over_events(
        """SELECT event_id, user_id, event_type FROM ev
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-16' AND event_type IN ('pageview', 'purchase')"""
    ),
)

add(
    "f1_noise_filter",
    lambda s, d: source.drop_noise(adapter.unsessioned(s, d)).groupBy("source").agg(F.count("*").alias("events")),
    over_events("SELECT source, count(*) AS events FROM ev GROUP BY source"),
)


def _segments(spark, sf_dir):
    """Customers' market segment as the user segment table."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )


add(
    "f2_common_filters",
    lambda s, d: source.filter_events(
        adapter.events(s, d), date_from=START, date_to=MIDDLE, event_types=["search", "checkout"],
        channel="GOOGLE|partner", segment="BUILDING", user_segments=_segments(s, d),
    ).groupBy("user_id", "event_type").agg(F.count("*").alias("events")),
    over_events(
        """SELECT user_id, event_type, count(*) AS events FROM ev
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-16' AND event_type IN ('search', 'checkout')
          AND (referrer = 'google' OR referrer = 'blog.partner.com')
          AND uid IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        GROUP BY 1, 2"""
    ),
)

add(
    "f2_named_user",
    lambda s, d: source.filter_events(
        adapter.unsessioned(s, d), user="Customer#000000007",
        users=adapter.users(s, d).withColumn("role", F.lit("user")),
    ).groupBy("user_id").agg(F.count("*").alias("events")),
    over_events("SELECT user_id, count(*) AS events FROM alle WHERE uid = 7 GROUP BY 1"),
)

add(
    "f3_validation",
    lambda s, d: cleaning.validate(adapter.raw_events(s, d))
    .groupBy("reject_reason", "event_type").agg(F.count("*").alias("events")),
    """SELECT CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'signup' THEN NULL
             ELSE 'bad event_type' END AS reject_reason, event_type, count(*) AS events FROM events GROUP BY 1, 2""",
)

add(
    "f4_page_families",
    lambda s, d: cleaning.normalize_pages(adapter.unsessioned(s, d))
    .groupBy("page_base").agg(F.count("*").alias("events"), F.countDistinct("page").alias("pages")),
    over_events(
        """SELECT CASE WHEN page LIKE '/p/%' THEN '/product' ELSE split_part(page, '?', 1) END AS page_base,
        count(*) AS events, count(DISTINCT page) AS pages FROM alle GROUP BY 1"""
    ),
)

add(
    "f5_canonical_pages",
    lambda s, d: cleaning.canonical_pages(
        adapter.unsessioned(s, d).withColumn("page", F.regexp_replace("page", r"\?id=\d+$", "?ref=x&id=0")),
    ).groupBy("page").agg(F.count("*").alias("events")),
    over_events(
        """SELECT CASE WHEN page LIKE '/p/%' THEN split_part(page, '?', 1) || '?ref=x&id=' || product_id
                       WHEN page LIKE '/category%' THEN '/category?category=' || category ELSE page END AS page,
        count(*) AS events FROM alle GROUP BY 1"""
    ),
)

add(
    "f6_event_times",
    lambda s, d: adapter.unsessioned(s, d).select(
        "event_id",
        values.first_time(
            F.when(F.col("event_id") % 4 == 0, F.lit("not a time")),
            F.when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            F.when(F.col("event_id") % 4 == 2, F.unix_millis("ts").cast("string")),
            F.unix_seconds("ts").cast("string"),
        ).alias("event_time"),
    ),
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM events",
)


def _faulty_times(s, d):
    """Raw events of which some have no time, one beyond the calendar, or text that is none."""
    kind = F.col("event_id") % 7
    broken = F.when(kind == 3, F.lit("1e17")).when(kind == 4, F.lit("soon")).when(kind != 5, F.col("timestamp"))
    return source.time_faults(adapter.raw_events(s, d).withColumn("timestamp", broken))


add(
    "f6_time_faults",
    _faulty_times,
    """SELECT CASE event_id % 7 WHEN 3 THEN 'out of range' WHEN 4 THEN 'unreadable' WHEN 5 THEN 'no time' ELSE 'placed' END AS reason,
    count(*) AS events FROM events GROUP BY 1""",
)

add(
    "f7_enrichment",
    lambda s, d: cleaning.enrich(adapter.unsessioned(s, d), adapter.products(s, d), adapter.users(s, d)).select(
        "event_id", "product_details.name", "product_details.price", "user_details.username"
    ),
    over_events(
        """SELECT event_id, p.name, p.price, u.username FROM alle
        LEFT JOIN prod p USING (product_id) LEFT JOIN usr u USING (user_id)""",
        PRODUCTS_SQL + USERS_SQL,
    ),
)

add(
    "f8_purchase_amounts",
    lambda s, d: adapter.raw_events(s, d).where(F.col("event_type") == "purchase").select(
        "event_id", F.round(values.purchase_amount(F.col("properties")), 4).alias("amount")
    ),
    "SELECT event_id, round(value, 4) AS amount FROM events WHERE event_type = 'purchase'",
)

add(
    "f9_object_ids",
    lambda s, d: cleaning.canonical_ids(
        adapter.unsessioned(s, d).select(
            "event_id",
            F.when(F.col("event_id") % 3 == 0, F.col("user_id"))
            .otherwise(F.upper(F.lpad(F.hex("event_id"), 24, "A"))).alias("ref"),
        ),
        "ref",
    ),
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL
    ELSE lower(lpad(upper(printf('%x', event_id)), 24, 'A')) END AS ref FROM events""",
)

add(
    "f10_catalogue",
    lambda s, d: cleaning.browse(
        adapter.products(s, d), category="ECONOMY", min_price=901.0, max_price=2000.0, tags=["small", "Brand#3"],
        search="RING|gear", sort="price", descending=True, offset=5, n=20,
    ).select("product_id", "name", "price", "total"),
    """WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_retailprice AS price FROM part
      WHERE p_type = 'ECONOMY' AND p_retailprice BETWEEN 901 AND 2000 AND (p_size <= 15 OR p_brand = 'Brand#3')
        AND (regexp_matches(p_name, '(?i)ring|gear')))
    SELECT product_id, name, price, (SELECT count(*) FROM f) AS total FROM f
    ORDER BY price DESC, product_id LIMIT 20 OFFSET 5""",
)

add(
    "f11_categories",
    lambda s, d: cleaning.categories(adapter.products(s, d)),
    "SELECT DISTINCT p_type AS category FROM part",
)

add(
    "f12_latest_events",
    lambda s, d: source.latest_events(adapter.events(s, d), user="7", n=50).select("event_id", "ts", "event_type"),
    over_events(
        f"""SELECT event_id, {ts_text('ts')} AS ts, event_type FROM ev WHERE user_id = '7'
        ORDER BY ev.ts DESC, event_id LIMIT 50"""
    ),
)

add(
    "e1_session_rollup",
    lambda s, d: sessions.rollup(adapter.events(s, d)),
    over_events(
        f"""SELECT session_id, user_id, {ts_text('first_event_at')} AS first_event_at,
        {ts_text('last_event_at')} AS last_event_at, event_count, array_to_string(pages, ',') AS pages FROM ses""",
        SESSION_SQL.format(source="ev"),
    ),
)

add(
    "e2_backfill",
    lambda s, d: sessions.backfill(adapter.events(s, d), END, 10).select("session_id", "event_count"),
    over_events(
        """SELECT session_id, count(*) AS event_count FROM ev
        WHERE ts >= TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1"""
    ),
)


def _daily_pieces(spark, sf_dir):
    """Session rows as a tracker that splits them at midnight would store them."""
    pieces = adapter.events(spark, sf_dir).withColumn(
        "session_id", F.concat_ws("|", "session_id", F.date_format("ts", "yyyyMMdd"))
    )
    return sessions.rollup(pieces).withColumn("session_id", F.split_part("session_id", F.lit("|"), F.lit(1)))


add(
    "e3_merged_sessions",
    lambda s, d: sessions.merge_duplicates(_daily_pieces(s, d)),
    over_events(
        f"""SELECT session_id, user_id, {ts_text('first_event_at')} AS first_event_at,
        {ts_text('last_event_at')} AS last_event_at, event_count, array_to_string(pages, ',') AS pages, merged_rows
        FROM ses JOIN (SELECT session_id, count(DISTINCT CAST(ts AS DATE)) AS merged_rows FROM ev GROUP BY 1)
        USING (session_id)""",
        SESSION_SQL.format(source="ev"),
    ),
)


def _session_tables(s, d):
    """Sessions stored in daily pieces, merged: heads, exact page counts, first pages, and whether the sketch agrees."""
    pieces = adapter.events(s, d).withColumn("session_id", F.concat_ws("|", "session_id", F.date_format("ts", "yyyyMMdd")))
    whole = F.split_part("session_id", F.lit("|"), F.lit(1))
    merged = session_tables.merge_heads(session_tables.heads(pieces).withColumn("session_id", whole))
    rows = session_tables.merge_pages(session_tables.pages(pieces).withColumn("session_id", whole))
    near = F.abs(session_tables.estimate() - F.col("n_pages")) <= F.greatest(F.lit(1), F.col("n_pages") * 0.1)
    return merged.join(session_tables.named_pages(rows, 3), "session_id").select(
        "session_id", "user_id", "first_event_at", "last_event_at", "event_count", "merged_rows", "n_pages", "first_pages", near.alias("sketch_agrees")
    )


add(
    "e3_session_tables",
    _session_tables,
    over_events(
        f"""SELECT session_id, user_id, {ts_text('first_event_at')} AS first_event_at, {ts_text('last_event_at')} AS last_event_at,
        event_count, merged_rows, len(pages) AS n_pages, array_to_string(pages[1:3], ',') AS first_pages, TRUE AS sketch_agrees
        FROM ses JOIN (SELECT session_id, count(DISTINCT CAST(ts AS DATE)) AS merged_rows FROM ev GROUP BY 1) USING (session_id)""",
        SESSION_SQL.format(source="ev"),
    ),
)


def _repaired_tables(s, d):
    """Sessions of all traffic, those of one event stored empty, repaired from the clean events."""
    every, clean = adapter.all_events(s, d), adapter.events(s, d)
    heads = session_tables.heads(every)
    single = F.col("event_count") == 1
    stored = heads.withColumn("event_count", F.when(single, 0).otherwise(F.col("event_count")))
    rows = session_tables.pages(every).join(heads.where(~single).select("session_id"), "session_id")
    repaired, page_rows = session_tables.repair(stored, rows, clean)
    counts = session_tables.named_pages(page_rows).select("session_id", F.col("n_pages").alias("pages"))
    return repaired.join(counts, "session_id", "left").select(
        "session_id", "event_count", F.coalesce("pages", F.lit(0)).alias("pages"), "is_orphan"
    )


def _stored(spark, sf_dir):
    """Sessions over all traffic, with one-event sessions stored empty."""
    whole = sessions.rollup(adapter.all_events(spark, sf_dir))
    single = F.col("event_count") == 1
    return whole.withColumns(
        {
            "pages": F.when(single, F.array().cast("array<string>")).otherwise(F.col("pages")),
            "event_count": F.when(single, 0).otherwise(F.col("event_count")),
        }
    )


add(
    "e4_repaired_sessions",
    lambda s, d: sessions.repair_empty(_stored(s, d), adapter.events(s, d)).select(
        "session_id", "event_count", F.size("pages").alias("pages"), "is_orphan"
    ),
    over_events(
        """, whole AS (SELECT session_id, count(*) AS n, count(DISTINCT page) AS p FROM alle GROUP BY 1),
        clean AS (SELECT session_id, count(*) AS n, count(DISTINCT page) AS p FROM ev GROUP BY 1)
        SELECT session_id,
          CASE WHEN w.n = 1 AND c.n IS NOT NULL THEN c.n WHEN w.n = 1 THEN 0 ELSE w.n END AS event_count,
          CASE WHEN w.n = 1 AND c.n IS NOT NULL THEN c.p WHEN w.n = 1 THEN 0 ELSE w.p END AS pages,
          (w.n = 1 AND c.n IS NULL) AS is_orphan
        FROM whole w LEFT JOIN clean c USING (session_id)"""
    ),
)
add("e4_repaired_tables", _repaired_tables, SQL["e4_repaired_sessions"])

add(
    "e5_session_audit",
    lambda s, d: sessions.audit(_stored(s, d), adapter.events(s, d)),
    over_events(
        """, whole AS (SELECT session_id, CASE WHEN count(*) = 1 THEN 0 ELSE count(*) END AS stored FROM alle GROUP BY 1),
        clean AS (SELECT session_id, count(*) AS n FROM ev GROUP BY 1),
        j AS (SELECT w.*, c.n FROM whole w LEFT JOIN clean c USING (session_id))
        SELECT 'sessions' AS check_name, count(*) AS n FROM j
        UNION ALL SELECT 'empty_pages', count(*) FROM j WHERE stored = 0
        UNION ALL SELECT 'zero_events', count(*) FROM j WHERE stored = 0
        UNION ALL SELECT 'orphan_sessions', count(*) FROM j WHERE n IS NULL
        UNION ALL SELECT 'sessions_missing', 0
        UNION ALL SELECT 'orphan_events', 0
        UNION ALL SELECT 'count_mismatch', count(*) FROM j WHERE n IS NOT NULL AND n <> stored
        UNION ALL SELECT 'user_mismatch', 0"""
    ),
)

add(
    "e6_session_summary",
    lambda s, d: sessions.summary(adapter.events(s, d)),
    over_events(
        f"""SELECT session_id, event_count, {ts_text('first_event_at')} AS first_event_at,
        {ts_text('last_event_at')} AS last_event_at, array_to_string(pages[1:10], ',') AS sample_pages FROM ses""",
        SESSION_SQL.format(source="ev"),
    ),
)

add(
    "e7_recent_sessions",
    lambda s, d: sessions.recent(adapter.events(s, d), 20, "1"),
    over_events(
        f"""SELECT session_id, user_id, {ts_text('last_event_at')} AS last_event_at, event_count FROM ses
        WHERE user_id LIKE '%1%' ORDER BY ses.last_event_at DESC, session_id LIMIT 20""",
        SESSION_SQL.format(source="ev"),
    ),
)

add(
    "e8_user_sessions",
    lambda s, d: sessions.of_users(adapter.events(s, d)),
    over_events(
        f"""SELECT user_id, session_id, {ts_text('min(ts)')} AS first_event_at,
        arg_min(event_type, (ts, event_id)) AS first_event_type, count(*) AS event_count FROM ev GROUP BY 1, 2"""
    ),
)

add(
    "e9_sessionize",
    lambda s, d: adapter.all_events(s, d).select("event_id", "session_id"),
    over_events("SELECT event_id, session_id FROM alle"),
)

add(
    "x1_slugs",
    lambda s, d: adapter.products(s, d).select("product_id", pages.slug(F.col("name")).alias("slug")),
    "SELECT CAST(p_partkey AS VARCHAR) AS product_id, replace(p_name, ' ', '-') AS slug FROM part",
)


def _varied(spark, sf_dir):
    """Raw events whose time, id, flag and label stand in different fields from row to row."""
    raw = adapter.raw_events(spark, sf_dir)
    when = [F.col("event_id") % 4 == i for i in range(4)]
    seconds = F.col("timestamp").cast("long")
    return raw.select(
        F.when(~when[1], F.col("event_id").cast("string")).alias("event_id"),
        F.when(when[1], F.concat(F.lit("x"), "event_id")).alias("_id"),
        "user_id", "session_id",
        F.when(when[0], F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("occurred_at"),
        F.when(when[1], F.lit("no time")).alias("processed_at"),
        F.when(when[2], F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")).alias("occurred_at_iso"),
        F.when(when[1] | when[3], F.col("timestamp")).alias("timestamp"),
        "page", "event_type",
        F.map_concat("properties", F.create_map(
            F.lit("product_name"), F.concat(F.lit("item-"), F.col("properties")["product_id"]),
            F.lit("product_ids"), F.to_json(F.array(F.col("properties")["product_id"], F.lit("z"))),
            F.lit("utm_source"), F.col("event_type"), F.lit("source"), F.lit("shop"), F.lit("search_term"), F.lit("red shoe"),
            F.lit("path"), F.lit("/x"), F.lit("title"), F.concat(F.lit("T"), F.col("properties")["product_id"]), F.lit("name"), F.lit("N"),
        )).alias("properties"),
        F.struct(F.col("noisy")).alias("flag"),
    )


add(
    "s1_varied_fields",
    lambda s, d: source.prepare(_varied(s, d)).select(
        "event_id", "ts", "product_name", "product_ids", "utm_source", "source", "search_term", "path", "label", "noisy"
    ),
    """SELECT CASE WHEN event_id % 4 = 1 THEN 'x' ELSE '' END || event_id AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
       'item-' || k AS product_name, k || ',z' AS product_ids, event_type AS utm_source, 'shop' AS source, 'red shoe' AS search_term,
       '/x' AS path, 'T' || k AS label, CASE WHEN k = 98 THEN TRUE WHEN k % 2 = 0 THEN FALSE END AS noisy
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
add(
    "e9_unknown_users",
    lambda s, d: sessions.sessionize(
        adapter.unsessioned(s, d).withColumn("user_id", F.when(F.col("user_id").cast("long") % 3 != 0, F.col("user_id")))
    ).groupBy("session_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id")),
    """WITH b AS (SELECT event_id, ts, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS u FROM events),
    g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY u ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS brk FROM b),
    n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY u ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM g)
    SELECT u || '-' || n AS session_id, count(*) AS events, min(event_id) AS first_id FROM n GROUP BY 1""",
)
