"""S and W rows: lake, results, state, streaming jobs."""

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import activity
from clickloom.plans import report
from clickloom.session import shared_dir
from clickloom.sources import adapter, lake, watermarks
from clickloom.sources import events as source
from clickloom.streaming import events as stream
from clickloom.streaming import sessions as live
from clickloom.streaming import upserts
from contract.common import END, MIDDLE, PRODUCTS_SQL, SQL, USERS_SQL, add, over_events, ts_text

FROM, TO = datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18)
FLAT = ["event_id", "user_id", "ts", "page", "event_type", "product_id", "amount"]


def _lake(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "lake")
    daily = lake.with_partitions(adapter.unsessioned(spark, sf_dir).select(*FLAT))
    lake.write_lake(daily, path, "overwrite", ["year", "month", "day"])
    return path


def _lake_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.read_lake(spark, _lake(spark, sf_dir), FROM, TO, ["event_id", "user_id", "event_type"])


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "export")
    lake.export_recent(adapter.unsessioned(spark, sf_dir).select(*FLAT), path, END, 240)
    return spark.read.parquet(path).groupBy("year", "month", "day").agg(
        F.count("*").alias("events"), F.countDistinct("hour").alias("hours")
    )


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    columns = "l_orderkey long, l_partkey long, l_quantity double, l_shipdate date"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.select("l_orderkey", "l_partkey", "l_quantity", F.to_date("l_shipdate").alias("l_shipdate")).write.csv(
        path, header=True
    )
    return source.read_csv(spark, path, columns).groupBy("l_shipdate").agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "report")
    tables = report.Tables(
        adapter.events(spark, sf_dir), adapter.users(spark, sf_dir), adapter.products(spark, sf_dir),
        adapter.carts(spark, sf_dir), adapter.orders(spark, sf_dir),
    )
    report.build_report(tables, ["totals", "journey_funnel", "cart_sizes", "no_such_analysis"]).write(path)
    return spark.read.schema("analysis string, error string").json(f"{path}/summary")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "compact")
    lake.compact(spark, _lake(spark, sf_dir), path, ["year", "month", "day"])
    return spark.read.parquet(path).groupBy("year", "month", "day").agg(F.count("*").alias("events"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day of a lake with several small files a day: rows, files and bytes before and after two runs."""
    path, days = shared_dir(spark, "small"), ["year", "month", "day"]
    daily = lake.with_partitions(adapter.unsessioned(spark, sf_dir).select(*FLAT))
    for part in range(3):
        daily.where(F.col("event_id") % 3 == part).repartition(1).write.mode("append").partitionBy(*days).parquet(path)
    before = spark.createDataFrame(lake.census(spark, path, days).collect())
    runs = [lake.pack_small_files(spark, path, partition_by=days) for _ in range(2)]
    after = lake.census(spark, path, days).select(*days, F.col("files").alias("files_after"), F.col("bytes").alias("bytes_after"))
    rows = spark.read.parquet(path).groupBy(*days).agg(F.count("*").alias("events"), F.bit_xor(F.col("event_id")).alias("ids"))
    return rows.join(before, days).join(after, days).select(
        *days, "events", "ids", "files", "files_after", (F.col("bytes_after") < F.col("bytes")).alias("smaller"),
        F.lit(runs[1]).alias("rewritten_again"),
    )


add(
    "s13_small_files",
    _packed,
    """SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, count(*) AS events,
    bit_xor(event_id) AS ids, count(DISTINCT event_id % 3) AS files, CAST(1 AS BIGINT) AS files_after,
    count(DISTINCT event_id % 3) > 1 AS smaller, CAST(0 AS BIGINT) AS rewritten_again FROM events GROUP BY 1, 2, 3""",
)


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two incremental runs: the first half of the month, then what is new."""
    path = shared_dir(spark, "marks")
    events = adapter.unsessioned(spark, sf_dir)
    watermarks.advance(events.where(F.col("ts") < F.lit(MIDDLE)), path, "seo")
    fresh = watermarks.unprocessed(events, watermarks.read_watermarks(spark, path), "seo")
    return fresh.groupBy("event_type").agg(F.count("*").alias("events"))


add(
    "s4_lake_range",
    _lake_range,
    over_events(
        "SELECT event_id, user_id, event_type FROM alle WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'"
    ),
)
add(
    "s5_lake_partitions",
    lambda s, d: s.read.parquet(_lake(s, d)).groupBy("year", "month", "day").agg(F.count("*").alias("events")),
    "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, count(*) AS events FROM events GROUP BY 1, 2, 3",
)
add(
    "s6_recent_export",
    _exported,
    """SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, count(*) AS events,
    count(DISTINCT hour(ts)) AS hours FROM events WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3""",
)
add(
    "s7_csv_read",
    _csv,
    """SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS l_shipdate, count(*) AS lines, sum(l_quantity) AS quantity
    FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""",
)
add(
    "s10_result_summary",
    _results,
    """SELECT * FROM (VALUES ('totals', NULL), ('journey_funnel', NULL), ('cart_sizes', NULL),
    ('no_such_analysis', 'KeyError: ''no_such_analysis''')) t(analysis, error) WHERE (SELECT count(*) FROM events) > 0""",
)
add(
    "s11_report_suite",
    lambda s, d: report.build_report(report.Tables(adapter.events(s, d)), ["cart_abandonment"]).frames["cart_abandonment"],
    over_events(
        """, x AS (SELECT count(*) FILTER (WHERE event_type = 'add_to_cart') AS a,
          count(*) FILTER (WHERE event_type = 'purchase') AS p FROM ev GROUP BY session_id, user_id)
        SELECT count(*) AS total_sessions, count(*) FILTER (WHERE p = 0) AS abandoned_sessions,
        round(count(*) FILTER (WHERE p = 0) * 100.0::DOUBLE / count(*), 2) AS abandonment_rate FROM x WHERE a > 0"""
    ),
)
# Each analysis of the report, the query whose SQL gives its rows, and a column to add up.
REPORT = {
    "totals": ("a1_event_totals", None), "top_pages": ("a2_top_pages", None), "sessions": ("a4_session_stats", None),
    "time": ("a8_time_distribution", None), "seo_traffic": ("t4_traffic_by_channel", "visits"),
    "seo_landing": ("t5_landing_pages", None), "seo_bounce": ("t7_bounce_by_channel", None),
    "seo_conversion": ("t8_conversion_by_channel", None), "cart_abandonment": ("c1_abandonment", "total_sessions"),
    "cart_sizes": ("c12_cart_sizes", "carts"), "cart_value": ("c7_abandoned_value", None),
    "retention": ("r2_overall_retention", None), "retention_weekly": ("r3_weekly_cohorts", "users"),
    "retention_signup": ("r1_signup_cohorts", "cohort_size"), "journey_funnel": ("j1_ordered_funnel", None),
    "journey_paths": ("j6_common_paths", None), "conversion": ("j3_event_funnel", None),
    "conversion_sessions": ("j4_session_funnel", None), "patterns": ("m17_page_rules", None),
    "recommendations": ("p6_popular_products", "view_count"),
}


def _full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analysis, written and read back: rows, and the sum of one column."""
    path = shared_dir(spark, "report")
    events = adapter.events(spark, sf_dir)
    tables = report.Tables(
        events, adapter.users(spark, sf_dir), adapter.products(spark, sf_dir), adapter.carts(spark, sf_dir), adapter.orders(spark, sf_dir)
    )
    built = report.build_report(tables.stored())
    failed = built.write(path, "parquet")
    out = []
    for name, frame in built.frames.items():
        column = {"segmentation": "users"}.get(name) or REPORT.get(name, (None, None))[1]
        total = F.sum(column).cast("long") if column else F.lit(None).cast("long")
        written = spark.read.schema(frame.schema).parquet(f"{path}/{name}")
        out.append(written.agg(F.count("*").alias("rows"), total.alias("total")).select(F.lit(name).alias("analysis"), "rows", "total"))
    if failed:
        raise ValueError(f"analyses failed: {failed}")
    return reduce(DataFrame.unionByName, out)


def _full_report_sql() -> str:
    parts = [
        f"SELECT '{name}' AS analysis, count(*) AS rows, CAST({f'sum({column})' if column else 'NULL'} AS BIGINT) AS total FROM ({SQL[query]}) q"
        for name, (query, column) in REPORT.items()
    ]
    users = over_events("SELECT least(3, count(DISTINCT user_id)) AS n, count(DISTINCT user_id) AS u FROM ev")
    parts.append(f"SELECT 'segmentation', n, u FROM ({users}) q")
    parts.append(f"SELECT 'purchase', count(*), NULL FROM ({over_events('SELECT max(event_id) FROM ev')}) q")
    return " UNION ALL ".join(parts)


def add_full_report() -> None:
    """After all other queries, whose SQL it uses."""
    add("s11_full_report", _full_report, _full_report_sql())


add(
    "s13_compaction",
    _compacted,
    "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, count(*) AS events FROM events GROUP BY 1, 2, 3",
)
add(
    "s14_incremental",
    _incremental,
    over_events(
        """SELECT event_type, count(*) AS events FROM alle
        WHERE ts > (SELECT max(ts) FROM alle WHERE ts < TIMESTAMP '2024-01-16') GROUP BY 1"""
    ),
)


# Ids a tracker may send: a number, an object id, or none.
IDS = {
    "event_id": ["event_id"],
    "_id": ["lower(lpad(hex(event_id), 24, '0')) AS _id"],
    "none": [],
}


def messages(spark: SparkSession, sf_dir: str, ids: str = "event_id", far: bool = False, devices: bool = False) -> DataFrame:
    """The events as topic messages; searches are cut short so they cannot be parsed.

    ``far`` gives every seventh event a time no calendar has; with ``devices``
    several users share a session.
    """
    events = adapter.unsessioned(spark, sf_dir)
    seconds = F.unix_micros("ts") / 1e6
    body = F.struct(
        *[F.expr(x) for x in IDS[ids]],
        (F.concat(F.lit("d"), F.col("user_id").cast("long") % 40) if devices else F.concat(F.lit("s"), "user_id")).alias("session_id"),
        "user_id",
        "page",
        "event_type",
        F.create_map(F.lit("product_id"), F.col("product_id")).alias("properties"),
        (F.when(F.col("event_id") % 7 == 3, F.lit(1e17)).otherwise(seconds) if far else seconds).alias("timestamp"),
    )
    text = F.to_json(F.struct(body.alias("event"), F.create_map(F.lit("v"), F.lit("1")).alias("metadata")))
    broken = F.col("event_type") == "search"
    return events.select(F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("value"))


# Topics written in this application; queries that read the same one share it.
_TOPICS: dict[tuple, str] = {}


def _topic(spark: SparkSession, sf_dir: str, repeats: int = 1, ids: str = "event_id") -> str:
    """Message files in place of a topic; ``repeats`` sends every message again."""
    key = (spark.sparkContext.applicationId, sf_dir, repeats, ids)
    if key in _TOPICS:
        return _TOPICS[key]
    path = _TOPICS[key] = shared_dir(spark, "topic")
    for _ in range(repeats):
        messages(spark, sf_dir, ids).write.mode("append").text(path)
    return path


def _minute_stream(spark: SparkSession, sf_dir: str, repeats: int = 1, ids: str = "event_id") -> DataFrame:
    topic = _topic(spark, sf_dir, repeats, ids)
    table, state = shared_dir(spark, "minutes"), shared_dir(spark, "state")
    stream.run_minute_job(stream.text_source(spark, topic), table, state).awaitTermination()
    return stream.read_minutes(spark, table)


def _visit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = _topic(spark, sf_dir)
    table, state = shared_dir(spark, "visits"), shared_dir(spark, "state")
    events = stream.accepted(stream.decode(stream.text_source(spark, topic)))
    totals = stream.session_totals(events)
    stream.upsert_sink(totals, table, state).awaitTermination()
    return stream.read_sessions(spark, table)


# Sessions of devices, read once and kept for the queries on them: (application, folder) to table.
_DEVICES: dict[tuple, str] = {}


def _device_sessions(spark: SparkSession, sf_dir: str) -> str:
    """The session table after four batches of messages out of order, two of them after a restart."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DEVICES:
        topic, table, state = (shared_dir(spark, name) for name in ("topic", "sessions", "state"))
        lines = messages(spark, sf_dir, devices=True)
        for half in range(2):
            part = lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == half)
            part.repartition(2, "value").write.mode("append").text(topic)
            source_ = stream.text_source(spark, topic, files_per_trigger=1)
            live.run_session_job(source_, table, state, delay="60 days").awaitTermination()
        _DEVICES[key] = table
    return _DEVICES[key]


def _enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = _topic(spark, sf_dir)
    table, state = shared_dir(spark, "enriched"), shared_dir(spark, "state")
    events = stream.accepted(stream.decode(stream.text_source(spark, topic)))
    rich = stream.enrich(events, adapter.products(spark, sf_dir), adapter.users(spark, sf_dir)).select(
        F.col("event_id").cast("long").alias("event_id"), "product_details.name", "user_details.username"
    )
    query = rich.writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table)


MINUTES = f"""SELECT {ts_text("date_trunc('minute', ts)")} AS window_start,
  {ts_text("date_trunc('minute', ts) + INTERVAL 1 MINUTE")} AS window_end, page, event_type, count(*) AS count
  FROM alle WHERE event_type <> 'search' GROUP BY 1, 2, 3, 4"""
add(
    "w1_decoded_messages",
    lambda s, d: stream.checked(stream.decode(messages(s, d, far=True))).select(
        F.col("event_id").cast("long").alias("event_id"), "user_id", "page", "reject_reason"
    ),
    over_events(
        """SELECT CASE WHEN event_type <> 'search' THEN event_id END AS event_id, CASE WHEN event_type <> 'search' THEN user_id END AS user_id,
        CASE WHEN event_type <> 'search' THEN page END AS page, CASE WHEN event_type = 'search' THEN 'missing user_id' WHEN event_id % 7 = 3 THEN 'bad timestamp' END AS reject_reason FROM alle"""
    ),
)
add("w2_minute_counts", _minute_stream, over_events(MINUTES))
add("w7_exactly_once", lambda s, d: _minute_stream(s, d, repeats=2), over_events(MINUTES))
add("w7_object_ids", lambda s, d: _minute_stream(s, d, repeats=2, ids="_id"), over_events(MINUTES))
add(
    "w7_without_ids",
    lambda s, d: _minute_stream(s, d, repeats=2, ids="none"),
    over_events(MINUTES.replace("FROM alle", "FROM (SELECT DISTINCT user_id, page, event_type, product_id, ts FROM alle)")),
)
add(
    "w5_enriched_stream",
    _enriched_stream,
    over_events(
        """SELECT event_id, p.name, u.username FROM alle LEFT JOIN prod p USING (product_id) LEFT JOIN usr u USING (user_id)
        WHERE event_type <> 'search'""",
        PRODUCTS_SQL + USERS_SQL,
    ),
)
add(
    "w6_session_state",
    _visit_stream,
    over_events(
        f"""SELECT 's' || user_id AS session_id, {ts_text('min(ts)')} AS first_event_at, {ts_text('max(ts)')} AS last_event_at,
        count(*) AS event_count FROM alle WHERE event_type <> 'search' GROUP BY user_id"""
    ),
)
DEVICES = "SELECT 'd' || (CAST(user_id AS BIGINT) % 40) AS session_id, * FROM alle WHERE event_type <> 'search'"
add(
    "w6_session_upserts",
    lambda s, d: live.read_sessions(s, _device_sessions(s, d)),
    over_events(
        f"""SELECT session_id, arg_max(user_id, row(ts, CAST(event_id AS VARCHAR))) AS user_id, {ts_text('min(ts)')} AS first_event_at,
        {ts_text('max(ts)')} AS last_event_at, count(*) AS event_count FROM ({DEVICES}) d GROUP BY session_id"""
    ),
)
add(
    "w6_session_pages",
    lambda s, d: live.read_session_pages(s, _device_sessions(s, d)),
    over_events(f"SELECT DISTINCT session_id, page FROM ({DEVICES}) d"),
)
LIVE = datetime(2024, 1, 30, 12)
add(
    "w8_realtime_totals",
    lambda s, d: activity.minute_totals(_minute_stream(s, d), LIVE, 720),
    over_events(
        """, x AS (SELECT *, date_trunc('minute', ts) AS m FROM alle WHERE event_type <> 'search'
          AND date_trunc('minute', ts) >= TIMESTAMP '2024-01-30 00:00:00' AND date_trunc('minute', ts) <= TIMESTAMP '2024-01-30 12:00:00')
        SELECT 'page' AS kind, page AS bucket, count(*) AS events FROM x GROUP BY 2
        UNION ALL SELECT 'event_type', event_type, count(*) FROM x GROUP BY 2
        UNION ALL SELECT 'minute', strftime(m, '%Y-%m-%d %H:%M'), count(*) FROM x GROUP BY 2"""
    ),
)


def _daily_minutes(spark: SparkSession, sf_dir: str) -> str:
    """The minute table by day after the month was streamed in order; all but its last days are closed."""
    topic, table, state = (shared_dir(spark, name) for name in ("topic", "daily", "state"))
    lines = messages(spark, sf_dir)
    early = F.coalesce(F.get_json_object("value", "$.event.timestamp").cast("double") < MIDDLE.timestamp(), F.lit(False))
    for half in (early, ~early):
        lines.where(half).write.mode("append").text(topic)
        upserts.run_daily_minutes(stream.text_source(spark, topic), table, state).awaitTermination()
    return table


add("s9_daily_table", lambda s, d: upserts.read_daily_minutes(s, _daily_minutes(s, d)), over_events(MINUTES))
add(
    "w8_recent_minutes",
    lambda s, d: activity.minute_totals(
        upserts.read_daily_minutes(s, _daily_minutes(s, d), LIVE - timedelta(minutes=720), LIVE), LIVE, 720
    ),
    SQL["w8_realtime_totals"],
)


def _compacted_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's table after its batches were merged into one."""
    topic = _topic(spark, sf_dir)
    table, state, small = (shared_dir(spark, name) for name in ("minutes", "state", "merged"))
    stream.run_minute_job(stream.text_source(spark, topic), table, state).awaitTermination()
    stream.compact_upserts(spark, table, small, stream.MINUTE_KEYS, ["count"])
    return stream.read_minutes(spark, small)


def _closed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits the watermark has closed; open ones stay in the stream's state."""
    topic = _topic(spark, sf_dir)
    table, state = shared_dir(spark, "closed"), shared_dir(spark, "state")
    events = stream.accepted(stream.decode(stream.text_source(spark, topic)))
    visits = stream.session_state(events, "24 hours", delay=None)
    query = visits.writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table)


add("s9_upsert_table", _compacted_minutes, over_events(MINUTES))
add(
    "w4_closed_visits",
    _closed_visits,
    over_events(
        f""", g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000
             THEN 1 ELSE 0 END AS b FROM alle WHERE event_type <> 'search'),
        v AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
        x AS (SELECT user_id, n, min(ts) AS f, max(ts) AS l, count(*) AS c FROM v GROUP BY 1, 2)
        SELECT user_id, {ts_text('f')} AS first_event_at, {ts_text('l')} AS last_event_at, c AS event_count FROM x
        WHERE l + INTERVAL 24 HOUR <= (SELECT max(ts) FROM g) - INTERVAL 10 MINUTE"""
    ),
)
