"""Shared pieces of the registered queries and their SQL checks."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The generated events span January 2024; "now" is the end of that month.
START = datetime(2024, 1, 1)
END = datetime(2024, 1, 31)
MIDDLE = datetime(2024, 1, 16)
ORDERS_START = datetime(1990, 1, 1)


def plain(df: DataFrame) -> DataFrame:
    """Result columns in forms every SQL engine prints alike."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.array_join(col, ",")
        elif isinstance(kind, T.IntegralType):
            col = col.cast("long")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        out.append(col.alias(f.name))
    return df.select(*out)


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Register a query under its inventory id and, where possible, its SQL."""
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


# The canonical events of FIXTURES.md in SQL: `alle` with test traffic, `ev` without.
EVENTS_SQL = """
WITH base AS (
  SELECT event_id, user_id AS uid, CAST(user_id AS VARCHAR) AS user_id, ts, event_type AS raw, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), gaps AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY uid ORDER BY ts, event_id)) > 86400000000
                 THEN 1 ELSE 0 END AS brk
  FROM base
), numbered AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n
  FROM gaps
), alle AS (
  SELECT event_id, user_id, user_id || '-' || n AS session_id, ts,
    CASE WHEN raw = 'view' AND k % 5 = 0 THEN '/home'
         WHEN raw = 'view' AND k % 5 = 1 THEN '/category?category=cat' || (k % 8)
         WHEN raw = 'view' THEN '/p/item-' || k || '?id=' || k
         WHEN raw = 'click' THEN '/cart'
         WHEN raw = 'error' THEN '/search'
         ELSE '/checkout' END AS page,
    CASE raw WHEN 'view' THEN 'pageview' WHEN 'signup' THEN 'checkout' WHEN 'error' THEN 'search'
             WHEN 'click' THEN CASE WHEN k % 4 = 0 THEN 'remove_from_cart' ELSE 'add_to_cart' END
             ELSE raw END AS event_type,
    CAST(k AS VARCHAR) AS product_id, 'item-' || k AS product_name, 'cat' || (k % 8) AS category,
    value AS price, k % 3 + 1 AS quantity, value AS amount,
    CASE WHEN raw = 'signup' THEN [CAST(k AS VARCHAR), CAST((k + 1) % 100 AS VARCHAR), CAST((k + 7) % 100 AS VARCHAR)] END
      AS product_ids,
    ['google', 'bing', 'facebook', 'twitter', 'ads', 'direct', 'blog.partner.com', ''][uid % 8 + 1] AS referrer,
    CASE WHEN k = 99 THEN 'simulation' WHEN k % 2 = 0 THEN 'realistic_seed' END AS source,
    CASE WHEN raw <> 'view' THEN NULL WHEN k % 5 = 0 THEN '/home' WHEN k % 5 = 1 THEN '/category' ELSE '/p' END AS path,
    CASE WHEN k = 98 THEN TRUE WHEN k % 2 = 0 THEN FALSE END AS noisy,
    raw, k, uid
  FROM numbered
), ev AS (
  SELECT * FROM alle
  WHERE NOT coalesce(noisy, FALSE) AND (source IS NULL OR source NOT IN ('simulation', 'basic_sim', 'seed_demo'))
)"""

PRODUCTS_SQL = """, prod AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_type AS category, p_retailprice AS price,
         [p_brand, CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END] AS tags
  FROM part
)"""

USERS_SQL = """, usr AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username,
         CAST(f.first_day - CAST(c_custkey % 5 AS INTEGER) AS DATE) AS created_day
  FROM customer LEFT JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM alle GROUP BY 1) f
       ON f.user_id = CAST(c_custkey AS VARCHAR)
)"""

CARTS_SQL = """, crt AS (
  SELECT l_orderkey AS cart_id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS created_at,
         max(l_shipdate) OVER (PARTITION BY l_orderkey) AS updated_at,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'abandoned' END AS status,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice / l_quantity AS price
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

ORDER_EVENTS_SQL = """WITH ev AS (
  SELECT o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS session_id,
         o_orderdate AS ts, 'purchase' AS event_type, o_totalprice AS price
  FROM orders
)"""


def over_events(body: str, ctes: str = "") -> str:
    """A check over the canonical events, with more CTEs after them."""
    return f"{EVENTS_SQL}{ctes}\n{body}"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
