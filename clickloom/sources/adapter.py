"""Test tables (events, orders, lineitem, part, customer) as canonical tables.

The generated tables know no pages, sessions or products, so these rules
derive them from the event's ``k`` property; FIXTURES.md states each rule.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import sessions
from clickloom.sources import events as event_source


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of FIXTURES.md as Spark SQL, one text per column.
_PAGE = """CASE WHEN event_type = 'view' AND k % 5 = 0 THEN '/home'
  WHEN event_type = 'view' AND k % 5 = 1 THEN concat('/category?category=cat', k % 8)
  WHEN event_type = 'view' THEN concat('/p/item-', k, '?id=', k)
  WHEN event_type = 'click' THEN '/cart'
  WHEN event_type = 'error' THEN '/search'
  ELSE '/checkout' END"""
_EVENT_TYPE = """CASE event_type WHEN 'view' THEN 'pageview' WHEN 'signup' THEN 'checkout' WHEN 'error' THEN 'search'
  WHEN 'click' THEN IF(k % 4 = 0, 'remove_from_cart', 'add_to_cart') ELSE event_type END"""
_REFERRER = """element_at(array('google', 'bing', 'facebook', 'twitter', 'ads', 'direct', 'blog.partner.com', ''),
  CAST(user_id % 8 + 1 AS int))"""
_PATH = """CASE WHEN event_type <> 'view' THEN NULL WHEN k % 5 = 0 THEN '/home'
  WHEN k % 5 = 1 THEN '/category' ELSE '/p' END"""
_BASKET = """CASE WHEN event_type = 'signup'
  THEN array(CAST(k AS string), CAST((k + 1) % 100 AS string), CAST((k + 7) % 100 AS string)) END"""
_TOTAL = "CASE WHEN event_type = 'purchase' AND k % 10 <> 0 THEN value END"
_NOISY = "CASE WHEN k = 98 THEN true WHEN k % 2 = 0 THEN false END"
_SOURCE = "CASE WHEN k = 99 THEN 'simulation' WHEN k % 2 = 0 THEN 'realistic_seed' END"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS bigint) AS k"
    )


def unsessioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical event columns, but without a session."""
    return _base(spark, sf_dir).selectExpr(
        "event_id",
        "CAST(user_id AS string) AS user_id",
        "CAST(ts AS timestamp) AS ts",
        f"{_PAGE} AS page",
        f"{_EVENT_TYPE} AS event_type",
        "CAST(k AS string) AS product_id",
        "concat('item-', k) AS product_name",
        "concat('cat', k % 8) AS category",
        "value AS price",
        "CAST(k % 3 + 1 AS int) AS quantity",
        f"coalesce({_TOTAL}, value) AS amount",
        f"{_BASKET} AS product_ids",
        f"{_REFERRER} AS referrer",
        "CAST(NULL AS string) AS utm_source",
        f"{_SOURCE} AS source",
        "CAST(NULL AS string) AS search_term",
        f"{_PATH} AS path",
        f"{_NOISY} AS noisy",
    )


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with sessions, test traffic included."""
    return sessions.sessionize(unsessioned(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with sessions, test traffic removed."""
    return event_source.drop_noise(all_events(spark, sf_dir))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a tracker would send them: text times and a property map."""
    properties = f"""map('product_id', CAST(k AS string), 'category', concat('cat', k % 8), 'price', CAST(value AS string),
      'quantity', CAST(k % 3 + 1 AS string), 'total_amount', CAST({_TOTAL} AS string), 'referrer', {_REFERRER})"""
    return _base(spark, sf_dir).selectExpr(
        "event_id",
        "CAST(user_id AS string) AS user_id",
        "concat('s', user_id) AS session_id",
        "CAST(unix_seconds(CAST(ts AS timestamp)) AS string) AS timestamp",
        f"{_PAGE} AS page",
        "event_type",
        f"{properties} AS properties",
        f"{_NOISY} AS noisy",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (
        F.when(F.col("p_size") <= 15, F.lit("small"))
        .when(F.col("p_size") <= 30, F.lit("medium"))
        .otherwise(F.lit("large"))
    )
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.array(F.col("p_brand"), size).alias("tags"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = unsessioned(spark, sf_dir).groupBy("user_id").agg(F.min(F.to_date("ts")).alias("_first"))
    people = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("username"),
        (F.col("c_custkey") % 5).cast("int").alias("_days"),
    )
    created = F.date_sub("_first", F.col("_days")).cast("timestamp")
    return people.join(first, "user_id", "left").select("user_id", "username", created.alias("created_at"))


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
        .when(F.col("o_orderstatus") == "O", F.lit("active"))
        .otherwise(F.lit("abandoned"))
    )
    items = _table(spark, sf_dir, "lineitem")
    updated = items.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp").alias("updated_at"))
    heads = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        status.alias("status"),
    )
    # A left join with unique keys is left out of the plans that do not read updated_at.
    return items.join(heads.join(updated, "l_orderkey", "left"), "l_orderkey").select(
        F.col("l_orderkey").alias("cart_id"),
        "user_id",
        F.col("l_orderkey").cast("string").alias("session_id"),
        "created_at",
        "updated_at",
        "status",
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def cart_rows(spark: SparkSession, sf_dir: str) -> int:
    """The number of rows of carts() at most, read from the file's metadata."""
    return _table(spark, sf_dir, "lineitem").count()


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as purchase events, for multi-year retention."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.lit("purchase").alias("event_type"),
        F.col("o_totalprice").alias("price"),
    )


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as (basket, product) pairs."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("basket_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
    )
