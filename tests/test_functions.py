from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickloom.functions import pages, traffic, values
from clickloom.sources import events as source
from frames import records


def one(spark, column, **fields):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string", dict: "map<string,string>"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1704067200", datetime(2024, 1, 1)),
        ("1704067200000", datetime(2024, 1, 1)),
        ("1704067200.5", datetime(2024, 1, 1, 0, 0, 0, 500000)),
        ("2024-01-01T00:00:00Z", datetime(2024, 1, 1)),
        ("2024-01-01 00:00:00", datetime(2024, 1, 1)),
        ("2024-01-01 00:00:00.250", datetime(2024, 1, 1, 0, 0, 0, 250000)),
        ("soon", None),
        ("", None),
        ("99999999999999999999", None),
        (None, None),
    ],
)
def test_any_time(spark, text, want):
    assert one(spark, values.any_time(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "props, want",
    [
        ({"total_amount": "1,234.50"}, 1234.5),
        ({"total_amount": "", "total": "7"}, 7.0),
        ({"amount": "n/a", "price": "5"}, 0.0),
        ({"price": "5", "cart_items": "3"}, 15.0),
        ({"price": "5"}, 5.0),
        ({}, 0.0),
    ],
)
def test_purchase_amount(spark, props, want):
    df = spark.createDataFrame([(props,)], "p map<string,string>")
    assert df.select(values.purchase_amount(F.col("p"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [("ABCDEFABCDEFABCDEFABCDEF", "abcdefabcdefabcdefabcdef"), ("abc", None), (None, None), ("z" * 24, None)],
)
def test_object_id(spark, text, want):
    assert one(spark, values.object_id(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "page, normal, base",
    [
        ("/product/42?ref=x", "/product/42", "/product"),
        ("/product/", "/product/", "/product"),
        ("/p/shoe?id=1", "/p/shoe?id=1", "/product"),
        ("/category/shoes", "/category/shoes", "/category"),
        ("/category?category=a", "/category?category=a", "/category"),
        ("/search?q=a", "/search?q=a", "/search"),
        (" /home ", "/home", "/home"),
        (None, "", ""),
    ],
)
def test_page_forms(spark, page, normal, base):
    assert one(spark, pages.normal_page(F.col("x")), x=page) == normal
    assert one(spark, pages.page_base(F.col("x")), x=page) == base


ID = "a" * 24


@pytest.mark.parametrize(
    "page, pid, want",
    [
        ("/p/shoe", ID, f"/p/shoe?id={ID}"),
        ("/p/shoe?id=bad", ID, f"/p/shoe?id={ID}"),
        ("/p/shoe?a=1&id=bad&b=2", ID, f"/p/shoe?a=1&id={ID}&b=2"),
        ("/p/shoe?a=1", ID, f"/p/shoe?a=1&id={ID}"),
        ("/p/shoe?id=7", "7", "/p/shoe?id=7"),
        ("/home", ID, "/home"),
        ("/p/shoe", None, "/p/shoe"),
    ],
)
def test_canonical_product_page(spark, page, pid, want):
    assert one(spark, pages.canonical_product_page(F.col("x"), F.col("y")), x=page, y=pid) == want


@pytest.mark.parametrize(
    "page, category, want",
    [
        ("/category", "a$1", "/category?category=a$1"),
        ("/category?category=old&x=1", "new", "/category?category=new&x=1"),
        ("/category?x=1", "new", "/category?x=1&category=new"),
        ("/category/x", "new", "/category?category=new"),
        ("/category?x=1", None, "/category?x=1"),
    ],
)
def test_canonical_category_page(spark, page, category, want):
    assert one(spark, pages.canonical_category_page(F.col("x"), F.col("y")), x=page, y=category) == want


@pytest.mark.parametrize(
    "referrer, source, a, b, c",
    [
        ("https://google.com/ads", None, "organic", "organic_search", "seo"),
        ("LinkedIn", None, "social", "referral", "referral"),
        ("instagram.com", None, "referral", "social", "social"),
        ("ads.net", None, "paid", "paid", "paid"),
        ("direct", None, "referral", "direct", "direct"),
        ("", None, "direct", "direct", "direct"),
        (None, None, "direct", "unknown", "direct"),
        ("google", "my_ads", "paid", "organic_search", "seo"),
        ("research.org", "ads", "paid", "paid", "referral"),
    ],
)
def test_channels(spark, referrer, source, a, b, c):
    r, s = F.col("r"), F.col("s")
    got = spark.createDataFrame([(referrer, source)], "r string, s string").select(
        traffic.marketing_channel(r, F.lit(None).cast("string"), s),
        traffic.traffic_source(r, s),
        traffic.referral_channel(r),
    )
    assert records(got) == [(a, b, c)]


def test_noise_keeps_unflagged_events(spark):
    rows = [(1, None, None), (2, True, None), (3, False, "simulation"), (4, False, "shop"), (5, None, "basic_sim")]
    df = spark.createDataFrame(rows, "id int, noisy boolean, source string")
    assert [r.id for r in source.drop_noise(df).orderBy("id").collect()] == [1, 4]


def test_slug(spark):
    assert one(spark, pages.slug(F.col("x")), x="  Red & Blue Shoe! ") == "red-blue-shoe"


def test_event_type_aliases(spark):
    got = [
        one(spark, traffic.canonical_event_type(F.col("x")), x=x)
        for x in ("page_view", "conversion", None, "", "login")
    ]
    assert got == ["pageview", "purchase", "pageview", "pageview", "login"]
