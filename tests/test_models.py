import random

import pytest
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import features, models
from clickloom.sources import adapter
from contract import learned
from frames import at, records


def test_interaction_weights(make_events):
    events = make_events(
        [
            {"product_id": "p"},
            {"product_id": "p", "event_type": "purchase"},
            {"product_id": "q", "event_type": "login"},
            {"event_type": "checkout", "product_ids": ["p", "r"]},
            {"event_type": "search"},
        ]
    )
    ratings = {r.product_id: r.rating for r in features.interactions(events).collect()}
    assert ratings == {"p": 13.0, "q": 1.0, "r": 4.0}
    heavier = features.interactions(events, {"purchase": 20.0})
    assert {r.product_id: r.rating for r in heavier.collect()}["p"] == 25.0
    assert {r.product_id: r.rating for r in features.max_ratings(events).collect()} == {"p": 5.0}
    capped = {r.product_id: (r.view_count, r.rating) for r in features.capped_ratings(events).collect()}
    assert capped == {"p": (2, 2.0), "q": (1, 0.5)}


def test_dense_index_is_dense_and_stable(spark):
    ids = spark.range(500).select(F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("user_id"))
    first = records(models.dense_index(ids, "user_id", "i", buckets=7).orderBy("i"))
    again = records(models.dense_index(ids.repartition(5), "user_id", "i", buckets=7).orderBy("i"))
    assert [i for _, i in first] == list(range(300)) and first == again


@pytest.fixture(scope="module")
def recommender(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for u in range(40):
        for p in range(12):
            if rng.random() < 0.7:
                rows.append((f"u{u}", f"p{p}", 5.0 if u % 2 == p % 2 else 1.0))
    ratings = spark.createDataFrame(rows, "user_id string, product_id string, rating double")
    return models.fit_als(ratings, str(tmp_path_factory.mktemp("als")), rank=4, max_iter=5)


def test_als_learns_the_pattern(spark, recommender):
    model, rmse = recommender
    assert 0 < rmse < 1.5
    top = models.als_top_n(model, 3)
    assert top.count() == 40 * 3
    same = [int(r.user_id[1:]) % 2 == int(r.product_id[1:]) % 2 for r in top.collect()]
    assert sum(same) / len(same) > 0.9
    one = models.als_top_n(model, 3, spark.createDataFrame([("u1",)], "user_id string"))
    assert [r["rank"] for r in one.orderBy("rank").collect()] == [1, 2, 3]


def test_saved_recommender_gives_the_same_lists(spark, recommender):
    model, _ = recommender
    loaded = models.Recommender.load(spark, model.path)
    key = ["user_id", "product_id", "rank"]
    assert set(records(models.als_top_n(loaded, 2).select(*key))) == set(records(models.als_top_n(model, 2).select(*key)))


def test_similar_items_use_the_factors(recommender):
    model, _ = recommender
    similar = models.similar_items(model, ["p0", "p1"], 3).collect()
    assert len(similar) == 6 and all(r.product_id != r.similar_id for r in similar)
    assert all(int(r.product_id[1:]) % 2 == int(r.similar_id[1:]) % 2 for r in similar)


def test_unrounded_segment_means_give_back_totals(spark):
    """Thirty thousand users: a mean of four digits would be off by more than one event."""
    frame = spark.range(30_001).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 7).cast("double").alias("n"))
    model = models.fit_segments(frame, ["n"], k=3)
    stats = models.segment_stats(model, frame, ["n"], digits=None)
    total = stats.agg(F.round(F.sum(F.col("avg_n") * F.col("users")))).first()[0]
    assert total == sum(i % 7 for i in range(30_001))


def test_segments_split_two_groups(spark, tmp_path):
    rows = [(f"u{i}", float(i % 2 * 100 + i % 5), float(i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "user_id string, a double, b double")
    model = models.fit_segments(frame, ["a", "b"], k=2, scaled=True, path=str(tmp_path))
    assert models.silhouette(model, frame) > 0.2
    stats = models.segment_stats(model, frame, ["a"])
    assert stats.agg(F.sum("users")).first()[0] == 60
    assert models.segment_centres(model, spark).count() == 2
    loaded = models.PipelineModel.load(str(tmp_path))
    assert set(records(models.assign_segments(loaded, frame))) == set(records(models.assign_segments(model, frame)))
    _, best, scores = models.best_segments(frame, ["a"], range(2, 4))
    assert set(scores) == {2, 3} and best in scores


@pytest.mark.parametrize(
    "means, label",
    [
        ((2000.0, 0.0, 0.0, 0.6, 0.0, 0.0), "High Value"),
        ((600.0, 0.0, 0.0, 0.3, 0.0, 0.0), "Regular Buyer"),
        ((0.0, 11.0, 0.0, 0.0, 3.0, 0.0), "Browser"),
        ((0.0, 0.0, 4.0, 0.0, 0.0, 6.0), "Active Explorer"),
        ((1000.0, 0.0, 0.0, 0.1, 0.0, 0.0), "Occasional Visitor"),
    ],
)
def test_segment_names(spark, means, label):
    ddl = "avg_spend double, avg_cart_adds double, avg_categories double, avg_purchase_freq double, avg_abandon_ratio double, avg_daily_activity double"
    assert spark.createDataFrame([means], ddl).select(models.segment_label()).first()[0] == label


def test_purchase_models_beat_chance(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        adds = rng.randrange(6)
        rows.append((f"s{i}", rng.random() * 100, float(rng.randrange(5)), float(rng.randrange(3)), float(adds), 1.0 if adds + rng.random() > 3 else 0.0))
    frame = spark.createDataFrame(rows, "session_id string, duration double, page_views double, product_views double, cart_adds double, label double")
    _, tree = models.fit_tree(frame, features.SESSION_FEATURES)
    assert tree.first().auc > 0.8 and tree.first().depth <= 5
    model, report = models.fit_logistic(frame, features.SESSION_FEATURES)
    assert report.first().auc > 0.8
    scored = models.purchase_probability(model, frame).collect()
    assert len(scored) == 400 and all(0 <= r.probability <= 1 for r in scored)


def test_session_history_looks_back_only(make_events):
    rows = [
        {"session_id": s, "user_id": "u", "ts": at(m), "event_type": kind}
        for s, m, kind in (("a", 0, "pageview"), ("b", 10, "purchase"), ("c", 20, "pageview"))
    ]
    got = {r.session_id: (r.label, r.has_history) for r in features.session_features(make_events(rows)).collect()}
    assert got == {"a": (0.0, 0.0), "b": (1.0, 0.0), "c": (0.0, 1.0)}


def test_baskets_and_rules(spark, make_events):
    events = make_events(
        [
            {"event_type": "checkout", "product_ids": ["a", "b", "a", None, ""]},
            {"event_type": "checkout", "product_ids": ["a", "b"]},
            {"event_type": "purchase", "product_id": "a"},
            {"event_type": "purchase", "product_id": None},
        ]
    )
    baskets = features.product_baskets(events)
    assert [r["items"] for r in baskets.orderBy("event_id").collect()] == [["a", "b"], ["a", "b"], ["a"]]
    model = models.fit_patterns(baskets, 0.1, 0.1)
    rules = models.association_rules(model)
    products = spark.createDataFrame([("a", "A", "c", 1.0, []), ("b", "B", "c", 2.0, [])], schema.PRODUCTS)
    related = {(r.product_id, r.related_id): r.score for r in models.related_products(rules, products).collect()}
    assert related == {("a", "b"): 0.667, ("b", "a"): 1.0}
    patterns = models.frequent_patterns(model, baskets).collect()
    assert [(r["items"], r.frequency, r.support) for r in patterns] == [("a,b", 2, 0.6667)]
    pages = make_events([{"page": "/p/x?id=1"}, {"page": "/p/y?id=2"}, {"page": "/category?category=c"}, {"page": "/home", "session_id": "t"}])
    assert [r["items"] for r in features.page_baskets(pages).collect()] == [["/category", "/product"]]


def test_user_feature_ratios(make_events, spark, tables):
    events = make_events([{"event_type": "purchase", "price": 10.0, "amount": 12.0, "category": "c"}] * 2 + [{"category": "d"}] * 4)
    row = features.customer_features(events).first()
    assert (row.total_events, row.purchases, row.total_spend, row.avg_order_value, row.categories_viewed) == (6, 2, 20.0, 10.0, 2)
    full = features.user_features(events, at(24 * 60)).first()
    assert (full.revenue, full.aov, full.views) == (24.0, 12.0, 4)
    assert features.customer_features(events, min_events=7).count() == 0
    assert features.user_features_basic(adapter.events(spark, tables)).where("conversion_rate > 1").count() == 0


class Fitted(Exception):
    """Carries what a fit was asked to read."""


def read_by(monkeypatch, fit, query, spark, tables):
    def stop(table, *_, **__):
        raise Fitted(table.inputFiles())

    monkeypatch.setattr(models, fit, stop)
    with pytest.raises(Fitted) as asked:
        query(spark, tables)
    return asked.value.args[0]


@pytest.mark.parametrize("query", ["_assigned", "_basic_segments"])
def test_segments_are_fitted_on_features_computed_once(spark, tables, monkeypatch, query):
    files = read_by(monkeypatch, "fit_segments", getattr(learned, query), spark, tables)
    assert files and all("/features-" in f for f in files)


def test_als_is_fitted_on_ratings_computed_once(spark, tables, monkeypatch):
    files = read_by(monkeypatch, "fit_als", learned._als_score, spark, tables)
    assert files and all("/interactions-" in f for f in files)
