import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import recommend, retention, traffic
from frames import DAY, at, records


def days(user, *numbers, **more):
    return [{"user_id": user, "ts": DAY + timedelta(days=n), **more} for n in numbers]


def test_cohorts_and_matrix(make_events):
    events = make_events(days("a", 0, 7, 8, 40) + days("b", 0) + days("c", 8, 9))
    matrix = {str(r.cohort): (r.p0, r.p1, r.p2) for r in retention.weekly_cohort_matrix(events, 7, 3).collect()}
    assert matrix == {"2024-01-01": (2, 1, 0), "2024-01-08": (1, 0, 0)}
    totals = retention.weekly_retention_totals(events).first()
    assert (totals.total_users, totals.retained_users) == (3, 1)
    assert records(retention.overall_retention(events)) == [(3, 1, 1, 33.33, 33.33)]
    assert records(retention.overall_retention(events.limit(0))) == [(0, 0, 0, 0.0, 0.0)]


def test_period_zero_is_the_whole_cohort(make_events):
    events = make_events(days("a", 0, 9) + days("b", 1) + days("c", 3))
    first = {r.cohort: r.users for r in retention.weekly_cohorts(events).where("period = 0").collect()}
    assert sum(first.values()) == 3


def test_monthly_series_fills_gaps(make_events):
    events = make_events(days("a", 0, 95) + days("b", 0, 31))
    series = records(retention.monthly_retention(events, DAY).orderBy("month"))
    assert series == [("2024-01", 2, 0.0, 0.0), ("2024-02", 1, 0.5, 0.5), ("2024-03", 0, 0.0, 1.0), ("2024-04", 1, 0.0, 1.0)]
    cohort = {r.month_no: r.share for r in retention.monthly_cohorts(events, DAY).collect()}
    assert cohort == {0: 1.0, 1: 0.5, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.0}
    table = {r.month_number: r.retention_rate for r in retention.monthly_cohort_table(events).collect()}
    assert table == {0: 100.0, 1: 50.0, 3: 50.0}


def test_signup_cohorts_need_a_signup(spark, make_events):
    users = spark.createDataFrame([("a", "A", DAY), ("b", "B", None)], schema.USERS)
    events = make_events(days("a", 0, 31) + days("b", 0))
    got = retention.signup_cohorts(events, users).collect()
    assert [(r.cohort_size, r.retained_7d, r.retained_30d, r.retention_30d_rate) for r in got] == [(1, 1, 1, 100.0)]


def test_stages_engagement_patterns(make_events):
    events = make_events(days("new", 0, 1) + days("mid", 0, 45) + days("old", 0, 90, event_type="purchase", price=3.0))
    assert {r.customer_stage: r.users for r in retention.customer_stages(events).collect()} == {
        "New": 1, "Growing": 1, "Established": 1,
    }
    first = retention.daily_engagement(events).orderBy("day").first()
    assert (first.active_users, first.total_purchases) == (3, 1)
    busiest = {r.user_id: (r.purchases, r.avg_purchase_value) for r in retention.user_patterns(events).collect()}
    assert busiest["old"] == (2, 3.0) and busiest["new"] == (0, None)


def test_landing_and_bounce(make_events):
    events = traffic.with_channel(
        make_events(
            [
                {"session_id": "a", "ts": at(1), "page": "/second", "referrer": "google"},
                {"session_id": "a", "ts": at(0), "page": "/first", "referrer": "google"},
                {"session_id": "b", "ts": at(0), "page": "/first", "referrer": "google"},
                {"session_id": "b", "ts": at(2), "event_type": "purchase", "referrer": "google"},
            ]
        )
    )
    assert records(traffic.landing_pages(events)) == [("/first", "organic", 2, 1)]
    assert records(traffic.bounce_by(events)) == [("organic", 2, 1, 50.0)]
    assert records(traffic.conversion_by(events)) == [("organic", 2, 1, 50.0)]
    assert records(traffic.traffic_by(events)) == [("organic", 4, 1, 2)]
    assert {r.channel for r in traffic.channel_distribution(events).collect()} == {"seo", "direct", "social", "referral", "paid"}


def purchases(rows):
    return [
        {"user_id": u, "session_id": s, "product_id": p, "product_name": p, "category": c, "event_type": "purchase", "ts": at(m)}
        for u, s, p, c, m in rows
    ]


NOW = at(3000)


def test_trending_windows(make_events):
    events = make_events(purchases([("a", "1", "p", "c", 0), ("a", "1", "q", "c", 2990), ("a", "1", "q", "c", 2000)]))
    assert [(r.product_id, r.purchases) for r in recommend.trending(events, NOW, "hour").collect()] == [("q", 1)]
    assert [(r.product_id, r.purchases) for r in recommend.trending(events, NOW, "week").collect()] == [("q", 2), ("p", 1)]
    assert recommend.trending(events, NOW, "week", category="x").count() == 0


def test_personal_lists_fall_back_to_everyone(make_events):
    rows = purchases([("a", "1", "p1", "c1", 1), ("b", "2", "p2", "c2", 2), ("b", "2", "p2", "c2", 3)])
    rows += [{"user_id": "guest", "category": "c9", "event_type": "pageview"}]
    got = defaultdict(list)
    for r in recommend.personalized(make_events(rows), NOW, 5).orderBy("rank").collect():
        got[r.user_id].append(r.product_id)
    assert dict(got) == {"a": ["p1"], "b": ["p2"], "guest": ["p2", "p1"]}


def test_similar_and_cross_sell(make_events):
    rows = purchases(
        [("a", "1", "p1", "c1", 1), ("a", "1", "p2", "c1", 2), ("a", "1", "p2", "c1", 3), ("b", "2", "p3", "c2", 4)]
    )
    events = make_events(rows)
    similar = {(r.product_id, r.similar_id) for r in recommend.similar_products(events, NOW).collect()}
    assert similar == {("p1", "p2"), ("p2", "p1")}
    cross = {(r.product_id, r.partner_id): r.purchases for r in recommend.cross_sell(events).collect()}
    assert cross == {("p1", "p2"): 2, ("p2", "p1"): 1}
    assert [(r.product_id, r.purchases) for r in recommend.cross_sell_for(events, "p1").collect()] == [("p2", 2)]


def brute_candidates(rows, catalogue, n):
    want = set()
    for session in {r["session_id"] for r in rows}:
        mine = [r for r in rows if r["session_id"] == session]
        touched = {r["product_id"] for r in mine}
        in_cart = {r["product_id"] for r in mine if r["event_type"] == "add_to_cart"}
        viewed = {r["product_id"] for r in mine if r["event_type"] == "pageview"}
        known = [p for p in catalogue if p[0] in touched]
        categories, tags = Counter(p[2] for p in known), {t for p in known for t in p[4]}
        scored = []
        for p in catalogue:
            points = 5.0 * categories[p[2]] + 2.0 * len(set(p[4]) & tags)
            if points and p[0] not in in_cart:
                scored.append((-(points - 2.0 * (p[0] in viewed)), p[0]))
        want |= {(session, p, -s, i + 1) for i, (s, p) in enumerate(sorted(scored)[:n])}
    return want


def test_session_candidates_match_brute_force(spark, make_events):
    rng = random.Random(4)
    catalogue = [
        (f"p{i:02d}", f"n{i}", f"c{rng.randrange(4)}", 1.0, rng.sample(["red", "blue", "big", "new"], rng.randrange(4)))
        for i in range(40)
    ]
    products = spark.createDataFrame(catalogue, schema.PRODUCTS)
    rows = []
    for _ in range(120):
        session = "hot" if rng.random() < 0.34 else f"s{rng.randrange(20)}"
        kind = rng.choice(["pageview", "pageview", "add_to_cart", "purchase"])
        rows.append({"session_id": session, "product_id": f"p{rng.randrange(44):02d}", "event_type": kind})
    for n in (3, 12):
        got = set(records(recommend.session_candidates(make_events(rows), products, n)))
        assert got == brute_candidates(rows, catalogue, n)


def test_a_tag_on_a_third_of_the_catalogue(spark, make_events):
    """Small categories, one tag everywhere and one product with very many tags: lists stay right and rows few."""
    rng = random.Random(8)
    catalogue = []
    for i in range(450):
        tags = ["everywhere", f"rare{i}"] if i % 3 == 0 else [f"group{i % 50}", f"pair{i % 90}"]
        catalogue.append((f"p{i:03d}", f"n{i}", f"c{i // 2}", 1.0, tags))
    catalogue.append(("p900", "all", "c900", 1.0, [f"group{i}" for i in range(50)] + ["everywhere"]))
    products = spark.createDataFrame(catalogue, schema.PRODUCTS)
    rows = []
    for s in range(30):
        for i in rng.sample(range(0, 450, 3), 2) + [rng.randrange(450)]:
            rows.append({"session_id": f"s{s}", "product_id": f"p{i:03d}", "event_type": rng.choice(["pageview", "add_to_cart", "purchase"])})
    got = set(records(recommend.session_candidates(make_events(rows), products, 5)))
    assert got == brute_candidates(rows, catalogue, 5)

    known = spark.createDataFrame(rows).select("session_id", "product_id").distinct().join(products, "product_id")
    profiles = products.groupBy("category", F.sort_array("tags").alias("tags")).agg(
        F.min("product_id").alias("profile"), F.collect_list("product_id").alias("members")
    )
    hits = recommend._profile_hits(known, profiles, 5).count()
    assert hits < 30 * 40  # 150 products have the tag


def test_profiles_offer_what_better_ones_leave_room_for(spark, make_events):
    """Large profiles that sessions know well; the events are read once, for the table of touched products."""
    rng = random.Random(12)
    catalogue = [(f"p{i:02d}", f"n{i}", f"c{i % 2}", 1.0, [["red"], ["red", "big"], []][i // 2 % 3]) for i in range(60)]
    products = spark.createDataFrame(catalogue, schema.PRODUCTS)
    rows = []
    for s in range(12):
        for i in rng.sample(range(60), rng.choice([1, 2, 8, 40])):
            rows.append({"session_id": f"s{s}", "product_id": f"p{i:02d}", "event_type": rng.choice(["pageview", "add_to_cart", "purchase"])})
    for n in (2, 7, 30):
        found = recommend.session_candidates(make_events(rows), products, n)
        assert set(records(found)) == brute_candidates(rows, catalogue, n)
    assert "event_type" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_history_keeps_the_newest(spark):
    ddl = "user_id string, created_at timestamp, items int"
    old = spark.createDataFrame([("a", at(i), i) for i in range(6)], ddl)
    new = spark.createDataFrame([("a", at(100), 100), ("b", at(1), 1)], ddl)
    kept = recommend.keep_history(old, new, 5)
    assert sorted(r["items"] for r in kept.where(F.col("user_id") == "a").collect()) == [2, 3, 4, 5, 100]


def test_affinity_sums_to_one(make_events):
    events = make_events([{"category": "c1"}, {"category": "c2"}, {"category": "c2"}, {"category": "c1", "user_id": "x"}])
    total = recommend.category_affinity(events).groupBy("user_id").agg(F.round(F.sum("affinity"), 5).alias("t"))
    assert {r.t for r in total.collect()} == {1.0}


def test_combined_names_every_kind(make_events):
    rows = purchases([("a", "1", "p1", "c1", 2900), ("a", "1", "p2", "c1", 2950)])
    kinds = {r.kind for r in recommend.combined(make_events(rows), NOW).collect()}
    assert kinds == {"personalized", "category", "trending", "seasonal", "similar", "cross_sell"}


def test_dates_are_utc(make_events):
    events = make_events([{"ts": datetime(2024, 1, 1, 23, 59)}])
    assert traffic.hourly_traffic(events).first().hour == 23


def test_cohort_matrix_has_every_period(spark, make_events):
    rows = [row for week in range(11) for row in days("u", 7 * week)]
    matrix = retention.weekly_cohort_matrix(make_events(rows)).collect()
    assert [[r[f"p{i}"] for i in range(11)] for r in matrix] == [[1] * 11]
