import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import baskets, cart
from clickloom.sources import adapter
from frames import at, records
from test_journey import by_session, random_rows


@pytest.mark.parametrize("minutes", [20, 500, 5000])
def test_cart_sizes_match_a_running_sum(make_events, minutes):
    rows = random_rows(250, seed=minutes, minutes=minutes)
    want = {}
    for session, events in by_session(rows).items():
        acts = [e for e in events if e["event_type"] in ("add_to_cart", "remove_from_cart", "checkout", "purchase")]
        if not acts:
            continue
        size, peak = 0, -(10**9)
        for e in acts:
            size += {"add_to_cart": 1, "remove_from_cart": -1}.get(e["event_type"], 0)
            peak = max(peak, size)
        want[session] = (peak, acts[-1]["event_type"], sorted({e["product_id"] for e in acts}))
    got = {r.session_id: (r.max_items, r.last_event, r.products) for r in cart.cart_sessions(make_events(rows)).collect()}
    assert got == want


def test_abandonment_with_and_without_purchase(make_events):
    events = make_events(
        [
            {"session_id": "bought", "event_type": "add_to_cart"},
            {"session_id": "bought", "event_type": "purchase"},
            {"session_id": "left", "event_type": "add_to_cart"},
            {"session_id": "direct", "event_type": "purchase"},
            {"session_id": "view"},
        ]
    )
    assert records(cart.abandonment(events)) == [(2, 1, 50.0)]
    assert records(cart.never_purchased(events)) == [("left",)]
    flags = cart.abandonment_flags(events).first()
    assert (flags.total_sessions, flags.cart_sessions, flags.purchase_sessions) == (4, 2, 2)
    assert records(cart.abandonment(events.limit(0))) == [(0, 0, 0.0)]


def test_recovery_ignores_sessions_anyone_bought_in(make_events):
    rows = [{"user_id": "a", "session_id": f"s{i}", "event_type": "add_to_cart", "price": 10.0 * i} for i in (1, 2, 3)]
    rows.append({"user_id": "b", "session_id": "s3", "event_type": "purchase"})
    got = cart.recovery_opportunities(make_events(rows)).collect()
    assert [(r.user_id, r.abandoned_carts, r.avg_cart_value) for r in got] == [("a", 2, 15.0)]


def test_open_cart_reports(spark):
    rows = [
        (1, "u", "s", at(0), at(30), "abandoned", "p", 2, 5.0),
        (1, "u", "s", at(0), at(30), "abandoned", "q", 1, 1.0),
        (2, "u", "s", at(0), at(0), "active", "p", 1, 7.0),
        (3, "u", "s", at(0), at(90), "completed", "p", 9, 9.0),
    ]
    carts = spark.createDataFrame(rows, schema.CARTS)
    names = spark.createDataFrame([("p", "pen"), ("p", "pencil")], "product_id string, product_name string")
    assert records(cart.most_abandoned(carts, names, 1)) == [("p", 2, 3, 6.0, "pencil")]
    assert records(cart.time_to_abandon(carts)) == [(30.0, 30.0, 30.0)]
    assert records(cart.abandoned_value(carts)) == [(18.0, 6.0, 2)]
    totals = {r.cart_id: (r["items"], r.total) for r in cart.cart_totals(carts).collect()}
    assert totals[1] == (3, 11.0) and totals[3] == (9, 81.0)


def test_timing_sizes_and_buckets(make_events):
    events = make_events(
        [
            {"session_id": "a", "event_type": "add_to_cart", "ts": at(0), "price": 60.0, "quantity": 2},
            {"session_id": "a", "event_type": "purchase", "ts": at(2)},
            {"session_id": "b", "event_type": "add_to_cart", "ts": at(0), "price": 10.0, "quantity": None},
            {"session_id": "b", "ts": at(5)},
            {"session_id": "c", "event_type": "add_to_cart", "price": 500.0, "quantity": 9},
        ]
    )
    timing = {r.outcome: (r.sessions, r.avg_time_seconds) for r in cart.cart_timing(events).collect()}
    assert timing == {"Purchased": (1, 120.0), "Abandoned": (2, 150.0)}
    sizes = {r["size"]: r.carts for r in cart.cart_size_distribution(events).collect()}
    assert sizes == {"1": 1, "2": 1, "3": 0, "4": 0, "5+": 1}
    assert records(cart.cart_size_totals(events)) == [(3, 12, 4.0)]
    values = {r.value_range: r.conversion_rate for r in cart.value_buckets(events).collect()}
    assert values == {"Under $50": 0.0, "$50-$100": 1.0, "Over $200": 0.0}


def test_channel_falls_back_to_the_session(make_events):
    events = make_events(
        [
            {"session_id": "a", "referrer": "google"},
            {"session_id": "a", "event_type": "checkout", "referrer": None},
            {"session_id": "a", "event_type": "purchase", "referrer": "ads.net"},
        ]
    )
    got = {r.channel: (r.checkouts, r.purchases, r.abandonment_rate) for r in cart.abandonment_by_channel(events).collect()}
    assert got == {"seo": (1, 0, 1.0), "paid": (0, 1, None)}
    assert [r.channel for r in cart.worst_channels(cart.abandonment_by_channel(events)).collect()] == ["seo"]


def brute_partners(items, repeats):
    baskets_of = defaultdict(Counter)
    for basket, product in items:
        if product:
            baskets_of[basket][product] += 1
    together = defaultdict(Counter)
    for content in baskets_of.values():
        for a, b in permutations(content, 2):
            together[a][b] += content[b] if repeats else 1
    return together


@pytest.mark.parametrize("head, cell, repeats", [(0, 1, False), (3, 2, True), (6, 5, True), (32, 128, False)])
def test_top_partners_are_exact_with_huge_baskets(spark, head, cell, repeats):
    rng = random.Random(cell)
    items = [(f"b{rng.randrange(25)}", f"p{rng.randrange(12):02d}") for _ in range(120)]
    # A third of all rows in one basket, and a second large one.
    items += [("hot", f"p{rng.randrange(30):02d}") for _ in range(90)]
    items += [("warm", f"p{i:02d}") for i in range(8, 20)] + [("b1", None), ("b1", "")]
    frame = spark.createDataFrame(items, "basket_id string, product_id string")
    want = {}
    for product, partners in brute_partners(items, repeats).items():
        ranked = sorted(partners.items(), key=lambda x: (-x[1], x[0]))[:4]
        want[product] = [(p, n) for p, n in ranked]
    got = defaultdict(list)
    for r in baskets.top_partners(frame, 4, repeats, head, cell).orderBy("product_id", "rank").collect():
        got[r.product_id].append((r.partner_id, r.together))
    assert dict(got) == want


def test_top_pairs_are_exact(spark):
    rng = random.Random(9)
    items = [(f"b{rng.randrange(30)}", f"p{rng.randrange(15):02d}") for _ in range(200)]
    items += [("hot", f"p{i:02d}") for i in range(15)]
    frame = spark.createDataFrame(items, "basket_id string, product_id string")
    pairs = {(a, b): n for a, row in brute_partners(items, False).items() for b, n in row.items() if a < b}
    want = sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda x: (-x[2], x[0], x[1]))[:6]
    for head, cell in ((0, 2), (4, 3), (32, 128)):
        assert records(baskets.top_pairs(frame, 6, head, cell)) == want
    assert baskets.top_pairs(frame.limit(0)).count() == 0


@pytest.mark.parametrize("leaders, block", [(0, 3), (5, 4), (2048, 2048)])
def test_few_wide_baskets_are_compared_by_bits(spark, monkeypatch, leaders, block):
    """Seventy baskets of most products: no pair is listed by basket."""
    monkeypatch.setattr(baskets, "_pairs", None)
    rng = random.Random(block)
    items = [(f"b{b}", f"p{p:02d}") for p in range(25) for b in rng.sample(range(70), 20 + p)]
    items += [(f"b{b}", f"q{p:02d}") for p in range(12) for b in range(3, 64)]  # equal products
    frame = spark.createDataFrame(items, "basket_id string, product_id string")
    pairs = {(a, b): n for a, row in brute_partners(items, False).items() for b, n in row.items() if a < b}
    want = sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda x: (-x[2], x[0], x[1]))
    for n in (4, 80):
        assert records(baskets.top_pairs(frame, n, leaders=leaders, block=block)) == want[:n]


def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """A task's share of the listed pairs is bounded, and the setting is put back."""
    monkeypatch.setattr(baskets, "TASK", 50)
    planned, pairs, key = [], baskets._pairs, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)

    def seen(members, item, cell, tasks=None):
        planned.append((tasks, int(spark.conf.get(key))))
        return pairs(members, item, cell, tasks)

    monkeypatch.setattr(baskets, "_pairs", seen)
    items = [(f"b{b}", f"p{p:02d}") for b in range(40) for p in range(b % 7, 20, 3)]
    frame = spark.createDataFrame(items, "basket_id string, product_id string")
    counts = {(a, b): n for a, row in brute_partners(items, False).items() for b, n in row.items() if a < b}
    want = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda x: (-x[2], x[0], x[1]))[:6]
    assert records(baskets.top_pairs(frame, 6, head=0, few=0)) == want
    listed = sum(m * (m - 1) // 2 for m in Counter(b for b, _ in set(items)).values())
    assert planned[-1] == (-(-listed // 50), -(-listed // 50)) and spark.conf.get(key) == before


def test_equal_products_share_a_list(spark, monkeypatch):
    """Of products in the same few baskets only the first ids are listed by basket."""
    rng = random.Random(4)
    items = [(f"b{b}", f"p{p:03d}") for p in range(150) for b in rng.choice([(0, 1, 2), (0, 2), (1, 3), (4,), (0, 1, 2, 3, 4)])]
    frame = spark.createDataFrame(items, "basket_id string, product_id string")
    listed, sizes = baskets._listed_partners, []
    monkeypatch.setattr(baskets, "_listed_partners", lambda m, *rest: sizes.append(m.select("product_id").distinct().count()) or listed(m, *rest))
    got = defaultdict(list)
    for r in baskets.top_partners(frame, 3).orderBy("product_id", "rank").collect():
        got[r.product_id].append((r.partner_id, r.together))
    want = {p: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3] for p, c in brute_partners(items, False).items()}
    assert dict(got) == want
    assert sizes == [5 * 4]


def test_wide_baskets_are_cut_into_cells(spark):
    """A basket of thousands of products: short arrays, and no pair that the bound rules out."""
    wide = [("w", f"p{i:04d}") for i in range(3000)]
    narrow = [(f"b{i}", f"p{j:04d}") for i in range(40) for j in (1, 2, 3, 4, 5, 6 + i)]
    frame = spark.createDataFrame(wide + narrow, "basket_id string, product_id string")
    got = defaultdict(list)
    for r in baskets.top_partners(frame, 3).orderBy("product_id", "rank").collect():
        got[r.product_id].append((r.partner_id, r.together))
    assert len(got) == 3000
    assert got["p0001"] == [("p0002", 41), ("p0003", 41), ("p0004", 41)]
    assert got["p0007"] == [("p0001", 2), ("p0002", 2), ("p0003", 2)]
    assert got["p2999"] == [("p0000", 1), ("p0001", 1), ("p0002", 1)]
    pairs = records(baskets.top_pairs(frame, 4))
    assert pairs == [("p0001", f"p000{j}", 41) for j in (2, 3, 4, 5)]

    members = frame.select("basket_id", "product_id", F.lit(1).alias("times"))
    listed = baskets._pairs(members, F.struct("product_id"), 128)
    assert listed.where("a.product_id < b.product_id").distinct().count() == 3000 * 2999 // 2


def test_cart_items_explode(spark):
    ddl = "cart_id long, items array<struct<product_id:string,quantity:int,price:double>>"
    carts = spark.createDataFrame([(1, [("p", 2, 3.0), ("q", 0, 4.0)]), (2, [])], ddl)
    flat = cart.cart_items(carts)
    assert flat.count() == 2
    assert records(cart.cart_totals(flat)) == [(1, 3, 10.0)]


def test_a_huge_price_stops_nothing(spark, make_events):
    rows = [{"event_type": "add_to_cart", "price": p, "session_id": f"s{i}"} for i, p in enumerate((2e8, 1e30, 5.0))]
    assert {r.value_range: r.sessions for r in cart.value_buckets(make_events(rows)).collect()} == {"Under $50": 1, "Over $200": 1}


def test_recovery_with_one_session_of_many_users(spark, make_events):
    rows = [{"event_type": "add_to_cart", "user_id": f"u{i % 20}", "session_id": "unknown", "price": float(i)} for i in range(60)]
    rows += [{"event_type": "add_to_cart", "user_id": "u1", "session_id": s, "price": 9.0} for s in ("a", "b", "c")]
    rows.append({"event_type": "purchase", "user_id": "u7", "session_id": "c"})
    got = {r.user_id: r.abandoned_carts for r in cart.recovery_opportunities(make_events(rows)).collect()}
    assert got == {"u1": 3}


def test_enriched_items_are_dealt_over_tasks_by_their_number(spark, tables, monkeypatch):
    """A task's share of the items is bounded, line items are read once, and the setting is put back."""
    key, planned, kept = "spark.sql.shuffle.partitions", [], cart.written
    before = spark.conf.get(key)
    carts, products = adapter.carts(spark, tables), adapter.products(spark, tables)
    want = Counter(cart.enriched_items(carts, products).collect())
    monkeypatch.setattr(cart, "written", lambda df, name: planned.append(int(spark.conf.get(key))) or kept(df, name))
    rows = adapter.cart_rows(spark, tables)
    assert Counter(cart.enriched_items(carts, products, rows).collect()) == want and planned == []
    monkeypatch.setattr(cart, "TASK", 500)
    assert Counter(cart.enriched_items(carts, products, rows).collect()) == want and sum(want.values()) == rows
    assert planned == [-(-rows // 500)] and spark.conf.get(key) == before
    plan = cart.enriched_items(carts, products)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # that of the products
