import random
from collections import Counter, defaultdict

import pytest

from clickloom.operators import journey
from clickloom.sources import adapter
from frames import at, records

KINDS = ["pageview", "pageview", "search", "add_to_cart", "remove_from_cart", "checkout", "purchase"]
PAGES = {"search": "/search", "add_to_cart": "/cart", "remove_from_cart": "/cart", "checkout": "/checkout", "purchase": "/checkout"}


def random_rows(n, sessions=12, seed=7, minutes=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choice(KINDS)
        page = PAGES.get(kind) or rng.choice(["/home", "/category?category=a", "/p/x?id=1", "/product/3"])
        path = page.split("?")[0] if kind == "pageview" else None
        # Session 0 is hot: it takes a third of all rows.
        session = 0 if rng.random() < 0.34 else rng.randrange(1, sessions)
        rows.append(
            {
                "session_id": f"s{session}",
                "event_type": kind,
                "page": page,
                "path": path,
                "ts": at(rng.randrange(minutes)),
                "product_id": str(rng.randrange(6)),
            }
        )
    return rows


def by_session(rows):
    out = defaultdict(list)
    for i, row in sorted(enumerate(rows), key=lambda x: (x[1]["ts"], x[0])):
        out[row["session_id"]].append(row)
    return out


def base(page):
    return "/product" if page.startswith(("/p/", "/product/")) else page.split("?")[0]


STEPS = [
    lambda r: base(r["page"]) == "/home",
    lambda r: base(r["page"]) in ("/category", "/search"),
    lambda r: base(r["page"]) == "/product",
    lambda r: r["event_type"] == "add_to_cart" or base(r["page"]) == "/cart",
    lambda r: r["event_type"] == "checkout" or base(r["page"]) == "/checkout",
    lambda r: r["event_type"] == "purchase",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_funnel_equals_exists(make_events, seed):
    rows = random_rows(150, sessions=30, seed=seed, minutes=40)
    want = []
    for i, step in enumerate(STEPS):
        reached = 0
        for events in by_session(rows).values():
            hit = any(
                step(e) and all(any(STEPS[j](p) and p["ts"] < e["ts"] for p in events) for j in range(i))
                for e in events
            )
            reached += hit
        want.append(reached)
    got = journey.ordered_funnel(make_events(rows)).orderBy("step_no").collect()
    assert [r.sessions for r in got] == want


def test_ordered_funnel_on_known_data(spark):
    counts = {}
    for sf in ("0.001", "0.01"):
        funnel = journey.ordered_funnel(adapter.all_events(spark, f"/root/testdata/sf{sf}"))
        counts[sf] = [r.sessions for r in funnel.orderBy("step_no").collect()]
    assert counts == {"0.001": [30, 21, 8, 10, 10, 8], "0.01": [324, 209, 120, 120, 138, 105]}


def test_funnels_on_empty_input(make_events):
    empty = make_events([{}]).limit(0)
    assert [r.sessions for r in journey.ordered_funnel(empty).collect()] == [0] * 6
    assert [r.events for r in journey.event_funnel(empty).collect()] == [0] * 4
    assert journey.session_funnel(empty).first().total_sessions == 0
    assert {r.conversion for r in journey.page_funnels(empty).collect()} == {0.0}


def test_shares_stay_below_one(make_events):
    events = make_events(random_rows(200))
    assert all(0 <= r.conversion <= 1 for r in journey.page_funnels(events).collect())


def test_full_paths_match_brute_force(make_events):
    rows = random_rows(60, sessions=40, seed=3) + [
        {"session_id": f"twin{i}", "event_type": kind, "ts": at(j)}
        for i in range(4)
        for j, kind in enumerate(["pageview", "add_to_cart", "purchase"])
    ]
    paths = Counter("->".join(e["event_type"] for e in events) for events in by_session(rows).values())
    for least in (1, 2, 4):
        got = dict(records(journey.event_paths(make_events(rows), least)))
        assert got == {p: n for p, n in paths.items() if n >= least}


def test_conversion_paths_carry_their_purchases(make_events):
    rows = [
        {"session_id": s, "event_type": kind, "path": path}
        for s in ("a", "b")
        for kind, path in (("pageview", "/home"), ("purchase", None))
    ]
    assert records(journey.conversion_paths(make_events(rows), 2)) == [("pageview:/home > purchase", 2, 2, 1.0)]


def test_common_paths_use_the_first_five_views(make_events):
    rows = [{"session_id": "s", "page": f"/{i}"} for i in range(8)] + [{"session_id": "s", "event_type": "purchase"}]
    assert records(journey.common_paths(make_events(rows))) == [("/0 -> /1 -> /2 -> /3 -> /4", 1, 1, 100.0)]


def test_row_limit_comes_before_the_shuffle(make_events):
    plan = journey.common_paths(make_events(random_rows(20)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_drop_off_matches_last_events(make_events):
    rows = random_rows(200, seed=5)
    seen = Counter((r["event_type"], r["path"]) for r in rows)
    ends = Counter((e[-1]["event_type"], e[-1]["path"]) for e in by_session(rows).values())
    got = {(r.event_type, r.path): (r.occurrences, r.dropoffs) for r in journey.drop_off(make_events(rows)).collect()}
    assert got == {k: (seen[k], n) for k, n in ends.items()}


def label(row):
    kind = row["event_type"]
    if kind in ("pageview", "search"):
        return row["path"] or "Page"
    return {"add_to_cart": "Add to Cart", "checkout": "Checkout", "purchase": "Purchase"}.get(kind, "Remove_From_Cart")


@pytest.mark.parametrize("minutes", [30, 600, 6000])
def test_transitions_match_one_ordered_scan(make_events, minutes):
    rows = random_rows(300, seed=minutes, minutes=minutes)
    stage = {"Add to Cart": 1, "Checkout": 2, "Purchase": 3}
    links = Counter()
    for events in by_session(rows).values():
        labels = [label(e) for e in events]
        links.update({(a, b) for a, b in zip(labels, labels[1:]) if stage.get(a, 0) < stage.get(b, 0)})
    got = {(r.source, r.target): r.value for r in journey.transition_links(make_events(rows), 1000).collect()}
    assert got == dict(links)
    nodes = {r.node for r in journey.transition_nodes(make_events(rows)).collect()}
    assert nodes == {n for pair in links for n in pair}


def test_length_and_entry(make_events):
    rows = [{"session_id": "a", "source": None}, {"session_id": "a", "source": "x", "event_type": "purchase"}]
    rows += [{"session_id": "b", "source": "x"}] * 6
    events = make_events(rows)
    assert {r.entry_channel: r.conversions for r in journey.entry_channels(events).collect()} == {None: 1, "x": 0}
    assert {r.journey_length: r.sessions for r in journey.length_impact(events).collect()} == {
        "Very Short (1-4)": 1,
        "Short (5-9)": 1,
    }
    stats = journey.path_length_stats(events).first()
    assert (stats.sessions, stats.max_length, stats.average_length) == (2, 6, 4.0)
