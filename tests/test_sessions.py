import random
from datetime import timedelta

from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import cleaning, sessions
from clickloom.sources import adapter
from frames import DAY, at, records


def test_sessionize_matches_a_scan_in_time_order(spark, make_events):
    random.seed(1)
    rows = [
        {"user_id": random.choice(["a", "a", "a", "b", "c"]), "ts": DAY + timedelta(seconds=random.randint(-90_000, 900_000))}
        for _ in range(400)
    ]
    rows += [{"user_id": "edge", "ts": at(m)} for m in (0, 60, 120, 181)]
    gap = 3_600
    events = make_events(rows)
    got = dict(records(sessions.sessionize(events.drop("session_id"), gap).select("event_id", "session_id")))
    want, last, number = {}, {}, {}
    for i, row in sorted(enumerate(rows), key=lambda x: (x[1]["ts"], x[0])):
        user = row["user_id"]
        if user in last and (row["ts"] - last[user]).total_seconds() > gap:
            number[user] += 1
        number.setdefault(user, 0)
        last[user] = row["ts"]
        want[i] = f"{user}-{number[user]}"
    assert got == want


def test_sessionize_never_sorts_the_events(spark, tables):
    plan = adapter.all_events(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "page" not in window.split("Relation")[0]


def test_rollup_and_empty_input(spark, make_events):
    events = make_events(
        [
            {"ts": at(5), "user_id": "late", "page": "/b"},
            {"ts": at(1), "user_id": "early", "page": "/a"},
            {"ts": at(3), "user_id": "mid", "page": "/a"},
        ]
    )
    row = sessions.rollup(events).first()
    assert (row.user_id, row.event_count, row.pages) == ("late", 3, ["/a", "/b"])
    assert (row.first_event_at, row.last_event_at) == (at(1), at(5))
    assert sessions.rollup(events.limit(0)).count() == 0


def test_merge_duplicates_keeps_the_user_of_the_largest_row(spark):
    rows = [
        ("s", "small", at(0), at(1), 1, ["/a"]),
        ("s", "big_late", at(3), at(9), 5, ["/b"]),
        ("s", "big_early", at(2), at(4), 5, ["/a", "/c"]),
        ("t", "x", at(0), at(0), 1, []),
    ]
    merged = sessions.merge_duplicates(spark.createDataFrame(rows, schema.SESSIONS)).orderBy("session_id")
    assert records(merged) == [
        ("s", "big_early", at(0), at(9), 11, ["/a", "/b", "/c"], 3),
        ("t", "x", at(0), at(0), 1, [], 1),
    ]


def test_repair_and_audit(spark, make_events):
    events = make_events(
        [{"session_id": "full"}, {"session_id": "full"}, {"session_id": "empty"}, {"session_id": "unstored", "user_id": None}]
    )
    rows = [
        ("full", "other", at(0), at(1), 5, ["/home"]),
        ("empty", "u1", None, None, 0, []),
        ("orphan", "u1", None, None, None, None),
    ]
    stored = spark.createDataFrame(rows, schema.SESSIONS)
    fixed = {r.session_id: r for r in sessions.repair_empty(stored, events).collect()}
    assert (fixed["empty"].event_count, fixed["empty"].pages, fixed["empty"].is_orphan) == (1, ["/home"], False)
    assert fixed["full"].event_count == 5 and fixed["orphan"].is_orphan
    checks = dict(records(sessions.audit(stored, events)))
    assert checks == {
        "sessions": 3, "empty_pages": 2, "zero_events": 2, "orphan_sessions": 1, "sessions_missing": 1,
        "orphan_events": 1, "count_mismatch": 2, "user_mismatch": 1,
    }
    assert set(dict(records(sessions.audit(stored.limit(0), events.limit(0)))).values()) == {0}


def test_recent_and_user_sessions(spark, make_events):
    events = make_events(
        [{"session_id": "a", "user_id": "Ann"}, {"session_id": "b", "user_id": "bob"}, {"session_id": "a", "user_id": "bob"}]
    )
    assert [r.session_id for r in sessions.recent(events).collect()] == ["a", "b"]
    assert [r.session_id for r in sessions.recent(events, user_contains="AN").collect()] == ["a"]
    assert sessions.of_users(events, "bob").count() == 2


def test_validation_names_the_first_broken_rule(spark):
    ok = dict(user_id="u", session_id="s", event_type="search", page="/x", timestamp="5", properties={})
    cases = [
        (ok, None),
        ({**ok, "user_id": None, "page": "x"}, "missing user_id"),
        ({**ok, "properties": None}, "missing properties"),
        ({**ok, "timestamp": "abc"}, "bad type timestamp"),
        ({**ok, "event_type": "view"}, "bad event_type"),
        ({**ok, "timestamp": "0"}, "bad timestamp"),
        ({**ok, "page": "home"}, "bad page"),
    ]
    ddl = "i int, user_id string, session_id string, event_type string, page string, timestamp string, properties map<string,string>"
    rows = [(i, *[c[0][k] for k in ("user_id", "session_id", "event_type", "page", "timestamp", "properties")]) for i, c in enumerate(cases)]
    checked = cleaning.validate(spark.createDataFrame(rows, ddl))
    got = dict(records(checked.select("i", "reject_reason")))
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    assert cleaning.valid(checked).count() == 1 and cleaning.rejected(checked).count() == len(cases) - 1


def test_browse_pages_through_the_catalogue(spark, tables):
    products = adapter.products(spark, tables)
    everything = cleaning.browse(products, search="ring", sort="price", n=1000)
    total = everything.count()
    page = cleaning.browse(products, search="RING", sort="price", offset=3, n=4).collect()
    assert [r.product_id for r in page] == [r.product_id for r in everything.collect()][3:7]
    assert {r.total for r in page} == {total}
    assert cleaning.browse(products, tags=["no such tag"]).count() == 0


def test_enrichment_keeps_every_event(spark, make_events):
    events = make_events([{"product_id": "1"}, {"product_id": None}, {"product_id": "9", "user_id": "ghost"}])
    products = spark.createDataFrame([("1", "shoe", "c", 2.0, ["t"])], schema.PRODUCTS)
    users = spark.createDataFrame([("u1", "ann", DAY)], schema.USERS)
    rich = cleaning.enrich(events, products, users).orderBy("event_id").collect()
    assert [r.product_details and r.product_details.name for r in rich] == ["shoe", None, None]
    assert [r.user_details and r.user_details.username for r in rich] == ["ann", "ann", None]


def test_canonical_ids(spark):
    df = spark.createDataFrame([("A" * 24,), ("x",)], "ref string")
    assert records(cleaning.canonical_ids(df, "ref").orderBy(F.desc("ref"))) == [("a" * 24,), (None,)]


def test_events_without_a_user_share_the_unknown_visits(spark, make_events):
    rows = [{"user_id": None, "ts": at(m)} for m in (0, 10, 5000)] + [{"user_id": "u", "ts": at(0)}, {"user_id": "v", "ts": None}]
    got = sessions.sessionize(make_events(rows).drop("session_id")).groupBy("session_id").count()
    assert sorted(records(got)) == [("u-0", 1), ("unknown-0", 2), ("unknown-1", 1)]


def test_enrichment_uses_a_repeated_product_once(spark, make_events):
    products = spark.createDataFrame([("1", "a", "c", 1.0, []), ("1", "b", "c", 2.0, [])], schema.PRODUCTS)
    users = spark.createDataFrame([("u1", "ann", DAY), ("u1", "ann", DAY)], schema.USERS)
    got = cleaning.enrich(make_events([{"product_id": "1"}, {"product_id": "2"}]), products, users)
    assert sorted(records(got.select("product_id", "product_details.name", "user_details.username"))) == [
        ("1", "b", "ann"), ("2", None, "ann"),
    ]


def test_summary_samples_pages_of_a_huge_session(spark, make_events):
    rows = [{"session_id": "unknown", "page": f"/p/{i % 400:03d}"} for i in range(800)] + [{"session_id": "a", "page": None}]
    got = {r.session_id: (r.event_count, r.sample_pages) for r in sessions.summary(make_events(rows)).collect()}
    assert got == {"unknown": (800, [f"/p/{i:03d}" for i in range(10)]), "a": (1, [])}
    assert sessions.session_pages(make_events(rows)).count() == 401
