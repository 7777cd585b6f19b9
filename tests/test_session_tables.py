from clickloom.operators import session_tables as tables
from clickloom.operators import sessions
from frames import at, records


def cases(make_events):
    rows = [{"session_id": "hot", "user_id": f"u{i % 3}", "page": f"/p/{i % 700}", "ts": at(i)} for i in range(1500)]
    rows += [{"session_id": f"s{i % 20}", "user_id": "v", "page": f"/x{i % 7}", "ts": at(i % 90)} for i in range(300)]
    return make_events([*rows, {"session_id": "none", "page": None}])


def test_heads_and_pages_equal_the_rollup(make_events):
    events = cases(make_events)
    both = tables.heads(events).withColumn("estimate", tables.estimate()).join(tables.named_pages(tables.pages(events), 3), "session_id", "left")
    rolled = {r.session_id: r for r in sessions.rollup(events).collect()}
    found = both.collect()
    assert len(found) == len(rolled) == 22
    for r in found:
        whole = rolled[r.session_id]
        assert (r.user_id, r.first_event_at, r.last_event_at, r.event_count) == tuple(whole)[1:5]
        assert (r.n_pages or 0, r.first_pages or []) == (len(whole.pages), whole.pages[:3])
        assert abs(r.estimate - len(whole.pages)) <= 0.05 * len(whole.pages)


def test_merge_and_repair(spark, make_events):
    events = cases(make_events)
    halves = [events.where(f"event_id % 2 = {k}") for k in (0, 1)]
    merged = tables.merge_heads(tables.heads(halves[0]).unionByName(tables.heads(halves[1])))
    want = {r.session_id: (r.first_event_at, r.last_event_at, r.event_count) for r in tables.heads(events).collect()}
    got = {r.session_id: (r.first_event_at, r.last_event_at, r.event_count) for r in merged.collect()}
    assert got == want
    united = tables.merge_pages(tables.pages(halves[0]).unionByName(tables.pages(halves[1])))
    assert sorted(records(united)) == sorted(records(tables.pages(events)))

    empty = tables.heads(events).selectExpr(
        "session_id", "user_id", "first_event_at", "last_event_at", "if(session_id = 'hot', 0, event_count) AS event_count", "page_sketch"
    )
    lost = empty.where("session_id = 's1'").selectExpr(
        "'gone' AS session_id", "user_id", "first_event_at", "last_event_at", "CAST(0 AS long) AS event_count", "page_sketch"
    )
    kept = tables.pages(events).where("session_id <> 'hot'")
    repaired, page_rows = tables.repair(empty.unionByName(lost), kept, events)
    state = {r.session_id: (r.event_count, r.is_orphan) for r in repaired.collect()}
    assert state["hot"] == (1500, False) and state["gone"] == (0, True) and state["s1"] == (15, False)
    assert sorted(records(page_rows)) == sorted(records(tables.pages(events)))
    nothing = events.limit(0)
    assert tables.heads(nothing).count() == tables.merge_heads(tables.heads(nothing)).count() == tables.pages(nothing).count() == 0
