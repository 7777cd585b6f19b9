import random
from types import SimpleNamespace

import pandas as pd

from clickloom.streaming import events as stream
from clickloom.streaming import sessions
from frames import at
from test_streaming import message, send


def run(spark, tmp_path, **options):
    topic, table, state = (str(tmp_path / n) for n in ("topic", "table", "state"))
    query = sessions.run_session_job(stream.text_source(spark, topic, files_per_trigger=1), table, state, **options)
    query.awaitTermination()
    found = {r.session_id: tuple(r)[1:] for r in sessions.read_sessions(spark, table).collect()}
    pages = {}
    for r in sessions.read_session_pages(spark, table).collect():
        pages.setdefault(r.session_id, set()).add(r.page)
    return found, pages, query.recentProgress


def brute(sent):
    found, pages = {}, {}
    for i, minutes, session, user, page in sent:
        found.setdefault(session, []).append((at(minutes), str(i), user))
        pages.setdefault(session, set()).add(page)
    return {s: (max(e)[2], min(e)[0], max(e)[0], len(e)) for s, e in found.items()}, pages


def test_totals_pages_and_last_user_out_of_order(spark, tmp_path):
    """Three batches in no order, each message twice, a restart between the second and the third."""
    r = random.Random(4)
    sent = [(i, r.randrange(300), r.choice(["a", "a", "a", "b", "c"]), r.choice("uvw"), f"/p{r.randrange(9)}") for i in range(120)]
    lines = [message(i, m, session_id=s, user_id=u, page=p) for i, m, s, u, p in sent]
    for part in range(2):
        send(tmp_path / "topic", f"f{part}", lines[part * 40 : part * 40 + 40] * 2)
    assert run(spark, tmp_path, delay="10 hours")[:2] == brute(sent[:80])
    send(tmp_path / "topic", "f2", lines[80:] + lines[:10])
    assert run(spark, tmp_path, delay="10 hours")[:2] == brute(sent)
    assert run(spark, tmp_path, delay="10 hours")[:2] == brute(sent)


def test_state_ends_by_timer_and_the_table_goes_on(spark, tmp_path):
    """Late messages are left out; a session that returns after its state ended is added up."""
    batches = [
        [(1, 0, "s", "u", "/a"), (2, 3, "s", "v", "/b"), (3, 1, "t", "u", "/a")],
        [(4, 600, "t", "w", "/c")],
        [(5, 1, "s", "late", "/late"), (6, 700, "s", "x", "/a")],
        [(7, 2000, "end", "z", "/z")],
        [(8, 2001, "end", "z", "/z")],
    ]
    states = []
    for k, batch in enumerate(batches):
        send(tmp_path / "topic", f"f{k}", [message(i, m, session_id=s, user_id=u, page=p) for i, m, s, u, p in batch])
        found, pages, progress = run(spark, tmp_path, delay="10 minutes", gap_seconds=3600, parts=2)
        states.append([op.numRowsTotal for p in progress for op in p.stateOperators if "transformWithState" in op.operatorName][-1])
    want, want_pages = brute([row for batch in batches for row in batch if row[0] != 5])
    assert found == want and pages == want_pages
    assert states[-1] < states[0]


def test_job_leaves_the_state_store_setting_alone(spark, tmp_path):
    before = spark.conf.get(sessions.PROVIDER)
    send(tmp_path / "topic", "a", [message(1, 0)])
    run(spark, tmp_path)
    assert spark.conf.get(sessions.PROVIDER) == before


def test_a_page_is_asked_for_once_whatever_the_chunks():
    """Fifty chunks of the same pages: the state is asked once a page, the last user goes by time and id."""
    asked, kept = [], {}
    part = sessions.SessionPart(60)
    pages = SimpleNamespace(containsKey=lambda k: asked.append(k) or k in kept, updateValue=kept.__setitem__)
    totals = SimpleNamespace(exists=lambda: False, update=lambda row: None)
    handle = SimpleNamespace(
        getValueState=lambda *_: totals, getMapState=lambda *_: pages, listTimers=list, registerTimer=lambda ms: None
    )
    part.init(handle)
    chunks = [
        pd.DataFrame({"event_id": [f"e{c}", f"f{c}", f"g{c}"], "user_id": [f"u{c}", f"v{c}", f"w{c}"], "page": ["/a", "/b", None], "us": [100 - c, 7, 100 - c]})
        for c in range(50)
    ]
    (out,) = part.handleInputRows(("s", 0), iter(chunks), None)
    assert sorted(asked) == [("/a",), ("/b",)] and kept == {("/a",): (51,), ("/b",): (7,)}
    assert list(out["page"]) == [None, "/a", "/b"]
    assert set(out["last_user"]) == {"w0"} and set(out["event_count"]) == {150} and set(out["first_us"]) == {7}
