import json

import pytest
from pyspark.errors import AnalysisException

from clickloom import schema
from clickloom.operators import activity
from clickloom.streaming import events as stream
from frames import DAY, at, records


def message(i, minutes, kind="pageview", page="/home", **more):
    event = {
        "event_id": i, "session_id": "s", "user_id": "u", "page": page, "event_type": kind,
        "properties": {"product_id": "1"}, "timestamp": at(minutes).timestamp(), **more,
    }
    return json.dumps({"event": event, "metadata": {}})


def send(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp_path):
    topic, table, state = (str(tmp_path / n) for n in ("topic", "table", "state"))
    stream.run_minute_job(stream.text_source(spark, topic), table, state).awaitTermination()
    rows = stream.read_minutes(spark, table).orderBy("window_start", "page").collect()
    return [(r.window_start, r.page, r["count"]) for r in rows]


def test_decode_and_reject(spark):
    lines = [(message(1, 0),), ("{broken",), ('{"metadata": {}}',), (message(2, 0, kind="view"),), (message(3, 0, page="x"),)]
    decoded = stream.decode(spark.createDataFrame(lines, "value string"))
    reasons = [r.reject_reason for r in stream.checked(decoded).collect()]
    assert reasons == [None, "missing user_id", "missing user_id", "bad event_type", "bad page"]
    assert {r.raw for r in stream.refused(decoded).collect()} == {lines[i][0] for i in (1, 2, 3, 4)}


def test_late_repeated_and_restarted(spark, tmp_path):
    topic = tmp_path / "topic"
    send(topic, "a", [message(1, 0), message(2, 0.5), message(2, 0.5), message(3, 60), "{broken"])
    first = run(spark, tmp_path)
    assert first == [(at(0), "/home", 2), (at(60), "/home", 1)]
    assert run(spark, tmp_path) == first
    # Event 4 is older than the watermark; 3 comes again; 5 extends a minute.
    send(topic, "b", [message(4, 1), message(3, 60), message(5, 60.5)])
    assert run(spark, tmp_path) == [(at(0), "/home", 2), (at(60), "/home", 2)]


def test_stream_equals_batch(spark, make_events, tmp_path):
    minutes = [(i * 37) % 9 for i in range(50)]
    topic = tmp_path / "topic"
    for part in range(2):
        send(topic, f"f{part}", [message(i, m) for i, m in enumerate(minutes) if i % 2 == part])
    batch = activity.minute_counts(make_events([{"ts": at(m)} for m in minutes])).orderBy("window_start")
    assert run(spark, tmp_path) == [(r.window_start, r.page, r["count"]) for r in batch.collect()]


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    table = str(tmp_path / "t")
    for batch, n in ((0, 1), (1, 5), (1, 5)):
        frame = spark.createDataFrame([("k", n)], "key string, count long")
        frame.write.mode("overwrite").parquet(f"{table}/batch_id={batch}")
    assert records(stream.read_upserts(spark, table, ["key"], ["count"])) == [("k", 5)]
    stream.compact_upserts(spark, table, str(tmp_path / "c"), ["key"], ["count"])
    assert records(stream.read_upserts(spark, str(tmp_path / "c"), ["key"], ["count"])) == [("k", 5)]


def test_enrichment_and_visits(spark, tmp_path):
    topic = tmp_path / "topic"
    send(topic, "a", [message(1, 0), message(2, 5), message(3, 300, user_id="v", properties={})])
    products = spark.createDataFrame([("1", "shoe", "c", 1.0, [])], schema.PRODUCTS)
    users = spark.createDataFrame([("u", "ann", DAY)], schema.USERS)

    def accepted():
        return stream.accepted(stream.decode(stream.text_source(spark, str(topic))))

    rich = stream.enrich(accepted(), products, users).select("event_id", "product_details.name", "user_details.username")
    query = rich.writeStream.format("memory").queryName("rich").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "s1")).start().awaitTermination()
    assert sorted(records(spark.table("rich"))) == [("1", "shoe", "ann"), ("2", "shoe", "ann"), ("3", None, None)]

    visits = stream.session_state(accepted(), "30 minutes", delay=None)
    query = visits.writeStream.format("memory").queryName("visits").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "s2")).start().awaitTermination()
    assert records(spark.table("visits").select("user_id", "event_count")) == [("u", 2)]


def test_kafka_source_names_its_connector(spark):
    """The connector is not on the local classpath, so Spark must ask for that one."""
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        stream.kafka_source(spark, "localhost:1", "events", per_trigger=10)


def test_ids_of_every_shape_count_once(spark, tmp_path):
    """No id, an object id, a text id, a number; each message twice."""
    lines = [message(None, i / 100) for i in range(5)]
    lines += [message(None, i / 100, _id=f"{i:024x}") for i in range(10, 15)]
    lines += [message(f"{i:024X}", i / 100) for i in range(20, 25)]
    lines += [message(i, i / 100) for i in range(30, 35)]
    lines += [message("", 0.36, _id={"$oid": "f" * 24}), message("  ", 0.37)]
    send(tmp_path / "topic", "a", lines + lines)
    assert run(spark, tmp_path) == [(at(0), "/home", 22)]


def test_unusable_times_are_refused(spark):
    lines = [(message(1, 0),), (message(2, 0).replace(str(at(0).timestamp()), "1e17"),), (message(3, 0).replace(str(at(0).timestamp()), "-5"),)]
    decoded = stream.decode(spark.createDataFrame(lines, "value string"))
    assert [r.reject_reason for r in stream.checked(decoded).collect()] == [None, "bad timestamp", "bad timestamp"]
    assert stream.refused(decoded).count() == 2


def test_session_totals_come_back_after_the_watermark(spark, tmp_path):
    """Spans of a session end with the watermark; the table adds them up."""
    topic, table, state = (str(tmp_path / n) for n in ("topic", "table", "state"))
    for part, minutes in enumerate(([0, 5], [3000], [6000, 6001])):
        send(tmp_path / "topic", f"f{part}", [message(f"{part}-{m}", m) for m in minutes])
        totals = stream.session_totals(stream.accepted(stream.decode(stream.text_source(spark, topic))))
        stream.upsert_sink(totals, table, state).awaitTermination()
    assert records(stream.read_sessions(spark, table)) == [("s", at(0), at(6001), 5)]
