from datetime import timedelta
from pathlib import Path

from clickloom.operators import activity
from clickloom.streaming import events as stream
from clickloom.streaming import upserts
from frames import DAY, at
from test_streaming import message, send


def run(spark, tmp_path, files=None):
    topic, table, state = (str(tmp_path / n) for n in ("topic", "table", "state"))
    upserts.run_daily_minutes(stream.text_source(spark, topic, files), table, state).awaitTermination()
    return table


def counts(frame):
    return sorted((r.window_start, r.page, r["count"]) for r in frame.collect())


def folders(table):
    return sorted(str(p.relative_to(table)) for p in Path(table).glob("*/day=*/batch_id=*"))


def test_days_close_and_reads_open_their_days_only(spark, tmp_path):
    topic = tmp_path / "topic"
    send(topic, "a", [message(i, m) for i, m in enumerate((0, 0.5, 30, 1440, 1441))])
    table = run(spark, tmp_path)
    assert [f.split("/batch")[0] for f in folders(table)] == ["live/day=2024-01-01", "live/day=2024-01-02"]
    send(topic, "b", [message(i, m) for i, m in ((10, 1441.5), (11, 3 * 1440), (12, 3 * 1440 + 5))])
    run(spark, tmp_path)
    send(topic, "c", [message(20, 3 * 1440 + 5.5), message(21, 4 * 1440)])
    run(spark, tmp_path)
    want = [(at(0), "/home", 2), (at(30), "/home", 1), (at(1440), "/home", 1), (at(1441), "/home", 2)]
    want += [(at(3 * 1440), "/home", 1), (at(3 * 1440 + 5), "/home", 2), (at(4 * 1440), "/home", 1)]
    assert counts(upserts.read_daily_minutes(spark, table)) == want
    names = [f.split("/batch")[0] for f in folders(table)]
    assert names.count("closed/day=2024-01-01") == names.count("closed/day=2024-01-02") == 1
    assert not any(n.startswith("live/day=2024-01-0") and n[-1] in "12" for n in names)

    # Files of other days may hold anything: the last hour's reader does not open them.
    for file in Path(table).glob("*/day=*/batch_id=*/*.parquet"):
        if "day=2024-01-05" not in str(file):
            file.write_bytes(b"not parquet")
            Path(file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    now = DAY + timedelta(days=4, hours=1)
    recent = upserts.read_daily_minutes(spark, table, now - timedelta(hours=1), now)
    totals = {(r.kind, r.bucket): r.events for r in activity.minute_totals(recent, now).collect()}
    assert totals == {("minute", "2024-01-05 00:00"): 1, ("page", "/home"): 1, ("event_type", "pageview"): 1}


def test_repeated_batches_and_broken_off_closing(spark, tmp_path):
    table, keys = str(tmp_path / "t"), ["window_start", "page"]
    schema = "window_start timestamp, page string, count long"

    def write(batch_id, rows):
        frame = spark.createDataFrame(rows, schema).selectExpr("*", "to_date(window_start) AS day", f"{batch_id}L AS batch_id")
        upserts.Folders(spark, table)
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{table}/live")

    def now():
        kind = spark.createDataFrame([], schema).schema
        return sorted(tuple(r) for r in upserts.read_daily(spark, table, kind, keys, "window_start").collect())

    kind = spark.createDataFrame([], schema).schema
    for batch_id, rows in ((0, [(at(0), "a", 1), (at(1500), "a", 7)]), (1, [(at(0), "a", 3), (at(5), "b", 1)]), (1, [(at(0), "a", 3), (at(5), "b", 1)])):
        write(batch_id, rows)
    want = [(at(0), "a", 3), (at(5), "b", 1), (at(1500), "a", 7)]
    assert now() == want
    # The closed rows are there, but the folders they came from still are, too.
    late = upserts.Folders.remove
    upserts.Folders.remove = lambda *a: None
    try:
        upserts.close_days(spark, table, kind, keys, at(1440).date())
    finally:
        upserts.Folders.remove = late
    assert now() == want and len(folders(table)) == 4
    assert upserts.close_days(spark, table, kind, keys, at(1440).date()) == [at(0).date()]
    assert now() == want and len(folders(table)) == 2
    assert upserts.close_days(spark, table, kind, keys, at(1440).date()) == []
    # A row for a closed day opens it again.
    write(2, [(at(5), "b", 4)])
    want[1] = (at(5), "b", 4)
    assert now() == want
    assert upserts.close_days(spark, table, kind, keys, at(1440).date()) == [at(0).date()]
    assert now() == want and len(folders(table)) == 2
