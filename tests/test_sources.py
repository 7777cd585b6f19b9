from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.sources import adapter, lake, watermarks
from clickloom.sources import events as source
from clickloom.session import shared_dir
from frames import DAY, at, records


def test_lake_prunes_folders_and_honours_the_hour(spark, make_events, tmp_path):
    rows = [{"ts": DAY + timedelta(hours=h)} for h in range(72)] + [{"ts": datetime(2023, 12, 31, 23, 59)}]
    events = make_events(rows).select("event_id", "ts")
    path = str(tmp_path / "lake")
    lake.write_lake(lake.with_partitions(events), path, "overwrite")
    part = lake.read_lake(spark, path, DAY + timedelta(hours=20), DAY + timedelta(hours=50), ["event_id"])
    assert sorted(r[0] for r in part.collect()) == list(range(20, 50))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    across = lake.read_lake(spark, path, datetime(2023, 12, 31, 23), DAY + timedelta(hours=1))
    assert across.count() == 2


def test_export_takes_partitions_from_event_time(spark, make_events, tmp_path):
    path = str(tmp_path / "export")
    lake.export_recent(make_events([{"ts": at(m)} for m in (0, 59, 60, 119, 120)]).select("event_id", "ts"), path, at(120), 1)
    assert {(r.hour, r.event_id) for r in spark.read.parquet(path).collect()} == {(1, 2), (1, 3)}
    lake.export_recent(make_events([{"ts": at(121)}]).select("event_id", "ts"), path, at(180), 1)
    assert spark.read.parquet(path).count() == 3
    lake.compact(spark, path, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 3


def test_one_hot_partition_is_not_one_file(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        hot = spark.range(60_000).select("id", F.lit(DAY).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        lake.write_lake(lake.with_partitions(hot), str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(str(tmp_path / "hot")).select(F.input_file_name()).distinct().count()
    assert files > 1


def test_watermarks_move_forward_only(spark, make_events, tmp_path):
    path = str(tmp_path / "marks")
    events = make_events([{"ts": at(m)} for m in range(6)])
    assert watermarks.unprocessed(events, watermarks.read_watermarks(spark, path), "seo").count() == 6
    watermarks.advance(events.where(F.col("ts") <= F.lit(at(2))), path, "seo")
    marks = watermarks.read_watermarks(spark, path)
    assert watermarks.unprocessed(events, marks, "seo").count() == 3
    assert watermarks.unprocessed(events, marks, "cart").count() == 6
    watermarks.advance(events.where(F.col("ts") <= F.lit(at(1))), path, "seo")
    watermarks.advance(events.limit(0), path, "seo")
    assert records(watermarks.read_watermarks(spark, path)) == [("seo", at(2))]


def test_prepare_sets_defaults(spark):
    ddl = "event_id long, user_id string, session_id string, timestamp string, page string, event_type string, properties map<string,string>, noisy boolean"
    raw = spark.createDataFrame(
        [
            (1, None, "", "1704067200000", " /product/5?x=1", None, {"price": "1,000.5", "quantity": "x", "product_ids": '["a","b"]'}, None),
            (2, "u", "s", "never", "/home", "page_view", None, False),
        ],
        ddl,
    )
    first, second = source.prepare(raw).orderBy("event_id").collect()
    assert (first.user_id, first.session_id, first.ts, first.page) == ("unknown", "unknown", DAY, "/product/5")
    assert (first.event_type, first.price, first.quantity, first.product_ids) == ("pageview", 1000.5, None, ["a", "b"])
    assert (second.ts, second.event_type, second.price) == (None, "pageview", None)


def test_filters(spark, make_events):
    events = make_events(
        [{"user_id": "1", "referrer": "Google.com"}, {"user_id": "2", "ts": at(50)}, {"user_id": "2", "event_type": "search", "noisy": True}]
    )
    users = spark.createDataFrame([("ann", "1", "user"), ("root", "9", "admin")], "username string, user_id string, role string")
    segments = spark.createDataFrame([("2", "gold"), ("2", "gold"), ("1", "tin")], "user_id string, segment string")

    def ids(**kw):
        return sorted(r.event_id for r in source.filter_events(events, **kw).collect())

    assert ids(user="ann", users=users) == [0]
    assert ids(user="root", users=users) == [0, 1, 2]
    assert ids(user="nobody", users=users) == []
    assert ids(channel="google") == [0] and ids(channel="all") == [0, 1, 2]
    assert ids(segment="gold", user_segments=segments) == [1, 2]
    assert ids(date_from=at(2), date_to=at(50)) == [1, 2]
    assert ids(event_types=["search"]) == [2]
    assert [r.event_id for r in source.load_events(events, limit=1, columns=["event_id"]).collect()] == [0]
    assert source.load_events(events).count() == 2
    assert [r.event_id for r in source.latest_events(events, user="2").collect()] == [1, 2]


def test_scan_reads_only_what_is_needed(spark, tables):
    plan = adapter.unsessioned(spark, tables).select("user_id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_results_record_a_failing_table(spark, tmp_path):
    good = spark.range(3)
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    errors = lake.write_results({"bad": bad, "good": good}, str(tmp_path))
    assert set(errors) == {"bad"} and spark.read.json(f"{tmp_path}/good").count() == 3
    assert source.read_csv(spark, _csv(good, tmp_path), "id long").count() == 3


def _csv(df, tmp_path):
    df.write.csv(f"{tmp_path}/csv", header=True)
    return f"{tmp_path}/csv"


class SharedFolder:
    """A session whose cluster names a checkpoint folder (the setting is fixed at start)."""

    def __init__(self, spark, folder):
        self.sparkContext = spark.sparkContext
        self.conf = self
        self.folder = folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_dir_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SharedFolder(spark, None), "x")


def test_shared_dir_follows_the_session(spark, tmp_path):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert shared_dir(SharedFolder(spark, f"{tmp_path}/"), "x").startswith(f"{tmp_path}/x-")


def test_events_without_a_usable_time_are_counted(spark):
    rows = [("1704067200",), ("1e17",), ("-1e300",), ("NaN",), ("soon",), (" ",), (None,), ("2024-01-01T00:00:00Z",), ("99999999999999999999",)]
    raw = spark.createDataFrame(rows, "timestamp string")
    assert dict(records(source.time_faults(raw))) == {"placed": 2, "out of range": 4, "unreadable": 1, "no time": 2}
    assert source.time_faults(raw.limit(0)).count() == 0


def test_small_files_are_packed_to_a_byte_target(spark, tmp_path):
    path, days = str(tmp_path / "lake"), ["day", "kind"]
    rows = spark.range(6000).selectExpr("id", "id % 3 AS day", "if(id % 2 = 0, 'a b', 'ü') AS kind", "sha2(cast(id AS string), 256) AS text")
    rows.where("day < 2").repartition(5).write.partitionBy(*days).parquet(path)
    rows.where("day = 2").repartition(1).write.mode("append").partitionBy(*days).parquet(path)
    want = sorted(records(spark.read.parquet(path).select("id", "day", "kind", "text")))
    kept = {str(p.relative_to(path)) for p in (tmp_path / "lake" / "day=2").rglob("*.parquet")}
    before = {(r.day, r.kind): (r.files, r.bytes) for r in lake.census(spark, path, days).collect()}
    assert before[0, "ü"][0] == 5 and before[2, "a b"][0] == 1
    target = before[0, "ü"][1] // 2 + 1  # two files are enough
    assert lake.pack_small_files(spark, path, target, days) == 4
    after = {(r.day, r.kind): r.files for r in lake.census(spark, path, days).collect()}
    assert {after[d, k] for d in (0, 1) for k in ("a b", "ü")} <= {1, 2} and after[2, "ü"] == 1
    assert sorted(records(spark.read.parquet(path).select("id", "day", "kind", "text"))) == want
    assert {str(p.relative_to(path)) for p in (tmp_path / "lake" / "day=2").rglob("*.parquet")} == kept
    assert lake.pack_small_files(spark, path, target, days) == 0
    assert not [p for p in (tmp_path / "lake").iterdir() if p.name.startswith(".packing")]
