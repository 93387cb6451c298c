"""Stored rides, marts and the tracker: versions, compaction, refreshes of what changed, reads by key, replays."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from rideledger.operators import rides, totals
from rideledger.sources import versions
from rideledger.streaming import jobs, marts
from rideledger.streaming.tracker import Tracker
from tests.test_rides import changed, events
from tests.test_streams import same


def batch(spark, n, resorts=("1", "2", "3"), rows=40):
    made = [changed(ingest_seq=n * 1000 + i, resortID=resorts[i % len(resorts)], dayID=str(i % 3), skierID=str((i * 7 + n) % 11 + 1), liftID=i % 39 + 1, time=i % 9 + 1) for i in range(rows)]
    return events(spark, *made)


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_compaction_changes_no_result(spark, tmp_path):
    bronze, base, want = f"{tmp_path}/bronze", f"{tmp_path}/base", None
    for n in range(50):
        new = batch(spark, n, ("1", "2") if n % 5 else ("3",), 8)
        jobs.write_batch(new.coalesce(1), bronze, n)
        want = new if want is None else want.unionByName(new)
        if n % 10 == 9:
            before = marts.current_rides(spark, bronze, base)
            rows = sorted(map(tuple, before.collect()))
            at = marts.compact(spark, bronze, base)
            assert at.note == {"upto": n}
            versions.expire(spark, base, 1)
            assert sorted(map(tuple, marts.current_rides(spark, bronze, base).collect())) == rows
    assert same(marts.current_rides(spark, bronze, base), rides.current(want))
    held = files_of(tmp_path / "base")
    assert len(held) <= 3 + spark.sparkContext.defaultParallelism  # partitions and tasks, not batches
    at = versions.latest(spark, base)
    assert marts.compact(spark, bronze, base) == at and files_of(tmp_path / "base") == held  # nothing new
    jobs.write_batch(batch(spark, 50, ("2",)), bronze, 50)
    (tmp_path / "bronze" / "batch_id=51").mkdir()  # broken off: no mark
    assert marts.compact(spark, bronze, base).note == {"upto": 50}
    new = {f: t for f, t in files_of(tmp_path / "base").items() if f not in held}
    assert new and all("resortID=2/" in f for f in new)


def test_refresh_writes_what_changed_and_disturbs_no_reader(spark, tmp_path):
    bronze, base, gold = (f"{tmp_path}/{x}" for x in ("bronze", "base", "gold"))
    first = batch(spark, 0)
    jobs.write_batch(first, bronze, 0)
    marts.compact(spark, bronze, base)
    old = marts.refresh(spark, base, gold)
    reader = {name: marts.read_mart(spark, gold, name) for name in marts.MARTS}
    seen = {name: sorted(map(tuple, df.collect())) for name, df in reader.items()}
    held = files_of(tmp_path / "gold")
    second = batch(spark, 1, ("3", "4"))
    jobs.write_batch(second, bronze, 1)
    marts.compact(spark, bronze, base)
    assert marts.refresh(spark, base, gold).number == 2
    # The reader that began before sees the old version whole; a new one sees the new one.
    assert {name: sorted(map(tuple, df.collect())) for name, df in reader.items()} == seen
    assert {name: sorted(map(tuple, marts.read_mart(spark, gold, name, old).collect())) for name in marts.MARTS} == seen
    current = rides.current(first.unionByName(second))
    for name, build in {"day_vertical": totals.day_vertical, "resort_day_unique": totals.unique_skiers, "season_totals": totals.season_totals}.items():
        assert same(marts.read_mart(spark, gold, name), build(current))
    after = files_of(tmp_path / "gold")
    assert held.items() <= after.items()
    assert {re.search(r"resortID=(\w+)", f)[1] for f in after if f not in held} == {"3", "4"}
    assert marts.refresh(spark, base, gold).number == 2  # nothing changed
    versions.expire(spark, gold, 1)
    kept = files_of(tmp_path / "gold")
    assert len(kept) < len(after) and same(marts.read_mart(spark, gold, "day_vertical"), totals.day_vertical(current))


def test_requests_read_the_partitions_they_name(spark, tmp_path):
    bronze, base, gold = (f"{tmp_path}/{x}" for x in ("bronze", "base", "gold"))
    made = batch(spark, 0)
    jobs.write_batch(made, bronze, 0)
    marts.compact(spark, bronze, base)
    marts.refresh(spark, base, gold)
    asked = events(spark, *[changed(resortID=r, dayID=d, skierID=s) for r in ("1", "9", "a/b", None) for d in ("0", "7") for s in ("1", "99", None)])
    asked = asked.select("resortID", "seasonID", "dayID", "skierID").withColumn("extra", F.lit(1))
    current = rides.current(made)
    want = totals.lookup(totals.lookup(asked, totals.day_vertical(current), ["resortID", "seasonID", "dayID", "skierID"], "totalVertical"), totals.unique_skiers(current), ["resortID", "seasonID", "dayID"], "uniqueNumSkiers")
    found = marts.answers(spark, gold, asked)
    assert same(found, want) and found.count() == asked.count()
    assert {re.search(r"resortID=(\w+)", f)[1] for f in found.inputFiles() if "resortID=" in f} == {"1"}


def test_marts_follow_a_stream(spark, tmp_path):
    """Records land, and base and marts follow; rejected ones stay out; old versions go."""
    source, work = f"{tmp_path}/in", f"{tmp_path}/w"
    first, second = batch(spark, 0), batch(spark, 1, ("2", "11"))
    first.coalesce(1).write.json(source)
    query = marts.follow(spark, source, work, "1 second")
    try:
        query.processAllAvailable()
        assert same(marts.read_mart(spark, f"{work}/gold", "day_vertical"), totals.day_vertical(rides.current(first)))
        second.coalesce(1).write.mode("append").json(source)
        query.processAllAvailable()
        first.where("ingest_seq = 3").withColumn("ingest_seq", F.lit(9999).cast("long")).withColumn("liftID", F.lit(40)).coalesce(1).write.mode("append").json(source)
        query.processAllAvailable()
    finally:
        query.stop()
    every = first.unionByName(second).unionByName(first.where("ingest_seq = 3").withColumns({"ingest_seq": F.lit(9999).cast("long"), "liftID": F.lit(40)}))
    current = rides.current(rides.valid(every))
    assert same(marts.read_mart(spark, f"{work}/gold", "day_vertical"), totals.day_vertical(current))
    assert same(marts.current_rides(spark, f"{work}/landed", f"{work}/base"), current)
    assert jobs.quarantine(spark, work).count() == second.where("resortID = '11'").count() > 0
    assert len(list((tmp_path / "w" / "gold" / "versions").glob("0*.json"))) == 2


def test_half_written_version_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert versions.latest(spark, root).number == 0
    frame = spark.createDataFrame([("a", "1")], "v string, p string")
    one = versions.publish(spark, root, versions.Version(), {"t": frame}, ["p"], {"p=1"}, {})
    (tmp_path / "t" / "versions" / ".load=v1").write_text("{")  # a writer that died
    frame.write.partitionBy("p").parquet(f"{root}/data/t/load=vdead")
    assert versions.latest(spark, root) == one
    read = lambda at: sorted(map(tuple, versions.read(spark, root, at, "t", "v string, p string").collect()))
    assert read(one) == [("a", "1")]
    with pytest.raises(RuntimeError, match="another job"):
        versions.publish(spark, root, versions.Version(), {"t": frame}, ["p"], {"p=1"}, {})
    with pytest.raises(ValueError, match="replace"):
        versions.publish(spark, root, one, {"t": frame}, ["p"], {"p=2"}, {})
    with pytest.raises(ValueError, match="partition"):
        versions.partition(["p"], ("a/b",))
    odd = spark.createDataFrame([("b", "007"), ("c", "+5")], "v string, p string")
    two = versions.publish(spark, root, one, {"t": odd}, ["p"], {"p=1", "p=007", "p=+5"}, {})
    assert read(two) == [("b", "007"), ("c", "+5")] and read(one) == [("a", "1")]
    three = versions.publish(spark, root, two, {"t": odd.where("false")}, ["p"], {"p=007"}, {})
    assert read(three) == [("c", "+5")]


def test_read_by_key_is_pushed_down(spark, tmp_path):
    bronze, base, gold = (f"{tmp_path}/{x}" for x in ("bronze", "base", "gold"))
    made = spark.range(20_000).select(
        F.col("id").alias("ingest_seq"), F.lit("1").alias("resortID"), F.lit("2025").alias("seasonID"), F.lit("1").alias("dayID"),
        (F.col("id") % 5000 + 1).cast("string").alias("skierID"), F.lit(3).alias("liftID"), (F.col("id") % 7 + 1).cast("int").alias("time"),
    )
    jobs.write_batch(made, bronze, 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were rows for several tasks
    try:
        marts.compact(spark, bronze, base)
        marts.refresh(spark, base, gold)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = marts.skier_days(spark, gold, "1", "2025", "777")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in totals.day_vertical(rides.current(made)).where("skierID = '777'").collect()]
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*seasonID.*= 2025.*resortID.*= 1", text) and "EqualTo(skierID,777)" in text
    # Files are ranges of persons: one can have this one.
    parts = marts.read_mart(spark, gold, "day_vertical").groupBy(F.input_file_name().alias("f")).agg(F.min("skierID").alias("low"), F.max("skierID").alias("high")).collect()
    assert len(parts) > 1 and sum(p.low <= "777" <= p.high for p in parts) == 1
    assert marts.skier_days(spark, gold, "9", "2025", "777").count() == 0


def test_tracker_counts_once(spark, tmp_path):
    folder = f"{tmp_path}/tracker"
    tracker = Tracker(spark, folder, "tracker_test", 4)
    parts = [batch(spark, n) for n in range(3)]
    for n in (0, 0, 1, 0, 2, 2):
        tracker.add(parts[n], n)
    want = totals.unique_skiers(rides.current(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert same(tracker.counts(), want)
    # Broken off between keys and counts: the batch is sent again and counts the same.
    import shutil

    shutil.rmtree(f"{folder}/counts/batch_id=2")
    tracker.add(parts[2], 2)
    assert same(tracker.counts(), want)
    # Another session's catalog has another name for the same folder.
    again = Tracker(spark, folder, "tracker_again", 4)
    assert again.done() == {0, 1, 2}
    again.add(parts[1].withColumn("skierID", F.lit("77777")), 3)
    assert again.counts().groupBy().sum("uniqueNumSkiers").first()[0] == want.groupBy().sum("uniqueNumSkiers").first()[0] + parts[1].select("resortID", "dayID").distinct().count()
    text = plan(again.new_keys(parts[0], 9))
    assert len(re.findall(r"\n\(\d+\) Exchange\n", text)) == 1 and "Bucketed: true" in text and "BroadcastExchange" not in text
    for name in ("tracker_test", "tracker_again"):
        spark.sql(f"DROP TABLE {name}")
