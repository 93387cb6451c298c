"""Streams give what the batch gives, however files are ordered, repeated or broken."""

import pytest
from pyspark.sql import functions as F

from rideledger.operators import rides, totals
from rideledger.rules import ANY_SEASON, UNREADABLE
from rideledger.schemas import RESORT_DAY
from rideledger.sources import files, versions
from rideledger.streaming import jobs, running
from tests.test_rides import changed, events


@pytest.fixture
def raw(spark):
    rows = [changed(ingest_seq=i, dayID=str(i % 2), skierID=str(i % 4), liftID=i % 43, time=i % 5 + 1) for i in range(60)]
    return events(spark, *rows)


def same(a, b):
    return sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.fixture
def source(raw, tmp_path):
    """Three files of rides, some of which come late and some again, and one of other things."""
    for part in (raw.where("ingest_seq >= 30"), raw.where("ingest_seq < 40"), raw.where("ingest_seq % 7 = 0")):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    (tmp_path / "in" / "broken.json").write_text('not json\n{"ingest_seq":7,"resortID":"1"\n\n{"liftID":"x"}\n')
    return f"{tmp_path}/in"


def test_streams_equal_batch(spark, raw, source, tmp_path):
    want = rides.current(rides.valid(raw))
    assert same(jobs.unique_skiers(spark, source, f"{tmp_path}/u"), totals.unique_skiers(want))
    assert same(jobs.rides_current(spark, source, f"{tmp_path}/c"), want)
    jobs.ingest(spark, source, f"{tmp_path}/b", files_per_batch=2)
    bronze = jobs.bronze(spark, f"{tmp_path}/b")
    assert same(rides.current(bronze), want)
    n = bronze.count()
    jobs.ingest(spark, source, f"{tmp_path}/b")  # nothing new
    assert jobs.bronze(spark, f"{tmp_path}/b").count() == n


def test_running_totals_are_state(spark, raw, source, tmp_path):
    """Late, repeated and replaced rides; a later run goes on from its state, with the first run's rides gone."""
    work = f"{tmp_path}/v"
    assert same(running.day_vertical(spark, source, work), totals.day_vertical(rides.current(rides.valid(raw))))
    written = spark.read.parquet(f"{work}/totals")
    assert "bronze" not in [p.name for p in (tmp_path / "v").iterdir()]
    n = written.count()
    more = events(spark, changed(ingest_seq=5, dayID="1", skierID="1", time=2, liftID=40), changed(ingest_seq=99, dayID="1", skierID="1", time=2, liftID=1), changed(ingest_seq=100, dayID="8", liftID=3))
    more.coalesce(1).write.mode("append").json(source)
    assert same(running.day_vertical(spark, source, work), totals.day_vertical(rides.current(rides.valid(raw.unionByName(more)))))
    assert spark.read.parquet(f"{work}/totals").count() == n + 2  # the changed totals alone


def test_rejected_records_come_back_mended(spark, raw, source, tmp_path):
    work = f"{tmp_path}/b"
    jobs.ingest(spark, source, work)
    letters = jobs.quarantine(spark, work)
    bad = letters.where(F.col("reject_reason") == UNREADABLE)
    assert sorted(r.value for r in bad.collect()) == ["", "not json", '{"ingest_seq":7,"resortID":"1"', '{"liftID":"x"}']
    assert all(r.origin.endswith("/in/broken.json") for r in bad.collect())
    known = letters.where(F.col("reject_reason") != UNREADABLE)
    assert known.count() > 0 and known.where("value is null or ingest_seq is null").count() == 0
    before = jobs.bronze(spark, work).count()
    mended = bad.where("value like '{\"ingest_seq\":7%'").withColumn("value", F.concat("value", F.lit(',"seasonID":"2025","dayID":"9","skierID":"9","liftID":9,"time":9}')))
    jobs.redeliver(mended, source)
    jobs.ingest(spark, source, work)
    after = jobs.bronze(spark, work)
    assert after.count() == before + 1 and after.where("dayID = '9'").first().liftID == 9
    jobs.redeliver(mended, source)  # again
    jobs.ingest(spark, source, work)
    assert rides.current(jobs.bronze(spark, work)).where("dayID = '9'").count() == 1


def test_counters_have_the_backlog(spark, source, tmp_path):
    jobs.ingest(spark, source, f"{tmp_path}/b")
    rows = spark.read.parquet(f"{tmp_path}/b/counters").orderBy("batch_id").collect()
    assert [r.files_left for r in rows] == [3, 2, 1, 0] and [r.files for r in rows] == [1, 2, 3, 4]
    assert sum(r.unreadable for r in rows) == 4


def test_replayed_batch_of_ingest_leaves_the_same(spark, source, tmp_path):
    """A batch that was written but not acknowledged is written again."""
    work = tmp_path / "b"
    jobs.ingest(spark, source, str(work))
    n, letters = jobs.bronze(spark, str(work)).count(), jobs.quarantine(spark, str(work)).count()
    last = max((work / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    jobs.ingest(spark, source, str(work))
    assert jobs.bronze(spark, str(work)).count() == n and jobs.quarantine(spark, str(work)).count() == letters


def test_published_records_are_read_back(spark, raw, source, tmp_path):
    out, work = f"{tmp_path}/out", tmp_path / "p"
    stream = lambda: rides.valid(files.ride_stream(spark, source))
    jobs.publish(stream(), out, str(work))
    jobs.ingest(spark, out, f"{tmp_path}/b")
    assert same(rides.current(jobs.bronze(spark, f"{tmp_path}/b")), rides.current(rides.valid(raw)))
    lines = spark.read.option("recursiveFileLookup", True).text(out).count()
    last = max((work / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    jobs.publish(stream(), out, str(work))
    assert spark.read.option("recursiveFileLookup", True).text(out).count() == lines
    first = files.keyed_envelopes(raw.limit(1)).first()
    assert first.key == "1#2025#0#0" and first.value.startswith('{"ingest_seq":0,"resortID":"1"')


def test_bounded_state_drops_and_counts_what_is_late(spark, tmp_path):
    source, work = f"{tmp_path}/in", f"{tmp_path}/w"
    for day in ("1", "2", "20", "21", "1", "21", "40"):  # the fifth file is 20 days late
        rows = [changed(ingest_seq=int(day) * 10 + i, dayID=day, skierID=str(i % 3 + 1)) for i in range(6)]
        events(spark, *rows).coalesce(1).write.mode("append").json(source)
    exact = jobs.unique_skiers(spark, source, f"{tmp_path}/u")
    assert {r.dayID: r.uniqueNumSkiers for r in exact.collect()} == dict.fromkeys(("1", "2", "20", "21", "40"), 3)
    within = jobs.unique_skiers_within(spark, source, work, "2 days")
    assert same(within, exact)
    state = spark.read.parquet(f"{work}/state").orderBy("batch_id").collect()
    assert sum(r.late for r in state) == 6 and max(r.state_rows for r in state) <= 9
    assert state[-1].state_rows <= 3  # of 15 keys
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != jobs.ROCKSDB
    odd = events(spark, changed(dayID="2147483647"), changed(dayID="-2147483648"), changed(seasonID="99999"))
    assert rides.valid(odd, ANY_SEASON).select(jobs.ride_time().alias("t")).where("t is null").count() == 0


def test_records_without_files_land_too(spark, tmp_path):
    """A batch of a queue: every record has an origin of its own, and none of them is gathered."""
    rows = [('{"ingest_seq":1,"resortID":"1","seasonID":"2025","dayID":"1","skierID":"1","liftID":1,"time":1}', "t/0/1"), ("oops", "t/0/2"), (None, "t/0/3")]
    jobs.land(spark.createDataFrame(rows, "value string, origin string"), 0, None, str(tmp_path))
    assert jobs.bronze(spark, str(tmp_path)).count() == 1
    assert {(r.value, r.origin) for r in jobs.quarantine(spark, str(tmp_path)).collect()} == {("oops", "t/0/2"), (None, "t/0/3")}
    counters = spark.read.parquet(f"{tmp_path}/counters").first()
    assert (counters.accepted, counters.unreadable, counters.files, counters.files_left) == (1, 2, None, None)


def test_records_that_wait_in_kafka():
    source = {"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7, "2": 3}}}
    assert jobs.records_left({"sources": [source, {k: __import__("json").dumps(v) for k, v in source.items()}]}) == 14
    assert jobs.records_left({"sources": [{"endOffset": None, "latestOffset": None}]}) == 0


def test_files_that_wait(spark, source, tmp_path):
    (tmp_path / "in" / "empty.json").write_text("")
    (tmp_path / "in" / "_hidden").write_text("x")
    assert versions.count_files(spark, source) == 4


def test_envelope_round_trip(spark, raw, tmp_path):
    files.write_json(raw, f"{tmp_path}/j", 3)
    assert spark.read.json(f"{tmp_path}/j").count() == 60
    assert files.envelopes(raw.limit(1)).first().value.startswith('{"resortID":"1","seasonID":"2025"')
    assert RESORT_DAY == ["resortID", "seasonID", "dayID"]


def test_persons_of_a_day_share_state(spark, raw, source, tmp_path, monkeypatch):
    """State is asked for by parts of a resort's day, not for each person; totals are the same with one part and with many."""
    rows = []

    def watched(*args):
        progress = jobs.run(*args)
        rows.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
        return progress

    monkeypatch.setattr(running, "run", watched)
    want = totals.day_vertical(rides.current(rides.valid(raw)))
    assert same(running.day_vertical(spark, source, f"{tmp_path}/one", parts=1), want)
    assert same(running.day_vertical(spark, source, f"{tmp_path}/many"), want)
    assert rows[0] == 2 < want.count()  # two days of a resort
