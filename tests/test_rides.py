"""Boundary rows and invariants of ride operators."""

import random

import pytest
from pyspark.sql import functions as F

from rideledger.functions import parsing
from rideledger.operators import latency, rides, totals
from rideledger.rules import BAD_BODY, BAD_IDS, Bounds
from rideledger.schemas import RIDE_EVENT, SKIER_DAY
from rideledger.sources import files, tables

GOOD = (1, "1", "2025", "1", "1", 1, 1)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), RIDE_EVENT)


def changed(**new):
    names = ["ingest_seq", "resortID", "seasonID", "dayID", "skierID", "liftID", "time"]
    return tuple(new.get(n, v) for n, v in zip(names, GOOD, strict=True))


CASES = [
    *[("resortID", v, BAD_IDS) for v in ("0", "11", None, "", " 5", "5\n", "5.0", "5e0", "2147483648", "x")],
    *[("resortID", v, None) for v in ("1", "10", "+5", "007")],
    *[("seasonID", v, BAD_IDS) for v in ("2024", "2026", "2025 ", None)],
    *[("dayID", v, None) for v in ("-3", "0", "999")],
    *[("dayID", v, BAD_IDS) for v in ("day7", "", None)],
    *[("skierID", v, BAD_IDS) for v in ("0", "100001", None)],
    *[("skierID", v, None) for v in ("1", "100000")],
    *[("liftID", v, BAD_BODY) for v in (0, 41, None)],
    *[("liftID", v, None) for v in (1, 40)],
    *[("time", v, BAD_BODY) for v in (0, 361, None)],
    *[("time", v, None) for v in (1, 360)],
]


def test_bounds(spark):
    df = events(spark, *[changed(ingest_seq=i, **{c: v}) for i, (c, v, _) in enumerate(CASES)])
    got = {r.ingest_seq: r.reject_reason for r in rides.tagged(df).collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(CASES)}
    both = rides.tagged(events(spark, changed(resortID="0", liftID=0))).first()
    assert both.reject_reason == BAD_IDS  # ids are looked at first
    assert rides.valid(events(spark, changed(resortID="5000", seasonID="1999")), Bounds(resort=(1, 5000), season=None)).count() == 1
    assert rides.valid(df).count() + rides.tagged(df).where("reject_reason is not null").count() == len(CASES)


@pytest.mark.parametrize(
    ("body", "want"),
    [("{}", (None, None, False)), ('{"time":1}', (None, 1, False)), ('{"liftID":null,"time":1}', (None, 1, False)), ('{"liftID":2,"time":1,"x":3}', (2, 1, False)), ('{"liftID":"5","time":1}', None), ('{"liftID":5.7,"time":1}', None), ("oops", None)],
)
def test_bodies(spark, body, want):
    r = spark.createDataFrame([(body,)], "body string").select(parsing.ride_body(F.col("body")).alias("b")).first().b
    assert (r._corrupt_record is not None) == (want is None)
    assert want is None or (r.liftID, r.time, False) == want


def test_urls(spark):
    df = spark.createDataFrame([("/1/seasons/2025/days/2/skier/3",), ("/1/seasons/2025/days/2/skier/",), ("/1/2/3",), (None,)], "url string")
    got = [tuple(r) for r in df.select(*parsing.url_ids(F.col("url"))).collect()]
    assert got == [("1", "2025", "2", "3"), *[(None,) * 4] * 3]


def test_latest_ride_wins_in_any_order(spark):
    three = [changed(ingest_seq=i, liftID=v) for i, v in enumerate((3, 8, 5))]
    for rows in (three, three[::-1], three + three):
        assert [(r.liftID, r.vertical) for r in rides.current(events(spark, *rows)).collect()] == [(5, 50)]


def test_result_does_not_depend_on_partitions(spark):
    rnd = random.Random(1)
    rows = [changed(ingest_seq=i, skierID=str(rnd.randint(1, 5)), time=rnd.randint(1, 4), liftID=rnd.randint(1, 40)) for i in range(300)]
    want = None
    for n in (1, 7):
        rnd.shuffle(rows)
        got = sorted(map(tuple, totals.day_vertical(rides.current(events(spark, *rows).repartition(n))).collect()))
        assert want is None or got == want
        want = got


def test_increment_equals_recount(spark):
    rows = [changed(ingest_seq=i, dayID=str(i % 3), skierID=str(i % 7 + 1)) for i in range(60)]
    all_rows = events(spark, *rows)
    counts, tracker = totals.unique_skiers(all_rows.limit(0)), all_rows.limit(0).select(*SKIER_DAY)
    for part in (all_rows.where("ingest_seq < 20"), all_rows.where("ingest_seq >= 10"), all_rows):
        counts, tracker = totals.increment(counts, tracker, part)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, totals.unique_skiers(all_rows).collect()))


def test_text_verticals(spark):
    df = spark.createDataFrame([("1", "2025", "1", "1", v) for v in ("10", None, "n/a")], "resortID string, seasonID string, dayID string, skierID string, vertical string")
    got = totals.lenient_totals(df).first()
    assert (got.totalVert, got.n_warnings) == (10, 1)
    assert totals.strict_totals(df.where("vertical is null or vertical <> 'n/a'")).first().totalVertical == 10
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        totals.strict_totals(df).collect()


def test_prefixes_end_at_a_part(spark):
    df = rides.enriched(rides.current(events(spark, changed(dayID="1"), changed(dayID="10"), changed(resortID="10"))))
    assert df.where(F.col("sort_key").startswith("1#2025#1#")).count() == 1
    assert df.where(F.col("sort_key").startswith("1#202#")).count() == 0


def test_one_season_and_json(spark):
    df = spark.createDataFrame([("1", "1", "2025", 0), ("1", "2", "2025", 5), ("1", "2", "2024", 7)], "skierID string, resortID string, seasonID string, vertical int")
    assert totals.one_season(df, "2025").count() == 1
    assert totals.one_season(df, None).count() == totals.one_season(df, "").count() == 3
    got = {r.resortID: r.payload for r in totals.totals_json(totals.season_totals(df)).collect()}
    assert got["2"] == '{"resorts":[{"seasonID":"2024","totalVert":7},{"seasonID":"2025","totalVert":5}]}'


def test_ranks_without_buffers(spark):
    """Many ranges of values, repeated ones, groups that are null or have no values; the plan buffers none."""
    import math
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["a", None]), rnd.choice([rnd.randint(0, 60_000), rnd.randint(0, 9), 4096])) for _ in range(3000)]
    rows += [(3, "a", None), (3, None, 2**40), (3, None, None)]
    df = spark.createDataFrame(rows, "phase int, kind string, latency_ms long")
    got = {(r.phase, r.kind): tuple(r)[2:] for r in latency.summary(df, ["phase", "kind"]).collect()}
    for key in {(p, k) for p, k, _ in rows}:
        every = [x for p, k, x in rows if (p, k) == key]
        xs = sorted(x for x in every if x is not None)
        want = (round(sum(xs) / len(xs), 6), (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) // 2, xs[math.ceil(len(xs) * 99 / 100) - 1], xs[0], xs[-1]) if xs else (None,) * 5
        assert got.pop(key) == (len(every), *want)
    assert not got
    plan = latency.summary(df, ["phase"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 99, 100, 101])
def test_percentiles(spark, n):
    values = [(i * 37) % 101 + i % 2 for i in range(n)]
    df = spark.createDataFrame([(1, v) for v in values], "phase int, latency_ms long")
    got = latency.summary(df, ["phase"]).collect()
    if not n:
        assert got == []
        return
    s = sorted(values)
    assert got[0].p99_ms == s[-(-99 * n // 100) - 1]
    assert got[0].median_ms == (s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) // 2)


def test_gauge(spark):
    spans = [(1, 0, 100), (1, 100, 100), (1, 150, 320), (2, 320, 500), (2, 130, 170)]
    df = spark.createDataFrame(spans, "phase int, start_ms long, end_ms long").withColumn("latency_ms", F.col("end_ms") - F.col("start_ms"))
    got = {(r.phase, r.tick): r.active for r in latency.gauge(df, 100).collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 2): 0, (2, 3): 0, (2, 4): 1}
    assert latency.gauge(df.limit(0), 100).count() == 0


def test_csv_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "POST", 2, 200)], "start_ms long, request_type string, latency_ms long, response_code int")
    files.write_latency_csv(df, f"{tmp_path}/csv")
    header = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text().splitlines()[0]
    assert header == "start_time,request_type,latency_ms,response_code"
    assert files.read_latency_csv(spark, f"{tmp_path}/csv").first().latency_ms == 2


def test_synthetic_source_is_stable(spark):
    a, b = tables.synthetic_rides(spark.range(500)), tables.synthetic_rides(spark.range(500).repartition(5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert rides.valid(a).count() == 500


def test_blank_counts_control_characters(spark):
    df = spark.createDataFrame([(None,), ("",), ("\t \x01",), ("\u00a0",), ("a",)], "x string")
    assert [r[0] for r in df.select(parsing.blank(F.col("x"))).collect()] == [True, True, True, False, False]


def test_two_decimals_and_cancelled(spark):
    df = spark.createDataFrame([(1, 0.125, "cancelled"), (2, 2.0, "failed"), (3, 1.006, "completed")], "id int, x double, state string")
    got = df.orderBy("id").select(latency.two_decimals(F.col("x")), latency.outcome(F.col("state"), F.lit(200))).collect()
    assert [tuple(r) for r in got] == [("0.13", 499), ("2.00", 500), ("1.01", 200)]


def test_listing_goes_by_days_as_numbers(spark):
    rows = [("7", "2025", "10", "1", 5, 3, 30), ("7", "2025", "9", "2", 5, 3, 30), ("7", "2025", "9", "1", 5, 4, 40)]
    df = spark.createDataFrame(rows, "skierID string, seasonID string, dayID string, resortID string, time int, liftID int, vertical int")
    got = totals.season_listing(df).orderBy("position").collect()
    assert [(r.dayID, r.resortID) for r in got] == [("9", "1"), ("9", "2"), ("10", "1")]


def test_gauge_over_many_ranges(spark):
    """Long requests over ranges of ticks without any change."""
    rows = [(1, 0, 100_000 * 100), (1, 50, 60), (1, 20_000 * 100, 20_001 * 100), (2, 5_000, 5_001)]
    got = latency.gauge(spark.createDataFrame(rows, "phase int, start_ms long, end_ms long"), 100).where("phase = 1")
    assert got.count() == 100_000 and {r.active: r["count"] for r in got.groupBy("active").count().collect()} == {1: 99_999, 2: 1}
