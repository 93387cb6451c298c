"""Stored rides and the tables that reads are answered from, both kept up to date by what has come in.

Rides are a base and deltas: bronze batches that the base doesn't have yet. A read merges them; compaction makes a new base of the
partitions that the deltas touch. Marts name the base's folders that they were made of, so that a refresh finds the partitions that have
changed since and computes these alone. Both are versions (sources.versions): a reader of an hour's tables isn't disturbed by the next.

A partition is a season and resort. Inside, rows lie in the order of persons, a range of them to a file, so that a read of one person
skips all other files and pages by their least and greatest ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.functions.keys import vertical
from rideledger.operators import rides, totals
from rideledger.rules import DEFAULT, Bounds
from rideledger.schemas import RESORT_DAY, RIDE_KEY, SKIER_DAY
from rideledger.sources import versions
from rideledger.sources.files import record_stream
from rideledger.streaming.jobs import land

PARTS = ["seasonID", "resortID"]
#: Files that a step of follow() takes in at most.
FILES = 1000
BASE = "ingest_seq bigint, resortID string, seasonID string, dayID string, skierID string, liftID int, time int"
MARTS = {
    "day_vertical": "resortID string, seasonID string, dayID string, skierID string, totalVertical bigint",
    "resort_day_unique": "resortID string, seasonID string, dayID string, uniqueNumSkiers bigint",
    "season_totals": "skierID string, resortID string, seasonID string, totalVert bigint",
}
#: What each mart is made of, and the column that its files are ordered by.
_BUILD = {
    "day_vertical": (totals.day_vertical, "skierID"),
    "resort_day_unique": (totals.unique_skiers, "dayID"),
    "season_totals": (totals.season_totals, "skierID"),
}


def clustered(df: DataFrame, column: str) -> DataFrame:
    """df dealt for a write by PARTS: a file is a range of column within a partition.

    A large partition is dealt over many tasks and a small one shares its task with others, so that there are about as many
    files as tasks and partitions together.
    """
    return df.repartitionByRange(*PARTS, column).sortWithinPartitions(*PARTS, column)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batch folders that were written to their end."""
    return sorted(int(p.rsplit("batch_id=", 1)[1].split("/")[0]) for p in versions.names(spark, f"{folder}/batch_id=*/_SUCCESS"))


def batches(spark: SparkSession, bronze: str, after: int) -> tuple[DataFrame, int]:
    """(accepted rides of the committed batches after a number, the last of these numbers).

    bronze is what ingest() landed, of which rejected records aren't read, or folders of accepted rides alone.
    """
    found = [n for n in committed(spark, bronze) if n > after]
    folders = []
    for n in found:
        dealt = versions.names(spark, f"{bronze}/batch_id={n}/accepted=*")
        folders += [p for p in dealt if p.endswith("=true")] if dealt else [f"{bronze}/batch_id={n}"]
    rows = spark.read.schema(BASE).parquet(*folders) if folders else spark.createDataFrame([], BASE)
    return rows, found[-1] if found else after


def current_rides(spark: SparkSession, bronze: str, base: str) -> DataFrame:
    """The latest ride of each key, base and deltas merged as they are read."""
    at = versions.latest(spark, base)
    new, _ = batches(spark, bronze, at.note.get("upto", -1))
    return rides.current(versions.read(spark, base, at, "rides", BASE).unionByName(new))


def compact(spark: SparkSession, bronze: str, base: str) -> versions.Version:
    """A base that has all committed batches; nothing is written where there are no new ones.

    Only the partitions that new rides lie in are read and written. Batches that the base has aren't read again.
    """
    at = versions.latest(spark, base)
    new, last = batches(spark, bronze, at.note.get("upto", -1))
    if last == at.note.get("upto", -1):
        return at
    touched = {versions.partition(PARTS, tuple(r)) for r in new.select(*PARTS).distinct().collect()}
    merged = versions.read(spark, base, at, "rides", BASE, touched).unionByName(new)
    latest = merged.groupBy(*RIDE_KEY).agg(F.max_by("liftID", "ingest_seq").alias("liftID"), F.max("ingest_seq").alias("ingest_seq"))
    frame = clustered(latest, "skierID")
    return versions.publish(spark, base, at, {"rides": frame}, PARTS, touched, {"upto": last})


def refresh(spark: SparkSession, base: str, gold: str) -> versions.Version:
    """Marts of the base's newest version; run it as often as answers may be old, hourly say.

    A partition is computed if the base has another folder for it than the one the marts were made of.
    """
    source, at = versions.latest(spark, base), versions.latest(spark, gold)
    now, then = source.tables.get("rides", {}), at.note.get("rides", {})
    touched = {part for part in now.keys() | then.keys() if now.get(part) != then.get(part)}
    if not touched:
        return at
    current = versions.read(spark, base, source, "rides", BASE, touched).withColumn("vertical", vertical(F.col("liftID")))
    frames = {name: clustered(build(current), column) for name, (build, column) in _BUILD.items()}
    return versions.publish(spark, gold, at, frames, PARTS, touched, {"rides": now})


def read_mart(spark: SparkSession, gold: str, name: str, at: versions.Version | None = None, only: set[str] | None = None) -> DataFrame:
    """A mart of the newest version, or of one that the caller holds on to; all of it or some partitions."""
    return versions.read(spark, gold, at or versions.latest(spark, gold), name, MARTS[name], only)


def answers(spark: SparkSession, gold: str, requests: DataFrame) -> DataFrame:
    """requests (resortID, seasonID, dayID, skierID, ...) with totalVertical and uniqueNumSkiers, 0 where nothing is known.

    Both come from one version. Only the partitions that requests name are read; their names, a pair for each season and
    resort, come to the driver.
    """
    at = versions.latest(spark, gold)
    asked = {"/".join(f"{c}={v}" for c, v in zip(PARTS, r, strict=True)) for r in requests.select(*PARTS).distinct().collect()}
    days, visitors = (read_mart(spark, gold, name, at, asked) for name in ("day_vertical", "resort_day_unique"))
    return totals.lookup(totals.lookup(requests, days, SKIER_DAY, "totalVertical"), visitors, RESORT_DAY, "uniqueNumSkiers")


def skier_days(spark: SparkSession, gold: str, resort: str, season: str, skier: str) -> DataFrame:
    """One person's days at a resort in a season: one partition, and of it the files and pages that can have the person."""
    held = read_mart(spark, gold, "day_vertical")
    return held.where((F.col("seasonID") == season) & (F.col("resortID") == resort) & (F.col("skierID") == skier)).select(*SKIER_DAY, "totalVertical")


def follow(spark: SparkSession, source: str, work: str, every: str = "1 hour", bounds: Bounds = DEFAULT):
    """A stream that lands what comes in and, after each batch, brings base and marts up to date: answers are as old as every, at most.

    Compaction and refresh find out by themselves what is new, so a batch that is replayed does nothing twice; versions but
    the last two expire. Returns the running query.
    """

    def each(batch: DataFrame, number: int) -> None:
        land(batch, number, source, work, bounds)
        compact(spark, f"{work}/landed", f"{work}/base")
        refresh(spark, f"{work}/base", f"{work}/gold")
        for tables in ("base", "gold"):
            versions.expire(spark, f"{work}/{tables}")

    stream = record_stream(spark, source, FILES)
    return stream.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(processingTime=every).foreachBatch(each).start()
