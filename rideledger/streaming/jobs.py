"""Ride streams: what is accepted and what is not, publishing, and running state.

Batches are written a folder each, with overwrite, so a batch that is replayed leaves the same files; the checkpoint moves
on after that. Whatever is derived is derived from these folders or from keyed state, so replays change nothing.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rideledger.operators import rides, totals
from rideledger.rules import BAD_BODY, BAD_IDS, DEFAULT, UNREADABLE, Bounds
from rideledger.schemas import RESORT_DAY, RIDE_KEY, SKIER_DAY
from rideledger.sources import versions
from rideledger.sources.files import decoded, keyed_envelopes, record_stream, record_stream_kafka, ride_stream

COUNTERS = "accepted bigint, bad_ids bigint, bad_body bigint, unreadable bigint, files bigint, files_left bigint"
LANDED = "ingest_seq bigint, resortID string, seasonID string, dayID string, skierID string, liftID int, time int"
LETTERS = f"{LANDED}, value string, origin string, reject_reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **wanted: str):
    """Settings that a stream takes with it when it starts, as they were before afterwards."""
    wanted = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_rocksdb(spark: SparkSession):
    """State on the executors' disks, its changes in the checkpoint: it may be larger than their memory."""
    return _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB)


def run(stream: DataFrame, mode: str, work: str, each) -> list[dict]:
    """Each batch of what is there, through each(batch, number); the progress of all batches."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return list(query.recentProgress)


def write_batch(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch}")


def _files_left(spark: SparkSession, source: str, work: str, batch: int, seen: int) -> tuple[int, int]:
    """(files taken in up to this batch, files that still wait): those that have anything in them."""
    before = 0
    if versions.names(spark, f"{work}/counters/batch_id={batch - 1}/_SUCCESS"):
        before = spark.read.schema(COUNTERS).parquet(f"{work}/counters/batch_id={batch - 1}").first()["files"]
    done = before + seen
    return done, max(0, versions.count_files(spark, source) - done)


def land(batch: DataFrame, number: int, source: str | None, work: str, bounds: Bounds = DEFAULT) -> None:
    """A batch of records to work/landed: valid rides, and all others as they came, with their reason, in folders of their own.

    It is written once. What was counted meanwhile goes to work/counters; where records come in files of the folder source,
    with the number of files taken in (a batch has as many as it was told to take at most) and of those that wait.
    """
    spark, seen, reason = batch.sparkSession, Observation(), F.col("reject_reason")
    tagged = rides.tagged(decoded(batch), bounds)
    tagged = tagged.withColumn("reject_reason", F.when(F.col("unreadable"), F.lit(UNREADABLE)).otherwise(reason)).drop("unreadable")
    tests = {"accepted": reason.isNull(), "bad_ids": reason == BAD_IDS, "bad_body": reason == BAD_BODY, "unreadable": reason == UNREADABLE}
    origins = F.collect_set("origin") if source else F.array()
    tagged = tagged.observe(seen, *[F.count_if(test).alias(name) for name, test in tests.items()], origins.alias("origins"))
    kept = F.when(reason.isNotNull(), F.col("value"))  # an accepted record is all in its columns
    landed = tagged.withColumns({"value": kept, "accepted": reason.isNull()})
    landed.write.mode("overwrite").partitionBy("accepted").parquet(f"{work}/landed/batch_id={number}")
    done, left = _files_left(spark, source, work, number, len(seen.get["origins"])) if source else (None, None)
    write_batch(spark.createDataFrame([(*[seen.get[name] for name in tests], done, left)], COUNTERS), f"{work}/counters", number)


def ingest(spark: SparkSession, source: str, work: str, bounds: Bounds = DEFAULT, files_per_batch: int = 1) -> None:
    """All records that are there, landed batch by batch; none stops the stream. See bronze() and quarantine()."""
    run(record_stream(spark, source, files_per_batch), "append", work, lambda batch, number: land(batch, number, source, work, bounds))


def ingest_kafka(spark: SparkSession, servers: str, topic: str, work: str, bounds: Bounds = DEFAULT) -> list[dict]:
    """The same from a Kafka topic: (batch, records that wait behind it) of each batch; needs the Kafka package on the classpath."""
    progress = run(record_stream_kafka(spark, servers, topic), "append", work, lambda batch, number: land(batch, number, None, work, bounds))
    return [{"batch_id": p["batchId"], "records_left": records_left(p)} for p in progress]


def records_left(progress: dict) -> int:
    """Records that waited in Kafka behind a batch, from the stream's progress: the latest offsets less those that it ended at."""
    left = 0
    for source in progress["sources"]:
        ends, latest = (source.get(k) or {} for k in ("endOffset", "latestOffset"))
        ends, latest = (json.loads(x) if isinstance(x, str) else x for x in (ends, latest))
        left += sum(max(0, at - ends.get(topic, {}).get(part, 0)) for topic, parts in latest.items() for part, at in parts.items())
    return left


def _landed(spark: SparkSession, work: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, accepted boolean, batch_id bigint").parquet(f"{work}/landed")


def bronze(spark: SparkSession, work: str) -> DataFrame:
    """The valid rides of all batches, with their batch; rejected records aren't read."""
    return _landed(spark, work, LANDED).where("accepted").drop("accepted")


def quarantine(spark: SparkSession, work: str) -> DataFrame:
    """The rejected records of all batches: value as it came, where it came from, why it was rejected, and what could be read of it."""
    return _landed(spark, work, LETTERS).where("not accepted").drop("accepted")


def redeliver(letters: DataFrame, source: str) -> None:
    """Mended records (value) back to the source, as new files that the stream takes in like any others. Sent twice, they count once."""
    letters.select("value").write.mode("append").text(source)


def publish(stream: DataFrame, out: str, work: str) -> None:
    """A stream of rides as keyed JSON records, a folder of lines a batch; a replayed batch leaves one folder."""

    def each(batch: DataFrame, number: int) -> None:
        lines = keyed_envelopes(batch).repartition("key").sortWithinPartitions("key")
        lines.select("value").write.mode("overwrite").text(f"{out}/batch_id={number}")

    run(stream, "append", work, each)


def publish_kafka(stream: DataFrame, servers: str, topic: str, work: str):
    """The same to a Kafka topic, by key; needs the Kafka package on the classpath. Delivery is at least once, as readers fold rides by key."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": f"{work}/checkpoint"}
    return keyed_envelopes(stream).writeStream.format("kafka").options(**options).trigger(availableNow=True).start()


def unique_skiers(spark: SparkSession, source: str, work: str, bounds: Bounds = DEFAULT, files_per_batch: int = 1) -> DataFrame:
    """Exact visitors by resort and day: distinct keys as state; each batch writes how many are new, and a read adds these up.

    State grows with the distinct keys, as rides for any day are taken at any time; unique_skiers_within() bounds it.
    """
    keys = rides.valid(ride_stream(spark, source, files_per_batch), bounds).dropDuplicates(SKIER_DAY)
    with in_rocksdb(spark):
        run(keys, "append", work, lambda df, n: write_batch(_counted(df), f"{work}/counts", n))
    return _added(spark, work)


def _counted(new: DataFrame) -> DataFrame:
    return new.groupBy(*RESORT_DAY).agg(F.count("*").alias("uniqueNumSkiers"))


def _added(spark: SparkSession, work: str) -> DataFrame:
    counts = spark.read.schema("resortID string, seasonID string, dayID string, uniqueNumSkiers bigint").parquet(f"{work}/counts")
    return counts.groupBy(*RESORT_DAY).agg(F.sum("uniqueNumSkiers").alias("uniqueNumSkiers"))


#: Days before and after its season's first that a ride's time can lie; those beyond have the last one.
_FAR_DAYS = 3650


def ride_time() -> Column:
    """When a ride took place: a minute of a day, counted from the first one of its season, which is a year."""
    within = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c).cast("int")))
    one, none = F.lit(1), F.lit(0)
    start = F.make_timestamp_ntz(within("seasonID", 1, 9000), one, one, none, none, none).cast("timestamp")
    return start + F.make_dt_interval(within("dayID", -_FAR_DAYS, _FAR_DAYS) - 1, none, F.col("time"))


def unique_skiers_within(spark: SparkSession, source: str, work: str, delay: str = "7 days", bounds: Bounds = DEFAULT, files_per_batch: int = 1) -> DataFrame:
    """Visitors by resort and day where rides come no later than delay after the latest one: state is kept that long only.

    Rides that come later are dropped, and counted: work/state has each batch's dropped rows and rows of state. For rides that are
    in time the numbers are those of unique_skiers(); delay should be a day at least, as a person's day lasts as long.
    """
    stream = rides.valid(ride_stream(spark, source, files_per_batch), bounds).withColumn("ride_time", ride_time())
    keys = stream.withWatermark("ride_time", delay).dropDuplicatesWithinWatermark(SKIER_DAY)
    with in_rocksdb(spark), _settings(spark, spark__sql__streaming__numRecentProgressUpdates="100000"):
        progress = run(keys, "append", work, lambda df, n: write_batch(_counted(df), f"{work}/counts", n))
    # A batch without new rows only moves the watermark; it has the number of the batch that takes in the next ones.
    states = [(p["batchId"], *[sum(s[c] for s in p["stateOperators"]) for c in ("numRowsDroppedByWatermark", "numRowsTotal")]) for p in progress if p["stateOperators"]]
    spark.createDataFrame(states, "batch_id bigint, late bigint, state_rows bigint").write.mode("append").parquet(f"{work}/state")
    return _added(spark, work)


def rides_current(spark: SparkSession, source: str, work: str, bounds: Bounds = DEFAULT, files_per_batch: int = 1) -> DataFrame:
    """The latest ride of each key: the maximum by ingest_seq as state, changed keys written by batch."""
    latest = rides.valid(ride_stream(spark, source, files_per_batch), bounds).groupBy(*RIDE_KEY)
    latest = latest.agg(F.max_by("liftID", "ingest_seq").alias("liftID"), F.max("ingest_seq").alias("ingest_seq"))
    with in_rocksdb(spark):
        run(latest, "update", work, lambda df, n: write_batch(df, f"{work}/changes", n))
    return rides.current(spark.read.parquet(f"{work}/changes").drop("batch_id"))
