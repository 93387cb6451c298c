"""Ride, request and latency tables mapped from the generic tables of a directory, and a synthetic source."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.functions.parsing import ride_url


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def rides_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """One season of raw rides, with invalid ones of every kind: the envelope as it comes from the stream."""
    e = table(spark, folder, "events")
    day = F.dayofyear("ts")
    return e.select(
        F.col("event_id").alias("ingest_seq"),
        _text((F.col("user_id") + day) % 12).alias("resortID"),
        F.when(F.col("event_id") % 89 == 0, "2024").otherwise("2025").alias("seasonID"),
        F.when(F.col("event_id") % 101 == 0, "day7").otherwise(_text(day)).alias("dayID"),
        _text(F.col("user_id")).alias("skierID"),
        (F.get_json_object("props", "$.k").cast("int") % 45).alias("liftID"),
        F.when(F.col("event_id") % 97 == 0, 361).otherwise(1 + 15 * F.hour("ts")).alias("time"),
    )


def requests_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same rides as addresses and JSON bodies; every 83rd body is cut short."""
    rides = rides_of_events(spark, folder)
    body = F.concat(F.lit('{"liftID":'), F.col("liftID"), F.lit(',"time":'), F.col("time"))
    return rides.select(
        "ingest_seq",
        ride_url(*[F.col(c) for c in ("resortID", "seasonID", "dayID", "skierID")]).alias("url"),
        F.when(F.col("ingest_seq") % 83 == 0, body).otherwise(F.concat(body, F.lit("}"))).alias("body"),
    )


def padded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Persons' ids of events as careless clients send them: some missing, empty, or of blanks and control characters alone."""
    e, n = table(spark, folder, "events"), F.col("event_id") % 7
    text = F.when(n == 0, None).when(n == 1, "").when(n == 2, " \t\r\n").when(n == 3, "\x01\x1f ").when(n == 4, "\u00a0").when(n == 5, F.concat(F.lit("\t"), _text(F.col("user_id")), F.lit(" ")))
    return e.select(F.col("event_id").alias("ingest_seq"), text.otherwise(_text(F.col("user_id"))).alias("padded"))


def rides_of_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Seven seasons of raw rides. Rows that tie on ingest_seq carry the same lift."""
    line = table(spark, folder, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 64 + F.col("l_quantity").cast("int")).cast("bigint").alias("ingest_seq"),
        _text(F.col("l_suppkey") % 10 + 1).alias("resortID"),
        _text(F.year("l_shipdate")).alias("seasonID"),
        _text(F.dayofyear("l_shipdate") % 30 + 1).alias("dayID"),
        _text(F.col("l_partkey") % 500 + 1).alias("skierID"),
        F.col("l_quantity").cast("int").alias("liftID"),
        (F.col("l_linenumber") * 50).cast("int").alias("time"),
    )


def text_verticals(rides: DataFrame) -> DataFrame:
    """Rides with their vertical as text: missing in every 53rd row, no number in every 59th."""
    seq = F.col("ingest_seq")
    value = F.when(seq % 53 == 0, None).when(seq % 59 == 0, "n/a").otherwise(_text(F.col("liftID") * 10))
    return rides.withColumn("vertical", value)


def latencies_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Latency records with their intervals; timestamps have no zone, so none shifts them."""
    e = table(spark, folder, "events")
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    start = F.call_function("div", start, F.lit(1000).cast("bigint"))
    took = F.floor(F.col("value") * 1000).cast("bigint")
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429).otherwise(200)
    return e.select(
        "event_id",
        start.alias("start_ms"),
        (start + took).alias("end_ms"),
        F.lit("POST").alias("request_type"),
        took.alias("latency_ms"),
        code.alias("response_code"),
        F.when(F.dayofyear("ts") <= 5, 1).otherwise(2).alias("phase"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 61 == 0, "cancelled").otherwise("completed").alias("state"),
    )


def synthetic_rides(ids: DataFrame, seed: int = 1, skiers: int = 100_000, lifts: int = 40, minutes: int = 360) -> DataFrame:
    """A ride of one resort and day for each id, drawn evenly from the id: the same rows under any partitioning."""
    draw = lambda k, salt: (F.expr(f"((id * 2654435761 + {seed * 40503 + salt * 104729}) % 4294967296) div 64 % {k}") + 1).cast("int")
    return ids.select(
        F.col("id").alias("ingest_seq"),
        F.lit("1").alias("resortID"),
        F.lit("2025").alias("seasonID"),
        F.lit("1").alias("dayID"),
        _text(draw(skiers, 1)).alias("skierID"),
        draw(lifts, 2).alias("liftID"),
        draw(minutes, 3).alias("time"),
    )
