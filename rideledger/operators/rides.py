"""Validation, quarantine, upsert and enrichment of rides."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.functions.keys import RIDE_KEYS, key, vertical
from rideledger.functions.parsing import integer
from rideledger.rules import BAD_BODY, BAD_IDS, DEFAULT, Bounds
from rideledger.schemas import RIDE_KEY


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def valid_place(bounds: Bounds = DEFAULT) -> Column:
    """Resort, season and day of a request are acceptable; a day is any integer."""
    test = integer(F.col("resortID")).between(*bounds.resort) & integer(F.col("dayID")).isNotNull()
    season = integer(F.col("seasonID"))
    return _true(test & (season.isNotNull() if bounds.season is None else season == bounds.season))


def valid_ids(bounds: Bounds = DEFAULT) -> Column:
    return valid_place(bounds) & _true(integer(F.col("skierID")).between(*bounds.skier))


def valid_body(bounds: Bounds = DEFAULT) -> Column:
    return _true(F.col("liftID").between(*bounds.lift) & F.col("time").between(*bounds.time))


def tagged(rides: DataFrame, bounds: Bounds = DEFAULT) -> DataFrame:
    """rides plus reject_reason: null for valid rides; ids are looked at before the body, so there is one reason."""
    return rides.withColumn("reject_reason", F.when(~valid_ids(bounds), F.lit(BAD_IDS)).when(~valid_body(bounds), F.lit(BAD_BODY)))


def valid(rides: DataFrame, bounds: Bounds = DEFAULT) -> DataFrame:
    return rides.filter(valid_ids(bounds) & valid_body(bounds))


def current(rides: DataFrame, together: list[str] | None = None) -> DataFrame:
    """The latest ride of each key, by ingest_seq, with its vertical.

    The value stays an int and the version a bigint: so the aggregation is by hash, with partial results before the shuffle.
    With together, some of the key's columns, rides are dealt by these alone, and a later aggregation by them or by more
    columns needs no shuffle of its own. They should be many and even, as a person's days are.
    """
    latest = (rides.repartition(*together) if together else rides).groupBy(*RIDE_KEY).agg(F.max_by("liftID", "ingest_seq").alias("liftID"))
    return latest.withColumn("vertical", vertical(F.col("liftID")))


def enriched(rides: DataFrame) -> DataFrame:
    """Current rides in their stored form: composite keys, and numbers as text."""
    text = [F.col(c).cast("string").alias(f"{c}_text") for c in ("liftID", "time", "vertical")]
    return rides.select(*RIDE_KEY, *[key(*parts).alias(name) for name, parts in RIDE_KEYS.items()], *text)
