"""Verticals, unique visitors and listings over current rides, and lookups of them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rideledger.functions.parsing import blank, lenient_number, strict_number
from rideledger.operators.rides import valid_place
from rideledger.rules import DEFAULT, Bounds
from rideledger.schemas import RESORT_DAY, SKIER_DAY


def day_vertical(rides: DataFrame) -> DataFrame:
    return rides.groupBy(*SKIER_DAY).agg(F.sum("vertical").alias("totalVertical"))


def unique_skiers(rides: DataFrame) -> DataFrame:
    """Exact numbers of visitors; it is safe under redelivery."""
    return rides.groupBy(*RESORT_DAY).agg(F.count_distinct("skierID").alias("uniqueNumSkiers"))


def season_totals(rides: DataFrame) -> DataFrame:
    return rides.groupBy("skierID", "resortID", "seasonID").agg(F.sum("vertical").alias("totalVert"))


def one_season(rides: DataFrame, season: str | None) -> DataFrame:
    """Totals of one season, those above 0; of all seasons, unfiltered, where season is null or empty."""
    return season_totals(rides.where(F.col("seasonID") == season)).where("totalVert > 0") if season else season_totals(rides)


def totals_json(totals: DataFrame) -> DataFrame:
    """skierID, resortID, payload: {"resorts":[{"seasonID":..,"totalVert":..},..]} in order of seasons."""
    listed = F.sort_array(F.collect_list(F.struct("seasonID", "totalVert")))
    return totals.groupBy("skierID", "resortID").agg(F.to_json(F.struct(listed.alias("resorts"))).alias("payload"))


def lookup(requests: DataFrame, gold: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each request with its value, 0 where nothing is known. Null keys match nothing."""
    return requests.join(gold, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def strict_totals(rides: DataFrame) -> DataFrame:
    """Day totals of text verticals; a text that is no number fails the job."""
    return rides.groupBy(*SKIER_DAY).agg(F.sum(strict_number(F.col("vertical"))).alias("totalVertical"))


def lenient_totals(rides: DataFrame) -> DataFrame:
    """Season totals of text verticals; what is no number is left out and counted."""
    number = lenient_number(F.col("vertical"))
    bad = F.count_if(F.col("vertical").isNotNull() & number.isNull())
    return rides.groupBy("skierID", "resortID", "seasonID").agg(F.sum(number).alias("totalVert"), bad.alias("n_warnings"))


def increment(counts: DataFrame, tracker: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, tracker) after arrivals: only visitors whom the tracker hasn't seen count, however often they arrive."""
    new = arrivals.select(*SKIER_DAY).dropDuplicates().join(tracker, SKIER_DAY, "left_anti")
    delta = new.groupBy(*RESORT_DAY).agg(F.count("*").alias("uniqueNumSkiers"))
    merged = counts.unionByName(delta).groupBy(*RESORT_DAY).agg(F.sum("uniqueNumSkiers").alias("uniqueNumSkiers"))
    return merged, tracker.unionByName(new)


def read_status(requests: DataFrame, totals: DataFrame, bounds: Bounds = DEFAULT) -> DataFrame:
    """requests (resortID, seasonID, dayID, skierID) with the status each kind of read gives.

    Unique visitors: 400 for a bad place, else 200. Season totals: 400 for a blank person or resort, 404 where nothing
    is found, else 200. A day's vertical is never refused.
    """
    found = totals.where("totalVert > 0").select("skierID", "resortID", "seasonID", F.lit(True).alias("found"))
    joined = requests.join(found, ["skierID", "resortID", "seasonID"], "left")
    missing = F.when(blank(F.col("skierID")) | blank(F.col("resortID")), F.lit(400)).when(F.col("found").isNull(), F.lit(404))
    return joined.select(
        *SKIER_DAY,
        F.when(valid_place(bounds), F.lit(200)).otherwise(F.lit(400)).alias("unique_status"),
        missing.otherwise(F.lit(200)).alias("totals_status"),
        F.lit(200).alias("vertical_status"),
    )


def skier_seasons(rides: DataFrame) -> DataFrame:
    """Days and vertical of each person and season."""
    return rides.groupBy("skierID", "seasonID").agg(F.count_distinct("dayID").alias("n_days"), F.sum("vertical").alias("totalVert"))


def season_listing(rides: DataFrame) -> DataFrame:
    """Each person's rides of a season with their position in the order of days (as numbers), minutes and resorts."""
    order = Window.partitionBy("skierID", "seasonID").orderBy(F.col("dayID").try_cast("int"), "time", "resortID", "dayID")
    return rides.select("skierID", "seasonID", F.row_number().over(order).alias("position"), "resortID", "dayID", "time", "liftID", "vertical")


def resort_day_skiers(rides: DataFrame) -> DataFrame:
    """Who was at a resort on a day of any season."""
    return rides.select("resortID", "dayID", "skierID").distinct()


def resort_season_activity(rides: DataFrame) -> DataFrame:
    """Rides and vertical of each person and day at a resort in a season, in order of days and persons as numbers."""
    found = rides.groupBy(*SKIER_DAY).agg(F.count("*").alias("n_rides"), F.sum("vertical").alias("totalVert"))
    return found.orderBy("resortID", "seasonID", F.col("dayID").try_cast("int"), F.col("skierID").try_cast("int"))
