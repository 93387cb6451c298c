"""Composite keys and derived values of rides."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTICAL_PER_LIFT = 10


def key(*parts: str) -> Column:
    """Parts joined by #. Rides with null parts are quarantined before, so none is skipped here."""
    return F.concat_ws("#", *[F.col(p).cast("string") for p in parts])


def vertical(lift: Column) -> Column:
    return lift * VERTICAL_PER_LIFT


def first_part(composite: Column) -> Column:
    return F.split_part(composite, F.lit("#"), F.lit(1))


#: The composite keys of a stored ride; sort_key tells rides of a person apart, the others serve other access orders.
RIDE_KEYS = {
    "sort_key": ("resortID", "seasonID", "dayID", "time"),
    "skier_season": ("skierID", "seasonID"),
    "resort_day": ("resortID", "dayID"),
    "resort_skier": ("resortID", "skierID"),
    "season_day": ("seasonID", "dayID"),
    "resort_season_day": ("resortID", "seasonID", "dayID"),
}
