"""Parsing of ids, urls, bodies and stored numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rideledger.schemas import RIDE_BODY

#: The whole text, and no final line break as $ would allow.
INTEGER = r"^[+-]?[0-9]+\z"
URL = r"^/([^/]+)/seasons/([^/]+)/days/([^/]+)/skier/([^/]+)\z"


def integer(text: Column) -> Column:
    """The 32-bit integer a text spells, or null: no spaces, fractions, exponents or overflow."""
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def url_ids(url: Column) -> list[Column]:
    """The four ids of a ride's address; null where the address has another form."""
    return [F.when(url.rlike(URL), F.regexp_extract(url, URL, i + 1)).alias(c) for i, c in enumerate(("resortID", "seasonID", "dayID", "skierID"))]


def ride_url(resort: Column, season: Column, day: Column, skier: Column) -> Column:
    return F.format_string("/%s/seasons/%s/days/%s/skier/%s", resort, season, day, skier)


def ride_body(body: Column) -> Column:
    """liftID, time and _corrupt_record of a JSON body; a number in quotes or with a fraction is corrupt."""
    return F.from_json(body, RIDE_BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def blank(text: Column) -> Column:
    """Whether a text is missing or has nothing above U+0020: control characters count as spaces."""
    return F.coalesce(text, F.lit("")).rlike(r"^[\x00-\x20]*\z")


def strict_number(text: Column) -> Column:
    """A stored number: 0 where missing, an error where it is no number."""
    return F.coalesce(text.cast("int"), F.lit(0))


def lenient_number(text: Column) -> Column:
    """A stored number: null where missing or no number."""
    return text.try_cast("int")
