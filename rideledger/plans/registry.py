"""Query name -> plan, and query name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rideledger.plans import oracles, queries

#: Every public function of the queries module.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in vars(queries).items() if callable(f) and getattr(f, "__module__", "") == queries.__name__ and not name.startswith("_")
}
ORACLES: dict[str, str] = oracles.ORACLES
