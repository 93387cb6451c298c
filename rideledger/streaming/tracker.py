"""Who has been counted, as a stored table, so that visitors are counted once over any number of runs.

The tracker is bucketed by its key: arrivals are dealt once, into the same buckets, and meet it where it lies, so what it has
grown to is read but never moved. A batch's new keys and its counts carry the batch's number. Counts are written last and mark the
batch as done; a batch that is sent again, or was broken off before, finds the keys of earlier batches only and so counts
the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.schemas import RESORT_DAY, SKIER_DAY
from rideledger.sources import versions

BUCKETS = 64
COUNTS = "resortID string, seasonID string, dayID string, uniqueNumSkiers bigint"


class Tracker:
    """The tracker in a shared folder. table is its name in this session's catalog; another session may give it another."""

    def __init__(self, spark: SparkSession, folder: str, table: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.table, self.buckets = spark, folder, table, buckets
        keys = ", ".join(SKIER_DAY)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({' STRING, '.join(SKIER_DAY)} STRING, batch BIGINT) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{folder}/keys'"
        )

    def done(self) -> set[int]:
        """Numbers of the batches whose counts are written."""
        return {int(p.rsplit("batch_id=", 1)[1].split("/")[0]) for p in versions.names(self.spark, f"{self.folder}/counts/batch_id=*/_SUCCESS")}

    def new_keys(self, arrivals: DataFrame, batch: int) -> DataFrame:
        """Keys of arrivals that no earlier batch has, each once."""
        dealt = arrivals.select(*SKIER_DAY).repartition(self.buckets, *SKIER_DAY).dropDuplicates()
        before = self.spark.table(self.table).where(F.col("batch") < batch).drop("batch")
        return dealt.join(before.hint("merge"), SKIER_DAY, "left_anti")

    def add(self, arrivals: DataFrame, batch: int) -> None:
        """Arrivals of a batch; numbers ascend from batch to batch. One that is done already changes nothing."""
        if batch in self.done():
            return
        keys = self.new_keys(arrivals, batch).select(*SKIER_DAY, F.lit(batch).cast("long").alias("batch"))
        keys.write.insertInto(self.table)  # into its buckets, in their order
        added = self.spark.table(self.table).where(F.col("batch") == batch).select(*SKIER_DAY).distinct()
        counts = added.groupBy(*RESORT_DAY).agg(F.count("*").alias("uniqueNumSkiers"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/batch_id={batch}")

    def counts(self) -> DataFrame:
        """Visitors by resort and day over all batches that are done."""
        folders = [f"{self.folder}/counts/batch_id={n}" for n in sorted(self.done())]
        found = self.spark.read.schema(COUNTS).parquet(*folders) if folders else self.spark.createDataFrame([], COUNTS)
        return found.groupBy(*RESORT_DAY).agg(F.sum("uniqueNumSkiers").alias("uniqueNumSkiers"))
