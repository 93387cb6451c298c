"""Running totals of a person's day, kept as state: a ride changes one total, and nothing that was stored is read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rideledger.functions.keys import VERTICAL_PER_LIFT
from rideledger.operators import rides
from rideledger.rules import DEFAULT, Bounds
from rideledger.schemas import RESORT_DAY, SKIER_DAY
from rideledger.sources.files import ride_stream
from rideledger.streaming.jobs import in_rocksdb, run, write_batch

TOTALS = "resortID string, seasonID string, dayID string, skierID string, totalVertical bigint"


#: Parts of the persons of a resort's day: one part's state is read and written together.
PARTS = 64


class DayTotals(StatefulProcessor):
    """For some persons' day at a resort: the latest ride of each person and minute, as lists of skierID, minute, ingest_seq and liftID.

    A day has as many minutes as rides may have and there are as many persons as may be, so a part's state is bounded. Asking
    for it costs the same for one person and for many, so persons share it. A ride counts if it is later than the one that its
    minute has; what was counted for that one is taken back. So rides may come late, again, and in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rides = handle.getValueState("rides", "skiers array<string>, minutes array<int>, seqs array<bigint>, lifts array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        skiers, minutes, seqs, lifts = self.rides.get() if self.rides.exists() else ([], [], [], [])
        latest = {(skier, minute): (seq, lift) for skier, minute, seq, lift in zip(skiers, minutes, seqs, lifts, strict=True)}
        before: dict[str, int] = {}
        for (skier, _), (_, lift) in latest.items():
            before[skier] = before.get(skier, 0) + lift
        after, newer = dict(before), False
        for batch in rows:
            for skier, minute, seq, lift in zip(*(batch[c].tolist() for c in ("skierID", "time", "ingest_seq", "liftID")), strict=True):
                known = latest.get((skier, minute))
                if known is None or seq > known[0]:
                    latest[skier, minute], newer = (seq, lift), True
                    after[skier] = after.get(skier, 0) + lift - (known[1] if known else 0)
        if newer:
            self.rides.update(([s for s, _ in latest], [m for _, m in latest], [s for s, _ in latest.values()], [x for _, x in latest.values()]))
        changed = {skier: total for skier, total in after.items() if total != before.get(skier)}
        if changed:
            place = dict(zip(RESORT_DAY, key, strict=False))
            yield pd.DataFrame({**place, "skierID": list(changed), "totalVertical": [total * VERTICAL_PER_LIFT for total in changed.values()]})

    def close(self) -> None:
        pass


def day_vertical(spark: SparkSession, source: str, work: str, bounds: Bounds = DEFAULT, files_per_batch: int = 1, parts: int = PARTS) -> DataFrame:
    """Day verticals, each batch writing the totals that it changes to work/totals; a read takes the last one of each.

    State is as large as the current rides, as rides of any day are taken at any time; it lies in RocksDB and the checkpoint.
    A checkpoint is read with the parts that it was made with.
    """
    valid = rides.valid(ride_stream(spark, source, files_per_batch), bounds)
    dealt = valid.withColumn("part", F.pmod(F.xxhash64("skierID"), F.lit(parts)).cast("int"))
    with in_rocksdb(spark):
        changed = dealt.groupBy(*RESORT_DAY, "part").transformWithStateInPandas(DayTotals(), TOTALS, "Update", "None")
        run(changed, "update", work, lambda df, n: write_batch(df, f"{work}/totals", n))
    found = spark.read.schema(f"{TOTALS}, batch_id bigint").parquet(f"{work}/totals")
    return found.groupBy(*SKIER_DAY).agg(F.max_by("totalVertical", "batch_id").alias("totalVertical"))
