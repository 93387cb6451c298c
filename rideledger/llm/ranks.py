"""Positions of rows in their groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rideledger.llm.common import free, stored

#: monotonically_increasing_id() counts a partition's rows in the low bits.
_ROW_BITS = 33


def ranked(df: DataFrame, group: str, order: list[str], idx: str = "idx", n: str = "n") -> DataFrame:
    """df plus idx (position from 0 in the row's group by order, nulls first) and n (rows of the group), both long.

    Rows are dealt in ranges of (group, order), so a large group lies in many; each range knows its rows' places in it and
    starts after the rows that the ranges before it have of the group. The places are written with the rows, so a lost
    executor changes none. group has no nulls; rows that tie in all of order get different places, in any order. df is
    read twice (once to find the ranges) and should be a stored table. Columns
    named idx and n give way to the new ones.
    """
    keys, columns = [group, *[c for c in order if c != group]], [c for c in df.columns if c not in (idx, n)]
    at, part, rows, first, shift = free([*columns, idx, n], "__at", "__part", "__rows", "__first", "__shift")
    dealt = df.select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn(at, F.monotonically_increasing_id()))
    of_part = F.shiftright(at, _ROW_BITS).alias(part)
    held = placed.groupBy(group, of_part).agg(F.count("*").alias(rows), F.min(at).alias(first))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(group, part, (F.coalesce(F.sum(rows).over(before), F.lit(0)) - F.col(first)).alias(shift), F.sum(rows).over(of_group).alias(n))
    joined = placed.select("*", of_part).join(starts, [group, part])
    return joined.select(*columns, (F.col(at) + F.col(shift)).alias(idx), n)
