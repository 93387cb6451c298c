"""Reports over request latencies: (start_ms, end_ms, request_type, latency_ms, response_code, phase, ...)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def milliseconds(start_ns: Column, end_ns: Column) -> Column:
    """Whole milliseconds between two clock readings in nanoseconds, cut off."""
    return F.call_function("div", end_ns - start_ns, F.lit(1_000_000).cast("long"))


def outcome(state: Column, code: Column) -> Column:
    """The code a request ends with: its own, 500 after a failure of the connection, 499 where it was cancelled."""
    return F.when(state == "failed", F.lit(500)).when(state == "cancelled", F.lit(499)).otherwise(code)


def succeeded(code: Column) -> Column:
    return F.coalesce((code >= 200) & (code < 300), F.lit(False))


#: Values that one task puts in order.
RANGE_VALUES = 4096


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Rows of two sides that agree in columns, nulls too."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def ranks(counts: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """(by, name, value): of each group's values in order, those at the places from 0 that wanted (by, name, place) asks for.

    counts (by, value, c) has how often each value occurs. Values lie in ranges; sums of the ranges before it tell which range
    a place is in, and only the values of such ranges are put in order. No task holds a group's values, or a buffer of them.
    """
    ranged = counts.withColumn("range", F.floor(F.col("value") / RANGE_VALUES).cast("bigint"))
    before = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*by, "range").agg(F.sum("c").alias("in_range"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("in_range").over(before(by, "range")), F.lit(0)))
    # A few places for each group, each in one range.
    place, start = F.col("w.place"), F.col("r.start")
    inside = (place >= start) & (place < start + F.col("r.in_range"))
    found = ranges.alias("r").join(wanted.alias("w"), _same("r", "w", by) & inside)
    found = found.select(*[F.col(f"w.{c}") for c in by], "w.name", "r.range", (place - start).alias("left"))
    needed = found.select(*by, "range").distinct()
    some = ranged.alias("v").join(needed.alias("n"), _same("v", "n", [*by, "range"]), "left_semi")
    some = some.withColumn("below", F.coalesce(F.sum("c").over(before([*by, "range"], "value")), F.lit(0)))
    at, low = F.col("f.left"), F.col("s.below")
    hit = some.alias("s").join(found.alias("f"), _same("s", "f", [*by, "range"]) & (at >= low) & (at < low + F.col("s.c")))
    return hit.select(*[F.col(f"f.{c}") for c in by], "f.name", "s.value")


def summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median (cut to a whole number), nearest-rank 99th percentile, least and most; no records give no row.

    All of it comes from how often each latency occurs. The median of an even number is the mean of the two in the middle.
    """
    counts = records.groupBy(*by, F.col("latency_ms").alias("value")).agg(F.count("*").alias("c"))
    known = F.when(F.col("value").isNotNull(), F.col("c"))
    whole = counts.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.sum(known).alias("m"),
        F.round(F.sum(F.col("value") * F.col("c")) / F.sum(known), 6).alias("mean_ms"),
        F.min("value").alias("min_ms"),
        F.max("value").alias("max_ms"),
    )
    places = {"low": "(m - 1) div 2", "high": "m div 2", "p99": "(99 * m + 99) div 100 - 1"}
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(e).alias("place")) for k, e in places.items()]))
    wanted = whole.where("m > 0").select(*by, asked.alias("p")).select(*by, "p.name", "p.place")
    found = ranks(counts.where("value is not null"), by, wanted).groupBy(*by)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    middle = found.agg(F.floor((of("low") + of("high")) / 2).cast("bigint").alias("median_ms"), of("p99").cast("bigint").alias("p99_ms"))
    out = whole.alias("a").join(middle.alias("b"), _same("a", "b", by), "left")
    return out.select(*[F.col(f"a.{c}") for c in by], "n", "mean_ms", "median_ms", "p99_ms", "min_ms", "max_ms")


def two_decimals(number: Column) -> Column:
    """A number as text with two decimals, half of the last one up."""
    return F.format_string("%.2f", number.cast("double"))


def report(records: DataFrame, by: list[str]) -> DataFrame:
    """The mean as the reports print it."""
    return records.groupBy(*by).agg(F.count("*").alias("n"), two_decimals(F.avg("latency_ms")).alias("mean_text"))


def outcomes(records: DataFrame, by: list[str]) -> DataFrame:
    good = succeeded(F.col("response_code"))
    return records.groupBy(*by).agg(F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_failure"))


def throughput(records: DataFrame) -> DataFrame:
    """Requests a second by phase, and over all (phase null), from the first start to the last end."""
    seconds = (F.max("end_ms") - F.min("start_ms")) / 1000
    return records.rollup("phase").agg(F.count("*").alias("n"), F.round(F.count("*") / seconds, 6).alias("per_second"))


#: Ticks that one task sums in order.
RANGE_TICKS = 4096


def gauge(records: DataFrame, tick_ms: int) -> DataFrame:
    """(phase, tick, active): how many requests were open at each tick of a phase, 0 included.

    A request is open from its start until before its end; one between two ticks is open at none. Each adds one at its
    first tick and takes one after its last, however long it lasts; running sums are taken in ranges of ticks, each
    beginning with the sum of the ranges before it.
    """
    first = F.ceil(F.col("start_ms") / tick_ms).cast("bigint")
    last = F.call_function("div", F.col("end_ms") - 1, F.lit(tick_ms).cast("long"))
    spans = records.select("phase", first.alias("first"), last.alias("last"))
    ends = spans.groupBy("phase").agg(F.min("first").alias("from"), F.max("last").alias("to")).where("`from` <= `to`")
    steps = F.array(F.struct(F.col("first").alias("tick"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("tick"), F.lit(-1).alias("d")))
    deltas = spans.where("first <= last").select("phase", F.explode(steps).alias("s")).groupBy("phase", "s.tick").agg(F.sum("s.d").alias("d"))
    of = lambda tick: F.floor(tick / RANGE_TICKS).cast("bigint")
    ranges = ends.select("phase", "from", "to", F.explode(F.sequence(of(F.col("from")), of(F.col("to")))).alias("range"))
    low, high = F.greatest("from", F.col("range") * RANGE_TICKS), F.least("to", (F.col("range") + 1) * RANGE_TICKS - 1)
    spine = ranges.select("phase", "range", F.explode(F.sequence(low, high)).alias("tick"))
    change = deltas.groupBy("phase", of(F.col("tick")).alias("range")).agg(F.sum("d").alias("change"))
    before = Window.partitionBy("phase").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("change").over(before), F.lit(0)).alias("start")
    starts = ranges.select("phase", "range").join(change, ["phase", "range"], "left").select("phase", "range", start)
    inside = Window.partitionBy("phase", "range").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(deltas, ["phase", "tick"], "left").join(starts, ["phase", "range"])
    return out.select("phase", "tick", (F.col("start") + F.coalesce(F.sum("d").over(inside), F.lit(0))).alias("active"))


def littles_law(records: DataFrame, tick_ms: int) -> DataFrame:
    """Mean open requests over mean latency in seconds, by phase and over all (phase null): requests a second."""
    open_ = gauge(records, tick_ms).rollup("phase").agg(F.avg("active").alias("avg_active"))
    time = records.rollup("phase").agg((F.avg("latency_ms") / 1000).alias("avg_s"))
    both = time.alias("t").join(open_.alias("o"), F.col("t.phase").eqNullSafe(F.col("o.phase")), "left")
    active = F.coalesce("avg_active", F.lit(0.0))
    return both.select("t.phase", F.round(active, 6).alias("avg_active"), F.round(F.when(F.col("avg_s") > 0, active / F.col("avg_s")), 6).alias("per_second"))
