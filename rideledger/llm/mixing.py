"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Documents of a source are put in a hash-random order. Targets are shared out by weight, with a ceiling of
`max_epochs` times a source's own size. A source gives whole passes over its documents while its target lasts and,
in the last pass, its documents from the front of that order up to the exact word of its budget.

The prefix sums are distributed: the order is cut into key ranges, each of which sorts and sums its own rows, and a
range starts at the sum of the ranges before it. No task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideledger.llm.common import broadcast_checked, checkpoint, n_words, packed, table, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows of a source that one key range is meant to hold.
RANGE_ROWS = 4096
#: Sources up to this number are broadcast; their table has one short row a source.
BROADCAST_SOURCES = 10_000


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A hash of the document id (of the text where it has none) as fixed-width hex, so that text order is the random order."""
    none = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none)))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size, ...) plus weight and target, one row a source.

    Sources in code-point order, null last, take the weights in turn. All sizes are shared out by weight; a source
    stops at max_epochs times its size and the excess goes to the others by weight, until none is above. That is
    the level L at which min(max_epochs * size, L * weight) adds up to the total: with sources by the level at which
    they fill up, the first k are full for the smallest k whose level leaves the rest below their ceilings.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = ranked.withColumn("fills_at", F.col("ceiling") / F.col("weight"))
    everything = Window.partitionBy()
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    ranked = ranked.withColumn("rank", F.row_number().over(filling)).withColumn(
        "level",
        (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    first = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("rank", "level"))).over(everything)
    ranked = ranked.withColumn("full", F.col("rank") < first["rank"]).withColumn("final", first["level"])
    return ranked.withColumn(
        "target", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("final") * F.col("weight"))
    ).drop("ceiling", "fills_at", "rank", "level", "full", "final")


#: A row's part, rounded down, of what a key takes: in whole numbers, as doubles and quotients of decimals would round.
_PART = "(cast({0} as decimal(19,0)) * cast({1} as decimal(19,0))) div cast({2} as decimal(38,0))"


def _ranges(key: Column, n: Column) -> Column:
    """Which of n equal ranges of the hash space a hex key lies in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of the mix of docs (doc_id, source, text).

    rows: doc_id, source, size, source_size, target, taken, one for each row of docs. sources: source, source_size,
    target, epochs, rest, cut_key, cut_before, cut_size: rows with a key below cut_key are taken in the last pass,
    those at cut_key share what is left of rest after cut_before.

    Rows of a source with the same doc_id (or without one, and with the same text) have the same key and share a cut in
    proportion to their sizes, rounded down. Null texts have size 0; a null source is a source; no rows give no rows.
    Documents may be any number, sources as many as one task sorts: their targets depend on each other.
    """
    slim = checkpoint(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    shares = checkpoint(
        targets(sizes, weights, max_epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_ranges", F.ceil(F.col("n_rows") / RANGE_ROWS).cast("long"))
        .drop("weight", "budget", "n_rows")
    )
    small = broadcast_checked(shares, BROADCAST_SOURCES)
    placed = (
        slim.alias("r")
        .join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.*", "s.source_size", "s.target", "s.epochs", "s.rest", "s.n_ranges")
        .withColumn("range", _ranges(F.col("key"), F.col("n_ranges")))
    )
    front = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(front), F.lit(0)))
        .select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "start")
    )
    inside = Window.partitionBy("source", "range").orderBy("key")
    sums = (
        placed.withColumn("upto", F.sum("size").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("at_key", F.sum("size").over(Window.partitionBy("source", "range", "key")))
        .join(starts, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .withColumn("before", F.col("start") + F.col("upto") - F.col("at_key"))
    )
    share = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("at_key"))
    sums = sums.withColumn("share", share)
    last = F.when(F.col("at_key") == 0, F.lit(0)).otherwise(F.expr(_PART.format("share", "size", "at_key")))
    rows = sums.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), "key", "before", "at_key", "rest"
    )
    cuts = (
        rows.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("at_key") >= F.col("rest")))
        .groupBy(F.col("source").alias("c_source"))
        .agg(F.min("key").alias("cut_key"), F.min("before").alias("cut_before"), F.max("at_key").alias("cut_size"))
    )
    sources = shares.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "n_ranges")
    return rows.drop("key", "before", "at_key", "rest"), sources


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: docs with its own columns, each row as often as its source's passes take it.

    The document at which a budget ends is cut after its last word within the budget, so that a source has just the
    words that plan() says. Rows without words add nothing to a budget and are left out, null texts among them. Texts are
    never shuffled: each row is compared with its source's cut where it is read. Columns may have any names.
    """
    _, sources = plan(docs.select("doc_id", "source", "text"), weights, max_epochs, seed)
    cut = broadcast_checked(checkpoint(sources), BROADCAST_SOURCES)
    rows = packed(docs, "doc_id", "source", "text").withColumn("key", random_key(F.col("doc_id"), F.col("text"), seed))
    rows = rows.withColumn("size", n_words(F.col("text"))).filter("size > 0").alias("d")
    joined = rows.join(
        cut.select(F.col("source").alias("c_source"), "epochs", F.col("rest").alias("c_rest"), "cut_key", "cut_before", "cut_size"),
        F.col("d.source").eqNullSafe(F.col("c_source")),
    ).drop("c_source")
    # Words of the last pass: none, all, or the row's part of what is left at the cut.
    last = (
        F.when((F.col("c_rest") <= 0) | F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), F.col("size"))
        .otherwise(F.expr(_PART.format("least(c_rest - cut_before, cut_size)", "size", "cut_size")))
    )
    joined = joined.withColumn("last", last.cast("int"))
    # A word with the white space after it; white space before the first word goes with that word.
    pieces = F.split(F.col("text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    passes = F.array_repeat(F.lit(None).cast("int"), F.col("epochs").cast("int"))
    whole = F.array_repeat(F.lit(None).cast("int"), F.col("epochs").cast("int") + 1)
    copies = F.when(F.col("last") == F.col("size"), whole).when(F.col("last") > 0, F.concat(passes, F.array("last"))).otherwise(passes)
    text = F.when(F.col("n_taken").isNull(), F.col("text")).otherwise(F.rtrim(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("n_taken") + lead, F.lit(1))), "")))
    out = joined.withColumn("n_taken", F.explode(copies)).withColumn("cut_text", text)
    return out.select(*[(F.col("cut_text") if name == "text" else column).alias(name) for name, column in unpacked(out, docs)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with the words that the mix takes of it."""
    rows, _ = plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


#: The same in SQL: the water level over sources, then a running sum over each source's hash order.
ORACLE = rf"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS ceiling FROM sizes),
levels AS (
  SELECT *, ceiling / weight AS fills_at, row_number() OVER (ORDER BY ceiling / weight, source NULLS LAST) AS rank,
         (sum(source_size) OVER () - coalesce(sum(ceiling) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked
  WINDOW b AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min(rank) AS k, arg_min(level, rank) AS l FROM levels WHERE level <= fills_at),
shares AS (
  SELECT source, source_size, CASE WHEN rank < k THEN ceiling ELSE l * weight END AS target FROM levels, final),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM shares),
sums AS (
  SELECT s.*, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE UNBOUNDED PRECEDING)
         - sum(s.size) OVER (PARTITION BY s.source, s.key) AS before,
         sum(s.size) OVER (PARTITION BY s.source, s.key) AS at_key
  FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN at_key = 0 THEN 0
        ELSE (least(greatest(rest - before, 0), at_key)::HUGEINT * size) // at_key END)::BIGINT AS taken
FROM sums
"""
