"""Document fingerprints by consistent weighted sampling of term counts.

A text's terms are its words, weighted by their counts. A count over CHUNK is split into chunks of CHUNK and a rest,
each an element of its own: that leaves the sums of smaller and of larger weights of two texts as they are. Every
element draws, from its own hash, r and c from Gamma(2, 1) and b from (0, 1). With its weight w it takes
t = floor(ln w / r + b) and the level ln a = ln c - r (t - b) - r; the element of least a is the sample, (element, t)
its value. Two weighted sets of one bin draw the same value with a probability equal to their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.

One sample for each of BINS bins of elements, not BINS samples of all elements: an element is looked at once, whatever
BINS is, which is what keeps the whole in the JVM's built-in functions at this price. Chunks keep the bins' weights
alike, so that the mean over bins stays an estimate of the whole, with a small bias (README has it measured). Bins that are empty on both sides say nothing; the
likeness is the share of equal values among the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideledger.llm.common import SPACES, broadcast_checked, let, stored, table

#: Bins and bits of a value; with 7 and 13, five hex digits hold both.
BIN_BITS, VALUE_BITS = 7, 13
#: The largest weight of an element. Weights are 1 to CHUNK.
CHUNK = 2
#: Bits of an element's hash that choose its draw of (r, c, b), out of as many equally likely ones.
DRAW_BITS = 12
#: Documents that one range of ids is meant to hold.
RANGE_ROWS = 1024
#: Ranges up to this number are broadcast (three numbers each) to pick their first rows; above it, a shuffled join.
BROADCAST_RANGES = 1_000_000
#: How often ranges with many rows are cut again.
MAX_LEVELS = 6
_DIGITS = (BIN_BITS + VALUE_BITS) // 4


def gamma_levels(n: int = 2**DRAW_BITS) -> np.ndarray:
    """Gamma(2, 1) at n equally likely levels: where its distribution function 1 - (1 + x) exp(-x) is (i + 1/2) / n."""
    want = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(70):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < want
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high


def draw_table(weight: int, n: int = 2**DRAW_BITS) -> np.ndarray:
    """For each draw, what an element of this weight makes of it: ln a as 40 bits in order, then VALUE_BITS that tell t.

    The draws are the points of a lattice in the unit cube, so that every pair and triple of r, c and b comes up evenly.
    """
    i = np.arange(n, dtype=np.int64)
    gamma = gamma_levels(n)
    r, c, b = gamma[i], gamma[i * 1231 % n], ((i * (1231 * 1231 % n) % n) + 0.5) / n
    t = np.floor(np.log(weight) / r + b)
    # ln a lies between -96 and 32: r and c are between 0.01 and 12, t - b at most ln w / r.
    level = np.log(c) - r * (t - b) - r + 96
    return ((level * 2.0**33).astype(np.int64) << VALUE_BITS) | (t.astype(np.int64) * 5417 & (2**VALUE_BITS - 1))


def _sample(element: Column, weight: Column, tables: list[Column]) -> Column:
    """Bin, ln a and value of an element as one long, so that a sort has each bin's least a first."""
    draw = element.bitwiseAND(F.lit(2**DRAW_BITS - 1).cast("long")).cast("int")
    drawn = F.get(tables[-1], draw)
    for w in range(len(tables) - 1, 0, -1):
        drawn = F.when(weight == w, F.get(tables[w - 1], draw)).otherwise(drawn)
    bin_ = F.shiftleft(F.shiftrightunsigned(element, 64 - BIN_BITS), 40 + VALUE_BITS)
    value = F.shiftrightunsigned(element, 24).bitwiseAND(F.lit(2**VALUE_BITS - 1).cast("long"))
    return bin_.bitwiseOR(drawn.bitwiseXOR(value))


def signature(text: Column) -> Column:
    """The text's samples, an int of bin and value for each bin that has elements, in order of bins. No words: no samples."""
    tables = [F.lit(draw_table(w)) for w in range(1, CHUNK + 1)]
    terms = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))

    def counted(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i).otherwise(F.lit(-1))), lambda i: i >= 0
        )
        pair = lambda term, count: F.struct(term.alias("term"), count.alias("count"))
        runs = let(starts, lambda at: F.transform(at, lambda p, i: pair(F.get(s, p), F.coalesce(F.get(at, i + 1), F.size(s)) - p)))
        return let(runs, elements)

    def elements(runs: Column) -> Column:
        first = F.transform(runs, lambda e: _sample(e["term"], e["count"], tables))
        heavy = F.filter(runs, lambda e: e["count"] > CHUNK)
        chunk = lambda e, j: _sample(F.xxhash64(e["term"], j), e["count"] - j * CHUNK, tables)
        chunks = lambda e: F.transform(F.sequence(F.lit(1), F.floor((e["count"] - 1) / CHUNK).cast("int")), lambda j: chunk(e, j))
        return F.concat(first, F.flatten(F.transform(heavy, chunks)))

    def firsts(s: Column) -> Column:
        bin_ = lambda x: F.shiftrightunsigned(x, 40 + VALUE_BITS)
        keep = F.filter(s, lambda x, i: (i == 0) | (bin_(F.get(s, i - 1)) != bin_(x)))
        return F.transform(keep, lambda x: F.shiftleft(bin_(x), VALUE_BITS).bitwiseOR(x.bitwiseAND(F.lit(2**VALUE_BITS - 1).cast("long"))).cast("int"))

    return let(F.sort_array(let(F.sort_array(terms), counted)), firsts)


def printed(signature: Column) -> Column:
    """A signature as text, five hex digits a sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), _DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of the texts of two signatures; of two without words, 1."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, VALUE_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _id_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with range (an array of longs: the higher, the earlier its rows), so that few ranges have more than about RANGE_ROWS rows.

    Equal widths from the lowest to the highest id; a range that still has many more rows is cut again by its own lowest
    and highest, and so on, as one far id would otherwise leave all others in one range. Rows without an id, or with one
    that very many rows have, are dealt by the hash of their text.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    none = F.col("doc_id").isNull()
    whole = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    low, high, n = int(whole["low"] or 0), int(whole["high"] or 0), max(1, whole["n"])
    width = max(1, -(-(high - low + 1) * RANGE_ROWS // n))
    first = F.when(none, -1 - F.shiftright("tie", 51)).otherwise(F.expr(f"cast((cast(doc_id as decimal(20,0)) - {low}) div {width} as bigint)"))
    out, levels = docs.withColumn("range", F.array(first)), 1
    while levels < MAX_LEVELS:
        sizes = out.filter(~none).groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        heavy = sizes.filter(F.col("n") > 4 * RANGE_ROWS)
        step = F.expr(f"greatest(1, (cast(high as decimal(20,0)) - cast(low as decimal(20,0)) + n div {RANGE_ROWS}) div (n div {RANGE_ROWS}))")
        heavy = stored(heavy.select("range", wide("low").alias("low"), wide("high").alias("high"), step.cast("decimal(20,0)").alias("step")))
        if heavy.isEmpty():
            break
        finer = F.when(F.col("low") == F.col("high"), -1 - F.shiftright("tie", 51)).otherwise(F.expr("cast((cast(doc_id as decimal(20,0)) - low) div step as bigint)"))
        joined = out.join(broadcast_checked(heavy, BROADCAST_RANGES), "range", "left")
        more = F.when(F.col("low").isNull() | none, F.lit(0).cast("long")).otherwise(finer)
        out = joined.withColumn("range", F.concat("range", F.array(more))).drop("low", "high", "step")
        levels += 1
    return out, levels


def with_next(docs: DataFrame, derive=lambda df: df, carried: tuple[str, ...] = ("text",)) -> DataFrame:
    """derive(docs) plus next_<c> for each c of carried: the columns of the row that follows by doc_id, downwards, from the last to the first.

    docs has doc_id and text without nulls; derive adds columns row by row. Rows of equal doc_id go by the hash of their
    text; null ids come last, by that hash too. Ids are cut into ranges, each sorted by its own task; only the first row
    of a range is sent on, to the range before it, found by its id and hash alone before anything is derived from it.
    """
    slim = docs.select("doc_id", "text").withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    ranged, levels = _id_ranges(slim)
    derived = derive(ranged)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    rows = derived.withColumn("following", F.lead(F.struct(*carried)).over(order))
    # The first row of each range, by its id and hash alone.
    first = F.min(F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie"))
    heads = stored(ranged.select("range", "doc_id", "tie").groupBy("range").agg(first.alias("h")))
    heads = heads.select("range", (-F.col("h.down")).cast("long").alias("h_id"), F.col("h.tie").alias("h_tie"))
    # The range that follows each range: the next lower one that has rows, round to the highest.
    inner = Window.partitionBy("block").orderBy(F.col("range").desc())
    inside = heads.withColumn("block", F.floor(F.get("range", F.lit(0)) / 1024)).withColumn("inner", F.lead("range").over(inner))
    blocks = inside.groupBy("block").agg(F.max("range").alias("top"))
    around = Window.orderBy(F.col("top").desc())
    blocks = blocks.withColumn("outer", F.coalesce(F.lead("top").over(around), F.max("top").over(Window.partitionBy())))
    follow = inside.join(blocks.select("block", "outer"), "block").select(F.col("range").alias("f_range"), F.coalesce("inner", "outer").alias("f_next"))
    wanted = follow.join(heads.withColumnRenamed("range", "h_range"), F.col("f_next") == F.col("h_range")).select("f_range", "h_id", "h_tie")
    picked = slim.join(broadcast_checked(stored(wanted), BROADCAST_RANGES), (F.col("tie") == F.col("h_tie")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    heads = derive(picked.dropDuplicates(["f_range"])).select("f_range", F.struct(*carried).alias("head"))
    out = rows.join(broadcast_checked(stored(heads), BROADCAST_RANGES // 1000), F.col("range") == F.col("f_range")).withColumn("after", F.coalesce("following", "head"))
    return out.select(*[c for c in derived.columns if c not in ("tie", "range")], *[F.col("after")[c].alias(f"next_{c}") for c in carried])


def edited(text: Column, after: Column) -> Column:
    """text with its last third of code points, rounded down, replaced by as many of the first of after, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(after, F.lit(1), third))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's fingerprint, its edited text's, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = lambda df: df.withColumn("signature", signature(F.col("text")))
    pairs = with_next(docs, signed, ("text", "signature")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_signature", signature(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("signature")).alias("fingerprint"),
        printed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
