"""Near-duplicate lines by a deletion neighbourhood: every line's variants meet as hashed keys, the earliest line stays.

A line is its sequence of words; white space does not count. Two lines are near when they are equal or when few words
added, left out or replaced turn one into the other: with Bounds, one for every `words_an_edit` words of the shorter line,
and one at least, for lines of `min_words` words and more. If a line is shorter than that, one character added, left out
or replaced makes it near (of the words with one space between, `min_chars` characters at least). An occurrence of a line
goes if an equal one comes earlier, or if the line is near one that comes earlier anywhere, whether or not that one stays.
Earlier is by doc_id (null last), text hash, line number.

With one edit the neighbourhood of a line is the line itself and the line without each of its words. Lines that differ by
a replaced word share a variant with the word gone at the same place, so the earliest of all that have a (variant, place)
stands for them; a longer line's variant is a shorter line itself. Both are minima over keys, so a key with very many
lines makes no pairs. What they propose is verified word by word. Only lines that can have a neighbour get variants:
within one edit, the first or the last half of the shorter line is untouched, so a line that shares neither half, for its
own length or the length below, with another line is near none. Lines of few words go the same way as sequences of
characters.

With more edits a line would have a variant for every choice of words left out. What all these variants keep stands for
them. Lines are cut into segments after words that end in certain letters, so that an edit touches two segments at most.
Of a line that may have k edits the first segments in one order of all segments, longest first, are the keys: so many
that k + 1 of them are no neighbours, or 2k + 1. One of them stays whole, so of two near lines the one whose last key comes first has one that is among the other's too.
Lines of few segments (3k at most, as near lines of 2k then have) also have keys of runs of `run` words, in the order of
their hashes, until more of them lie apart than the line may have edits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideledger.llm.common import SPACE_BYTES, broadcast_checked, let, packed, stored, table, unpacked, words


@dataclass(frozen=True)
class Bounds:
    """How far apart near lines may be. Lines of 2 * words_an_edit words may have two edits, and so on; shorter ones one."""

    min_words: int = 5
    min_chars: int = 10
    words_an_edit: int = 20

    @property
    def long(self) -> int:
        """Words from which on a line may have more edits than one."""
        return 2 * self.words_an_edit

    @property
    def run(self) -> int:
        """Words of a run: so few that any k runs leave another one apart from them in a line that may have k edits."""
        return max(1, min(6, (2 * self.words_an_edit + 2) // 5))


BOUNDS = Bounds()
#: Lines at a key above which they also have to meet by length and place.
MANY_LINES = 10
#: Where lines are cut: after words that end so. About a quarter of words; with fewer cuts lines go by runs.
_CUT = r" (?<=[dntoDNTO.] )"  # the blank first, as it rules out most places
#: Bits of a key for its place within its line, for a segment's length, and for the hash.
PLACE_BITS, LENGTH_BITS = 15, 8
#: Suspect lines, or hashes that two lines share, up to this number are broadcast (50 bytes each); above it, a shuffled join.
BROADCAST_LINES = 1_000_000


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, place (hash of the text), blanks (whether the text has any that spaced() looks for), line_no, line of every line of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # In a step of its own, as what stands beside posexplode is computed anew for each line.
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("place"), _blanks(text).alias("blanks"))
    return texts.select("doc_id", "place", "blanks", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _ids(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2")


def _ends(w: Column) -> Column:
    """Hashes by which a line's possible neighbours are found: its first and last words, half as many as the shorter of
    two lines has, for the line as the shorter or equal one and as the longer one."""
    def halves(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit(0), n, F.slice(w, F.lit(1), half)), F.xxhash64(F.lit(1), n, F.slice(w, -half, half))]

    n = F.size(w)
    return F.array(*halves(n), *halves(n - 1))


def _word_ends(line: Column, n: Column) -> Column:
    """As _ends, of the n words of a line that is spaced: its text up to a blank and from a blank on, without a list of words."""
    def halves(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")
        upto = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
        return [F.xxhash64(F.lit(0), n, upto(half)), F.xxhash64(F.lit(1), n, upto(-half))]

    return F.array(*halves(n), *halves(n - 1))


def _chars(line: Column) -> Column:
    """The characters of a line, each marked so that none equals a word."""
    return F.transform(F.split(line, ""), lambda x: F.concat(F.lit(" "), x))


def _blanks(text: Column) -> Column:
    """Whether there are other blanks within lines than single spaces."""
    return reduce(Column.__or__, [F.contains(text, F.lit(blank)) for blank in ("  ", "\t", "\x0b", "\x0c", "\r")])


def spaced(line: Column, blanks: Column | None = None) -> Column:
    """The words of a line with one space between. Most lines are that already, which a look for bytes tells; none is
    needed where blanks, _blanks() of the whole text, is false."""
    line = F.coalesce(line, F.lit(""))
    within = _blanks(line) if blanks is None else blanks & _blanks(line)
    other = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | within
    return F.when(other, F.array_join(words(line), " ")).otherwise(line)


def _size(line: Column) -> Column:
    """How many words a line has that is spaced."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _by_words(n: Column, b: Bounds) -> Column:
    """Whether a line is compared by words, with one edit; the shortest line of more edits may be one word longer than its neighbour."""
    return (n >= b.min_words) & (n <= b.long)


def _by_chars(n: Column, line: Column, b: Bounds) -> Column:
    """Whether a line of few words, or one with a word more, is compared by characters."""
    return (n > 0) & (n <= b.min_words) & (F.char_length(line) >= b.min_chars)


def _many(n: Column, b: Bounds) -> Column:
    """Whether a line may have more edits than one."""
    return n >= b.long


_PLACE = (1 << PLACE_BITS) - 1
_HASH = (1 << (63 - PLACE_BITS - LENGTH_BITS)) - 1


def _edits(n: Column, b: Bounds) -> Column:
    return F.floor(n / b.words_an_edit).cast("int")


def _placed(rank: Column, hash_: Column, i: Column) -> Column:
    """Rank (the lower the earlier), some bits of a hash, and a place (within its bits' range) as one long."""
    high = F.shiftleft(rank.cast("long"), 63 - LENGTH_BITS).bitwiseOR(hash_.bitwiseAND(F.lit(_HASH << PLACE_BITS)))
    return high.bitwiseOR(i.cast("long"))


def _key_of(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE)).cast("int")


def _segments(line: Column) -> Column:
    """A line's segments in their order, each as one long; longest first, but those of 256 bytes and more as their length's
    last bits say. Runs have a rank of their own."""
    # The complement of a length has the sign bit set, and is the lower the longer the segment is.
    one = lambda x, i: _placed(F.bitwise_not(F.octet_length(x)), F.xxhash64(x), i)

    def all_segments(parts: Column) -> Column:
        placed = F.when(F.size(parts) <= _PLACE, F.transform(parts, one))
        return F.sort_array(placed.otherwise(F.transform(parts, lambda x, i: one(x, F.least(i, F.lit(_PLACE))))))

    return let(F.split(line, _CUT), all_segments)


def _apart(keys: Column, bound: Column, near, few: Column) -> Column:
    """Of keys in their order, those up to the one with which more than `bound` of the few first lie apart; all, where
    there is none. near(seen, place) tells whether a place is near one of those seen."""
    add = lambda seen, p: F.when((F.size(seen) > bound) | near(seen, p), seen).otherwise(F.array_append(seen, p))

    def kept(places: Column) -> Column:
        at = lambda seen: F.element_at(keys, F.array_position(places, F.element_at(seen, -1)).cast("int"))
        upto = lambda seen: F.when(F.size(seen) > bound, at(seen).bitwiseOR(F.lit(_PLACE))).otherwise(F.lit(2**63 - 1))
        last = let(F.aggregate(places, F.array().cast("array<int>"), add), upto)
        return let(last, lambda x: F.filter(keys, lambda y: y <= x))

    return let(F.transform(F.slice(keys, F.lit(1), few), _place_of), kept)


#: Edits up to which 64 bits hold the places of a line's segments.
_FEW_EDITS = 12


def _apart_segments(keys: Column, bound: Column) -> Column:
    """As _apart for segments, which must not be neighbours, with places as bits of a long.

    Places that share a bit are taken for neighbours, which can only make more keys.
    """
    # A place p has bit p + 1, so that it and its neighbours are three bits from p on; a place without a bit lies apart from none.
    bits = lambda few, x: F.call_function("shiftleft", F.lit(few).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    has = lambda seen, some: seen.bitwiseAND(some) != 0
    own = lambda x: bits(2, x)

    def add(seen: Column, x: Column) -> Column:
        return F.when((F.bit_count(seen) > bound) | has(seen, bits(7, x)), seen).otherwise(seen.bitwiseOR(own(x)))

    def upto(seen: Column) -> Column:
        last = F.array_max(F.filter(keys, lambda x: has(seen, own(x)))).bitwiseOR(F.lit(_PLACE))
        return F.when(F.bit_count(seen) > bound, last).otherwise(F.lit(2**63 - 1))

    return let(let(F.aggregate(keys, F.lit(0).cast("long"), add), upto), lambda last: F.filter(keys, lambda x: x <= last))


def _runs(line: Column, bound: Column, b: Bounds) -> Column:
    """Of a line's runs of words, as longs in their order, those that its edits can't all touch. Their rank is below that of segments."""
    last_rank = (1 << LENGTH_BITS) - 1
    # The words of a run are looked up one by one, as a slice for each is a list of its own.
    gram = lambda h, x, i: _placed(F.lit(last_rank), F.xxhash64(x, *[F.get(h, i + j) for j in range(1, b.run)]), F.least(i, F.lit(_PLACE)))
    all_runs = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - (b.run - 1)), lambda x, i: gram(h, x, i))
    near = lambda seen, p: F.exists(seen, lambda y: F.abs(p - y) < b.run)
    hashed = F.transform(F.split(line, " "), lambda x: F.xxhash64(x))
    # Where the few first runs don't hold enough that lie apart, all runs are keys.
    return let(F.sort_array(let(hashed, all_runs)), lambda runs: _apart(runs, bound, near, 6 * (bound + 1)))


def _long_keys(line: Column, n: Column, b: Bounds) -> Column:
    """The keys of a line that may have more edits than one, each with its place, as longs."""
    # Of segments that are no neighbours an edit touches one at most, so bound + 1 of these do as well as 2 * bound + 1.
    near = lambda seen, p: F.array_contains(seen, p) | F.array_contains(seen, p - 1) | F.array_contains(seen, p + 1)

    def keys(segments: Column, bound: Column) -> Column:
        apart = lambda x: F.when(bound <= _FEW_EDITS, _apart_segments(x, bound)).otherwise(_apart(x, bound, near, F.size(x)))
        first = let(F.slice(segments, F.lit(1), 2 * bound + 1), apart)
        return F.when(F.size(segments) <= 3 * bound, F.concat(first, _runs(line, bound, b))).otherwise(first)

    return let(_edits(n, b), lambda bound: let(_segments(line), lambda segments: keys(segments, bound)))


def _spans(keys: Column) -> Column:
    """Of a line's keys in their order, (run, lo, hi) of each different one: where it comes first and last.

    A line that repeats a few words hundreds of times has one span of them, so two such lines meet once and not at every
    two places.
    """
    other = lambda x, i: F.coalesce(_key_of(F.get(keys, i)) != _key_of(x), F.lit(True))
    low = F.filter(keys, lambda x, i: other(x, F.when(i > 0, i - 1)))
    high = F.filter(keys, lambda x, i: other(x, i + 1))
    return F.zip_with(low, high, lambda x, y: F.struct(_key_of(x).alias("run"), _place_of(x).alias("lo"), _place_of(y).alias("hi")))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "line_no")


def within_one(a: Column, b: Column) -> Column:
    """Whether at most one word added, left out or replaced turns a into b."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda x, skip: F.slice(x, at + skip, F.greatest(F.size(x), F.lit(1)))
    same = (F.size(a) == F.size(b)) & (rest(a, 1) == rest(b, 1))
    more = (F.size(a) == F.size(b) + 1) & (rest(a, 1) == rest(b, 0))
    less = (F.size(a) + 1 == F.size(b)) & (rest(a, 0) == rest(b, 1))
    return (at == 0) | same | more | less


def near_lines(suspects: DataFrame) -> DataFrame:
    """h1, h2 of the lines of suspects (h1, h2, first: order, w: words; a row for each line) that are near an earlier one."""
    hashes = F.transform("w", lambda x, i: F.xxhash64(x, i.cast("int")))
    own = F.transform("w", lambda x, i: F.xxhash64(x, (i + 1).cast("int")))
    xor = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    lines = suspects.select("h1", "h2", "w", F.size("w").alias("n"), xor(hashes).alias("shifted"), xor(own).alias("own"))
    each = lines.select("h1", "h2", "n", "shifted", F.posexplode("w").alias("i", "word"))
    upto = Window.partitionBy("h1", "h2").orderBy("i")
    before = F.coalesce(F.bit_xor(F.xxhash64("word", (F.col("i") + 1).cast("int"))).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    passed = F.bit_xor(F.xxhash64("word", F.col("i").cast("int"))).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    shorter = each.select("h1", "h2", before.bitwiseXOR(F.col("shifted").bitwiseXOR(passed)).alias("key"), (F.col("n") - 1).alias("size"), (F.col("i") + 1).alias("place"))
    whole = lines.select("h1", "h2", F.col("own").alias("key"), F.col("n").alias("size"), F.lit(0).alias("place"))
    made = stored(shorter.unionByName(whole))
    # Nearly every variant is its line's own; the rest of the work is for those that two lines have.
    shared = made.groupBy("key", "size").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key", "size")
    met = made.join(broadcast_checked(stored(shared), BROADCAST_LINES), ["key", "size"])
    variants = stored(met.join(suspects.select("h1", "h2", "first"), ["h1", "h2"]))
    line = F.struct("first", "h1", "h2")
    at_place = variants.groupBy("key", "size", "place").agg(F.min(line).alias("best"))
    at_key = at_place.groupBy("key", "size").agg(
        F.min(F.when(F.col("place") == 0, F.col("best"))).alias("short"), F.min(F.when(F.col("place") > 0, F.col("best"))).alias("long")
    )
    replaced = variants.filter("place > 0").join(at_place, ["key", "size", "place"])
    added = variants.join(at_key, ["key", "size"]).withColumn("best", F.when(F.col("place") > 0, F.col("short")).otherwise(F.col("long")))
    pick = lambda df: df.filter(F.col("best.first") < F.col("first")).select("h1", "h2", F.col("best.h1").alias("r1"), F.col("best.h2").alias("r2"))
    pairs = pick(replaced).unionByName(pick(added)).distinct()
    earlier = suspects.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("w").alias("v"))
    checked = pairs.join(suspects.select("h1", "h2", "w"), ["h1", "h2"]).join(earlier, ["r1", "r2"])
    return checked.filter(within_one(F.col("w"), F.col("v"))).select("h1", "h2").distinct()


def within_bound(a: Column, b: Column, words_an_edit: int) -> Column:
    """Whether a and b, of at least two edits' words, are near."""
    bound = F.floor(F.least(F.size(a), F.size(b)) / words_an_edit).cast("int")
    coded = lambda w: F.array_join(F.transform(w, lambda x: F.chr(F.pmod(F.xxhash64(x), F.lit(255)) + 1)), "")
    far = lambda x, y: F.call_function("levenshtein", x, y, bound) < 0
    differ = lambda: F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))

    def exact(every: Column) -> Column:
        """By the edit distance of texts with a character beyond the basic plane for each distinct word."""
        code = lambda x: F.lpad(F.hex(F.lit(1 << 16) + F.array_position(every, x)), 8, "0")
        text = lambda w: F.decode(F.unhex(F.array_join(F.transform(w, code), "")), "UTF-32")
        return ~far(text(a), text(b))

    # The cheap tests first: new words, words in their places, and a distance of hashes, which can only be too low.
    new = F.greatest(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))
    out = F.when(new > bound, F.lit(False)).when((F.size(a) == F.size(b)) & (differ() <= bound), F.lit(True))
    return out.when(far(coded(a), coded(b)), F.lit(False)).otherwise(let(F.array_distinct(F.concat(a, b)), exact))


def _bag(w: Column) -> Column:
    """For each of 64 kinds of words, by their hashes, whether their number is odd. An edit changes two of these bits at most."""
    kind = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(F.lit(3), x).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(kind(x)))


#: Longs of the finer bag that lines of WIDE_FROM edits and more have besides: 64 bits tell little of hundreds of words.
WIDE, WIDE_FROM = 8, 10


def _wide_bag(w: Column) -> Column:
    """As _bag, for WIDE * 64 kinds of words, as WIDE longs."""
    kinds = F.transform(w, lambda x: F.pmod(F.xxhash64(F.lit(5), x), F.lit(64 * WIDE)).cast("int"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)  # noqa: E731  (by x's last six bits)
    part = lambda all_kinds, q: F.aggregate(F.filter(all_kinds, lambda x: F.shiftright(x, 6) == q), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))
    return let(kinds, lambda all_kinds: F.array(*[part(all_kinds, q) for q in range(WIDE)]))


def _odd(a: Column, b: Column) -> Column:
    """In how many bits two wide bags differ; null where a line has none."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: By how many of their lowest keys lines are first compared with the earliest one.
FEW_KEYS = 2


def near_long_lines(suspects: DataFrame, runs: DataFrame, b: Bounds = BOUNDS) -> DataFrame:
    """h1, h2 of the lines of suspects (h1, h2, first: order, line: words with one space between, all _many) that are near an earlier one.

    runs has h1, h2 and runs (_long_keys) of each.

    Lines meet by key, once however often it repeats in them; at keys of many lines, by length and place too. Each is
    compared with the earliest at its lowest keys, and if it is near none of them, with all at all its keys. Only what length, place and bag of words allow is
    compared word by word.
    """
    # By let, as what lambdas take from outside them is computed anew for each of their elements.
    wide = lambda w: F.when(F.size(w) >= WIDE_FROM * b.words_an_edit, _wide_bag(w)).alias("wide")
    facts = let(F.split("line", " "), lambda w: F.struct(F.size(w).alias("n"), _bag(w).alias("bag"), wide(w)))
    spans = let(F.col("runs"), _spans)
    lines = stored(suspects.select("h1", "h2", "first", facts.alias("x")).join(runs, ["h1", "h2"]).select("h1", "h2", "first", "x.n", "x.bag", "x.wide", spans.alias("spans")))

    def keys(df: DataFrame, spans: Column) -> DataFrame:
        """A row for each span, with those before it."""
        df = df.select("h1", "h2", "first", "n", "bag", "wide", "spans", F.posexplode(spans).alias("i", "x"))
        return df.select("x.run", "first", "h1", "h2", "n", "x.lo", "x.hi", "bag", "wide", F.slice("spans", F.lit(1), F.col("i")).alias("lower"))

    fields = ("first", "h1", "h2", "n", "lo", "hi", "bag", "wide")
    bound = F.floor(F.least("n", "r_n") / b.words_an_edit)
    # An edit adds or takes one word and one segment at most.
    reach = lambda x, y: (x.lo - y.hi <= bound) & (y.lo - x.hi <= bound)
    mine, theirs = F.struct("lo", "hi"), F.struct(F.col("r_lo").alias("lo"), F.col("r_hi").alias("hi"))
    fits = (F.col("r_first") < F.col("first")) & reach(mine, theirs) & (F.abs(F.col("n") - F.col("r_n")) <= bound)
    alike = F.bit_count(F.col("bag").bitwiseXOR(F.col("r_bag"))) <= 2 * bound
    alike &= F.coalesce(_odd(F.col("wide"), F.col("r_wide")) <= 2 * bound, F.lit(True))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.filter(fits).filter(alike).select("h1", "h2", "r_h1", "r_h2").distinct())
        # Few lines are in a pair; only their texts are moved.
        met = stored(pairs.select("h1", "h2").union(pairs.select("r_h1", "r_h2")).distinct())
        texts = stored(suspects.select("h1", "h2", "line").join(broadcast_checked(met, BROADCAST_LINES), ["h1", "h2"], "left_semi"))
        earlier = texts.select(F.col("h1").alias("r_h1"), F.col("h2").alias("r_h2"), F.col("line").alias("earlier"))
        both = pairs.join(texts, ["h1", "h2"]).join(earlier, ["r_h1", "r_h2"])
        near = let(F.split("line", " "), lambda x: let(F.split("earlier", " "), lambda y: within_bound(x, y, b.words_an_edit)))
        return stored(both.filter(near).select("h1", "h2").distinct())

    few = keys(lines, F.slice("spans", 1, FEW_KEYS))
    best = few.groupBy("run").agg(F.count("*").alias("lines"), F.min(F.struct(*fields)).alias("best")).filter("lines > 1")
    star = checked(few.join(best.select("run", *[F.col(f"best.{c}").alias(f"r_{c}") for c in fields]), "run"))
    todo = keys(lines.join(broadcast_checked(star, BROADCAST_LINES), ["h1", "h2"], "left_anti"), F.col("spans"))
    every = keys(lines, F.col("spans"))
    # Keys of one line alone meet nothing. Where too many are shared to be sent to all, only the frequent ones are told apart.
    shared = stored(every.groupBy("run").count().filter("count > 1").select("run", (F.col("count") > MANY_LINES).alias("often")))
    some = shared.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    # Levels are lengths that differ by the bound; places differ by it at most, so by one step of the level's bound.
    grow = math.log(1 + 1 / b.words_an_edit)
    level = F.floor(F.log(F.col("n").cast("double")) / grow).cast("int")
    cell = lambda at, p: F.floor(F.col(p) / (F.ceil(F.exp((at + 1) * F.lit(grow)) / b.words_an_edit) + 1)).cast("int")
    at = lambda d, c, low: F.struct((level + d).alias("level"), c.alias("cell"), low.alias("low"))

    def cells(d: int, e: int) -> Column:
        """The cells of a span on a level, and e more on either side."""
        low, high = cell(level + d, "lo") - e, cell(level + d, "hi") + e
        return F.transform(F.sequence(low, high), lambda c: at(d, c, low))

    nowhere = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("cell"), F.lit(0).alias("low")))
    often = F.broadcast(shared) if some else broadcast_checked(shared.filter("often"), BROADCAST_LINES)
    marked = lambda df: df.join(often, "run", "inner" if some else "left")
    flat = lambda df, ats: marked(df).withColumn("at", F.explode(ats)).select("run", "at.level", "at.cell", "at.low", "lower", *fields)
    asked = flat(todo, F.when(F.col("often"), F.concat(*[cells(d, 1) for d in (-1, 0, 1)])).otherwise(nowhere))
    there = flat(every, F.when(F.col("often"), cells(0, 0)).otherwise(nowhere))
    there = there.select("run", "level", "cell", *[F.col(c).alias(f"r_{c}") for c in ("low", "lower", *fields)])
    # Two lines meet at the first key that allows it, in the first cell that both spans have.
    before = F.exists("lower", lambda x: F.exists("r_lower", lambda y: (x.run == y.run) & reach(x, y)))
    met = asked.join(there, ["run", "level", "cell"]).filter(F.col("cell") == F.greatest("low", "r_low"))
    return star.unionByName(checked(met.filter(fits).filter(alike).filter(~before)))


def judged(docs: DataFrame, b: Bounds = BOUNDS) -> DataFrame:
    """doc_id, place, dropped of each distinct (doc_id, text) that loses a line: (line_no, state) of the lines that go, in
    order; state is "equal" or "near".

    Lines without words always stay. Rows with the same doc_id and text are one document, however often they repeat.
    """
    rows = split_lines(docs).withColumn("line", spaced(F.col("line"), F.col("blanks"))).withColumn("n", _size(F.col("line")))
    line, n, none = F.col("line"), F.col("n"), F.array().cast("array<bigint>")
    by_words, by_chars = _word_ends(line, n), let(_chars(line), _ends)
    keys = [F.when(_by_words(n, b), by_words).otherwise(none), F.when(_by_chars(n, line, b), by_chars).otherwise(none)]
    runs = F.when(_many(n, b), _long_keys(line, n, b)).otherwise(none)
    lines = stored(rows.select("doc_id", "place", "line_no", "n", *_ids(line), F.concat(*keys).alias("keys"), runs.alias("runs")))
    full = lines.filter("n > 0")
    firsts = stored(full.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("lines")))
    keys = lines.select("h1", F.explode("keys").alias("key"))
    keys = keys.union(lines.select("h1", F.explode("runs").alias("run")).select("h1", F.xxhash64(F.lit(2), _key_of(F.col("run")))))
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key")
    suspects = keys.join(broadcast_checked(stored(shared), BROADCAST_LINES), "key").select("h1").distinct()
    wanted = stored(firsts.join(suspects, "h1").select("h1", "h2", "first"))
    where = wanted.groupBy(F.col("first.doc_id").alias("w_id"), F.col("first.place").alias("w_place")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("wanted"))
    where = F.broadcast(where) if wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else where
    # Only documents that hold a wanted line are split again, once each.
    found = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("place"))
    found = found.join(where, (F.col("place") == F.col("w_place")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    taken = lambda lines: F.transform("wanted", lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.first.alias("first"), F.get(lines, x.first.line_no).alias("line")))
    texts = found.select(F.explode(let(F.split("text", "\n"), taken)).alias("x")).select("x.h1", "x.h2", "x.first", spaced(F.col("x.line")).alias("line"))
    # As text with one space between words, which is a third of what a list of words takes when it is shuffled.
    texts = stored(texts.dropDuplicates(["h1", "h2"]))
    texts = texts.withColumn("w", F.split("line", " ")).withColumn("n", F.size("w"))
    # A line of min_words words is compared both ways, as two lines; the second has another h2.
    by_chars = texts.filter(_by_chars(n, line, b)).select("h1", F.bitwise_not("h2").alias("h2"), "first", _chars(line).alias("w"))
    near = stored(near_lines(stored(texts.filter(_by_words(n, b)).select("h1", "h2", "first", "w").unionByName(by_chars))))
    near = near.unionByName(near.select("h1", F.bitwise_not("h2").alias("h2")))
    # The keys of long lines are made once, with those of all lines.
    own = lines.filter(_many(n, b)).join(broadcast_checked(wanted, BROADCAST_LINES), ["h1", "h2"]).filter(_order().eqNullSafe(F.col("first")))
    own = own.select("h1", "h2", "runs").dropDuplicates(["h1", "h2"])
    near = near.unionByName(near_long_lines(texts.filter(_many(n, b)).drop("w", "n"), own, b)).distinct()
    # Most lines are the only ones of their kind and near none; the rest of the work is for the others.
    classes = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("near or lines > 1")
    classes = broadcast_checked(stored(classes.select("h1", "h2", "first", "near")), BROADCAST_LINES)
    state = F.when(~_order().eqNullSafe(F.col("first")), F.lit("equal")).when(F.col("near"), F.lit("near"))
    states = full.join(classes, ["h1", "h2"]).select("doc_id", "place", "line_no", state.alias("state")).filter("state is not null")
    return states.groupBy("doc_id", "place").agg(F.sort_array(F.collect_set(F.struct("line_no", "state"))).alias("dropped"))


def _judged_rows(docs: DataFrame, b: Bounds) -> DataFrame:
    """doc_id, text (less its dropped lines), the packed other columns, and n_lines, n_equal, n_near of every row of docs."""
    rows = packed(docs, "doc_id", "text")
    gone = judged(rows.select("doc_id", "text"), b).select(F.col("doc_id").alias("f_id"), F.col("place").alias("f_place"), "dropped")
    here = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # Hashing the short lists of dropped lines spares a sort of the texts.
    joined = rows.join(gone.hint("shuffle_hash"), (here == F.col("f_place")) & F.col("doc_id").eqNullSafe(F.col("f_id")), "left")
    none = F.array().cast("array<struct<line_no:int,state:string>>")
    joined = joined.withColumn("dropped", F.coalesce("dropped", none)).withColumn("lines", F.split("text", "\n"))
    count = lambda kind: F.size(F.filter("dropped", lambda x: x.state == kind)).cast("long")
    # What stays lies between dropped lines: from after one, or the beginning, up to the next, or the end.
    at = F.col("dropped.line_no")
    between = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1)), F.concat(at, F.array(F.size("lines"))), lambda low, high: F.slice("lines", low + 1, high - low)
    )
    kept = F.when(F.size("dropped") > 0, F.array_join(F.flatten(between), "\n")).otherwise(F.col("text"))
    full = F.size(F.filter("lines", lambda x: F.ltrim(x, F.lit(SPACE_BYTES.decode())) != "")).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(full).cast("long")
    return joined.select(
        *[F.col(c) for c in rows.columns if c != "text"],
        kept.alias("text"),
        n_lines.alias("n_lines"),
        count("equal").alias("n_equal"),
        count("near").alias("n_near"),
    )


def dedup(docs: DataFrame, bounds: Bounds = BOUNDS) -> DataFrame:
    """docs with its own columns, text less its dropped lines, and n_lines, n_equal, n_near (lines with words; dropped ones).

    A null text stays null. Columns of docs may have any names; those three stand for the ones of docs with their names.
    """
    out = _judged_rows(docs, bounds)
    own = [c for c in unpacked(out, docs) if c[0] not in ("n_lines", "n_equal", "n_near")]
    return out.select(*[column.alias(name) for name, column in own], "n_lines", "n_equal", "n_near")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's lines, dropped lines and a digest of what stays."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(docs: DataFrame, bounds: Bounds = BOUNDS) -> DataFrame:
    """docs without their dropped lines; documents of which no word is left go, unless they had none before."""
    out = _judged_rows(docs, bounds)
    gone = (F.col("n_lines") > 0) & (F.col("n_equal") + F.col("n_near") == F.col("n_lines"))
    return out.filter(~gone).select(*[column.alias(name) for name, column in unpacked(out, docs)])
