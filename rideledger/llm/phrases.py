"""Mining of phrases that are more frequent than their parts let expect, by stripes.

A stripe is what is known of one prefix: a counter of the words that follow it, and how often the prefix itself occurs.
Tasks fill the stripes of their own texts, equal prefixes' stripes meet and are added up element by element, and all the
rest is read off the sum: a counter's frequent words are the prefix's extensions, the totals are the frequencies of all
parts a phrase can be cut into, and the largest extensions tell which phrases a longer one subsumes.

A prefix's own count is an element of the stripe of the prefix one word shorter; the empty prefix's counts all words.

Stripes are made a length at a time, since a phrase can only be frequent if both phrases of one word less inside it are.
Before a length is counted, the pass for the length before it counts hashes of its phrases, four bytes each: those that
are frequent enough are put in a bit filter of fixed size, which the next pass asks before it counts. Hashes that
collide and bits that are shared only let more pass, so no frequent phrase is missed however full the filter is; what
it lets pass is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideledger.llm.common import broadcast_checked, stored, table

LONGEST = 5
MIN_COUNT = 100
#: A phrase goes if a longer one has this many hundredths of its occurrences or more.
SUBSUMED = 100
SCALE = 1000
TOP = 2000
#: Bits of the filter of frequent phrases, as a power of two: 16 MB for any input.
FILTER_BITS = 27
#: Words whose stripes a task adds up before it hands them on.
WINDOW_WORDS = 2_000_000
#: Bytes of a text that are split at once.
SLICE_BYTES = 4_000_000
#: Parts that a stripe is dealt in by its next words: that of the empty prefix, whose counter is the vocabulary; others.
WORD_PARTS, PARTS = 1024, 16
#: Rows that a task hands on at once.
ROWS = 50_000
#: Languages up to this number are broadcast, one short row each; above it, their table is shuffled.
BROADCAST_LANGS = 100_000
#: Hash groups that a language's best phrases are first sought in.
TOP_PARTS = 64
#: Bits of a hashed phrase that are counted: those that rows share, and those that tell phrases of a row apart.
GROUP_BITS, LOW_BITS = 14, 32
PART_RESULT = "lang string, prefix string, part int, next array<string>, n array<bigint>, group int, low array<int>, times array<int>"

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(_ENDS))
_END = b"\n"
_C, _GOLD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: bytes, slice_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, ASCII letters lower-cased, with a line break where a piece ends; in runs of about slice_bytes."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        to = len(text)
        if to - at > slice_bytes:
            cut = max(text.rfind(b" ", at, at + slice_bytes), text.rfind(_END, at, at + slice_bytes))
            if cut <= at:  # one word longer than a slice
                found = [x for x in (text.find(b" ", at + slice_bytes), text.find(_END, at + slice_bytes)) if x >= 0]
                cut = min(found, default=to)
            to = cut
        yield list(filter(None, text[at:to].replace(_END, b" \n ").split(b" ")))
        at = to


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _hash(lang: bytes, hashes: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words that begin at each position of ids."""
    h = np.full(max(0, len(ids) - k + 1), _word_hashes([lang])[0], dtype=np.uint64)
    for j in range(k):
        h = (h ^ hashes[ids[j : j + len(h)]]) * _C
        h ^= h >> np.uint64(29)
    return h * _GOLD


def _heads(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


class _Window:
    """The words that a task has read and not yet counted, by language, as numbers of its own."""

    def __init__(self, k: int, bits: np.ndarray | None, words: int, last: bool):
        self.k, self.bits, self.words, self.last = k, bits, words, last
        self.clear()

    def clear(self) -> None:
        self.ids_of: dict[bytes, int] = {_END: 0}
        self.runs: dict[bytes, list[np.ndarray]] = {}
        self.size = 0

    def feed(self, lang: bytes, run: list[bytes]) -> None:
        known = self.ids_of
        for w in set(run).difference(known):
            known[w] = len(known)
        self.runs.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, run), dtype=np.int64, count=len(run)))
        self.size += len(run)

    def full(self) -> bool:
        return self.size >= self.words

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Stripes of what has been read. But for the last time, prefixes that begin in the last words wait for the next ones."""
        vocabulary, wait = list(self.ids_of), {}
        hashes = _word_hashes(vocabulary)
        for lang, runs in self.runs.items():
            ids = np.concatenate(runs)
            starts = len(ids) if last else max(0, len(ids) - self.k)
            wait[lang] = [vocabulary[i] for i in ids[starts:].tolist()]
            yield from self.count(lang, vocabulary, hashes, ids, starts)
        self.clear()
        for lang, words in wait.items():
            if words:
                self.feed(lang, words)

    def count(self, lang: bytes, vocabulary: list[bytes], hashes: np.ndarray, ids: np.ndarray, starts: int) -> Iterator[pa.RecordBatch]:
        """Stripes of the phrases of k words that begin at the first starts words, and hash counts of those of k + 1 (stripes, the last time)."""
        k, length = self.k, len(ids)
        inside = ids > 0
        for j in range(1, k):
            inside = inside[: length - j] & (ids[j:] > 0)
        hit = np.zeros(length + 1, dtype=bool)
        if k == 1:
            hit[:length] = inside
            n = np.bincount(ids[:starts], minlength=len(vocabulary))
            n[0] = 0
            following = np.flatnonzero(n)
            if len(following):
                nothing = np.zeros(len(following), dtype=np.int64)
                yield from self.stripes(lang, vocabulary, hashes, ids, nothing[:1], 1, nothing, following, n[following], n.sum())
        else:
            at = np.flatnonzero(inside)
            place = _hash(lang, hashes, ids, k)[at] >> np.uint64(64 - (len(self.bits).bit_length() + 2))
            hit[at[(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]] = True
            yield from self.counted(lang, vocabulary, hashes, ids, np.flatnonzero(hit[:starts]), k)
        longer = np.flatnonzero(hit[:starts] & hit[1 : starts + 1])
        if self.last:
            yield from self.counted(lang, vocabulary, hashes, ids, longer, k + 1)
        elif len(longer):
            found, n = np.unique(_hash(lang, hashes, ids, k + 1)[longer] >> np.uint64(64 - GROUP_BITS - LOW_BITS), return_counts=True)
            group = found >> np.uint64(LOW_BITS)
            heads = _heads(group)
            ends = pa.array(np.append(heads, len(found)), pa.int32())
            low = found.astype(np.uint32).view(np.int32)
            yield _batch(len(heads), group=pa.array(group[heads].astype(np.int32)), low=pa.ListArray.from_arrays(ends, pa.array(low)), times=pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32))))

    def counted(self, lang, vocabulary, hashes, ids, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """Stripes of the phrases of k words that begin at the positions at."""
        if not len(at):
            return
        v = np.int64(len(vocabulary))
        # Number the prefixes, a word at a time.
        prefix = ids[at]
        for j in range(1, k - 1):
            _, prefix = np.unique(prefix * v + ids[at + j], return_inverse=True)
        _, first, prefix = np.unique(prefix, return_index=True, return_inverse=True)
        pairs, n = np.unique(prefix * v + ids[at + k - 1], return_counts=True)
        yield from self.stripes(lang, vocabulary, hashes, ids, at[first], k, pairs // v, pairs % v, n)

    def stripes(self, lang, vocabulary, hashes, ids, first, k, prefix, following, n, total=None) -> Iterator[pa.RecordBatch]:
        """Rows of counters (prefix number, following word, n) of phrases of k words, first being where each prefix begins.

        total, of a prefix without words, is the element that has no word.
        """
        words, parts = pa.array(vocabulary, pa.binary()).cast(pa.string()), np.int64(WORD_PARTS if k == 1 else PARTS)
        key = prefix * parts + (hashes[following] % np.uint64(parts)).astype(np.int64)
        if total is not None:
            key, following, n = np.append(key, 0), np.append(following, -1), np.append(n, total)
        order = np.argsort(key, kind="stable")
        key, following, n = key[order], following[order], n[order].astype(np.int64)
        heads = np.append(_heads(key), len(key))
        for a in range(0, len(heads) - 1, ROWS):
            some = heads[a : a + ROWS + 1]
            rows, ends = key[some[:-1]], pa.array(some - some[0], pa.int32())
            begin = first[rows // parts]
            prefixes = [words.take(pa.array(ids[begin + j])) for j in range(k - 1)]
            inner = slice(some[0], some[-1])
            yield _batch(
                len(rows),
                lang=pa.array([lang.decode()] * len(rows)),
                prefix=pc.binary_join_element_wise(*prefixes, " ") if prefixes else pa.array([""] * len(rows)),
                part=pa.array((rows % parts).astype(np.int32)),
                next=pa.ListArray.from_arrays(ends, words.take(pa.array(following[inner], mask=following[inner] < 0))),
                n=pa.ListArray.from_arrays(ends, pa.array(n[inner])),
            )


_ARROW = {
    "lang": pa.string(), "prefix": pa.string(), "part": pa.int32(), "next": pa.list_(pa.string()), "n": pa.list_(pa.int64()),
    "group": pa.int32(), "low": pa.list_(pa.int32()), "times": pa.list_(pa.int32()),
}


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Rows of a pass: stripes or hash counts, the columns of the other kind null."""
    return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(rows, t) for c, t in _ARROW.items()], names=list(_ARROW))


def counted(texts: DataFrame, k: int, bits, window_words: int, last: bool) -> DataFrame:
    """What tasks count of texts (lang, text) in the pass for phrases of k words: stripes (group null), and hashes of longer ones (group not null)."""

    def count(batches):
        window = _Window(k, bits.value if bits else None, window_words, last)
        for batch in batches:
            langs, texts = batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())
            for lang, text in zip(langs, texts, strict=True):
                for run in tokens(text.as_py()):
                    window.feed(lang.as_py(), run)
                    if window.full():
                        yield from window.flush()
                window.feed(lang.as_py(), [_END])
        yield from window.flush(last=True)

    return texts.mapInArrow(count, PART_RESULT)


def merged(parts: DataFrame, min_count: int) -> DataFrame:
    """(lang, prefix, next, n): stripes added up, with the words that follow often enough; next is null for the number of all words."""
    dealt = parts.where("group is null").repartition("lang", "prefix", "part")
    entries = dealt.select("lang", "prefix", "part", F.explode(F.arrays_zip("next", "n")).alias("e"))
    added = entries.groupBy("lang", "prefix", "part", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n"))
    return added.where(F.col("next").isNull() | (F.col("n") >= min_count)).drop("part")


def sieve(parts: DataFrame, min_count: int, filter_bits: int = FILTER_BITS) -> np.ndarray | None:
    """The filter, as bytes, of the hashes that were counted often enough; None if none were.

    Its words of 64 bits that aren't 0 come to the driver, 2^(filter_bits - 6) at most, however many phrases there are.
    """
    dealt = parts.where("group is not null").repartition("group")
    entries = dealt.select("group", F.explode(F.arrays_zip("low", "times")).alias("e"))
    often = entries.groupBy("group", F.col("e.low").alias("low")).agg(F.sum("e.times").alias("n")).where(F.col("n") >= min_count)
    value = f"(shiftleft(cast(group as bigint), {LOW_BITS}) | (cast(low as bigint) & {2**LOW_BITS - 1}L))"
    places = often.select(F.expr(f"shiftright({value}, {GROUP_BITS + LOW_BITS - filter_bits})").alias("place"))
    words = places.groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    got = words.toArrow()
    if not got.num_rows:
        return None
    out = np.zeros(1 << (filter_bits - 6), dtype="<i8")
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, subsumed: int = SUBSUMED, window_words: int = WINDOW_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of docs (text, lang) that is frequent and not subsumed.

    Pieces end at . , ; : ! ? and line breaks, words at spaces and tabs; A-Z are lower-cased. a counts a phrase of 2 to
    longest words, l and r the parts of its lowest-scoring cut (of ties, the first), n all words of the language; score
    is SCALE * a * n / (l * r), rounded down, in whole numbers. Null texts are empty; a null language is und; repeated
    rows count each; no words give no rows. Texts of any length are split and counted in runs; other columns are not
    read. A phrase that a longer one subsumes has an extension by one word that subsumes it, so those are all that is asked.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    bits, found, size = None, [], None
    for k in range(1, max(2, longest)):
        last = k + 1 >= longest
        parts = stored(counted(texts, k, bits, window_words, last))
        level = stored(merged(parts, min_count))
        if k == 1:
            size = level.where("next is null").select("lang", "n")
        found.append(level.where("next is not null").select("lang", "prefix", _phrase().alias("phrase"), F.col("n").alias("a")))
        if last or (often := sieve(parts, min_count, filter_bits)) is None:
            break
        bits = spark.sparkContext.broadcast(often)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    known = union(found).withColumn("words", F.size(F.split("phrase", " ")))
    candidates = known.where("words > 1")
    after = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    longer = candidates.where("words > 2")
    longer = longer.select("lang", F.explode(F.array("prefix", after)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.select("lang", "phrase", "words", "a").join(longer, ["lang", "phrase"], "left")
    left = left.where(F.coalesce(F.col("longer") * 100 < F.col("a") * subsumed, F.lit(True))).drop("longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(broadcast_checked(size, BROADCAST_LANGS), "lang")
    whole = lambda c, digits: f"cast({c} as decimal({digits},0))"
    score = F.expr(f"({whole('a', 16)} * {SCALE} * {whole('n', 16)}) div ({whole('l', 16)} * {whole('r', 16)})")
    lowest = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "words", "a", "c.l", "c.r", "n", "c.score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first top phrases of each language, with their rank: by score, then a, both falling, then by phrase.

    A language's phrases are ranked in hash groups first, so no task sorts a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.drop("group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: each language's first phrases."""
    return best(phrases(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The definition itself: all phrases counted, and all phrases inside longer candidates compared with these.
ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM pieces, range(1, {LONGEST + 1}) AS r(m) WHERE m <= len(ws)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m >= 2 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM candidates, range(1, {LONGEST}) AS r(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, x.f AS l, y.f AS r, s.n, k, ({SCALE}::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase JOIN size s ON c.lang = s.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(1, {LONGEST}) AS p(i), range(2, {LONGEST}) AS q(k) WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside d ON c.lang = d.lang AND c.phrase = d.phrase WHERE coalesce(100 * d.longer < {SUBSUMED} * c.a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
