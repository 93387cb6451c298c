"""Quality rules: base counts, and the fertility of a public tokeniser with rejection bands by language or script.

Text that a general vocabulary cuts into very short pieces, spells out in bytes, or covers with a handful of tokens is
rarely prose. Three measures of the whole text: code points per token, share of byte-fallback tokens, and the entropy
of its tokens in bits. Each has a band for the row's language, or for the text's main script where the language has too
few texts.

Bands are fitted to all texts that pass the base rules: a band's middle is the median, its width a multiple of the
median distance from it, where distances grow with the square root of a text's tokens, as long texts vary less. Texts
with equal measures (copies) count once, so a text that is there very often doesn't set the band. Medians are exact on
a fine grid, from counts that Spark adds up. The bands need the measures alone,
which are written; a stage that hands texts on measures them twice rather than write them twice.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.bpe import row_slices, vocabulary_path
from rideledger.llm.common import ROW, broadcast_checked, checkpoint, packed, result_schema, stored, table, unpacked

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 20
#: Highest share of words inside repeated windows, in percent.
MAX_REPEAT = 30
#: Words in a window.
WINDOW = 8
CACHE_WORDS = 100_000
SYMBOLS = b"#*$%&|<>"
_NOT_CODE_POINTS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Band:
    """What any text of a script may measure, however its corpus does."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: By script. Wide on purpose: they reject what no prose in the script measures, and stand alone for scripts of few texts.
BANDS = {
    "Latin": Band(1.20, 8.0, 0.30, 3.2),
    "Greek or Cyrillic": Band(0.70, 6.0, 0.60, 3.2),
    "other": Band(0.25, 6.0, 0.80, 2.4),
}


@dataclass(frozen=True)
class Limits:
    """How many widths from its middle a fitted band ends, and from how many different texts one is fitted."""

    low_chars_per_token: float = 4.0
    high_chars_per_token: float = 8.0
    low_entropy: float = 5.0
    high_byte_share: float = 5.0
    #: A byte share within this much of the middle is never too high.
    byte_share: float = 0.05
    #: Least widths (of a text of one token).
    least_width: float = 0.2
    texts: int = 100


LIMITS = Limits()
#: Cells of the grid for medians, to a unit.
GRID = 1000
#: Bands up to this number are broadcast (six numbers each); above it, a shuffled join.
BROADCAST_BANDS = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


class Meter:
    """The tokeniser in one worker, with a bounded memory of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.library.is_byte(i) for i in range(self.library.get_piece_size())])
        self.ids: dict[bytes, bytes] = {}

    def known(self, words: set[bytes]) -> dict[bytes, bytes]:
        new = list(words.difference(self.ids))
        if not new:
            return self.ids
        found = {w: np.array(i, dtype="<u2").tobytes() for w, i in zip(new, self.library.encode([w.decode() for w in new], num_threads=1), strict=True)}
        out = {**self.ids, **found}
        if len(self.ids) < CACHE_WORDS:
            self.ids.update(itertools.islice(found.items(), CACHE_WORDS - len(self.ids)))
        return out

    def measure(self, texts: list[bytes]) -> dict[str, list]:
        """A list for each measure, in the order of texts."""
        split = [t.split() for t in texts]
        distinct = set(itertools.chain.from_iterable(split))
        ids = self.known(distinct)
        out: dict[str, list] = {k: [] for k in (*COUNTS, "entropy")}
        for text, words in zip(texts, split, strict=True):
            tokens = np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype="<u2")
            n = len(tokens)
            times = np.bincount(tokens)[tokens] if n else tokens
            out["n_words"].append(len(words))
            out["word_chars"].append(len(text.translate(None, _NOT_CODE_POINTS)))
            out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
            out["n_dup_lines"].append(_dup_lines(text))
            out["n_tokens"].append(n)
            out["n_byte_tokens"].append(int(self.is_byte[tokens].sum()))
            out["entropy"].append(math.log2(n) - float(np.log2(times).sum()) / n if n else 0.0)
        out["n_repeat_words"] = repeat_words(split, {w: i for i, w in enumerate(distinct)})
        return out


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line, white space included."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(split: list[list[bytes]], code: dict[bytes, int]) -> list[int]:
    """For each text, its words inside windows that it has twice or more. Windows with equal hashes are compared."""
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    c = np.fromiter(map(code.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
    if len(c) < WINDOW:
        return [0] * len(split)
    last = len(c) - WINDOW + 1
    doc = np.repeat(np.arange(len(split)), sizes)
    h = doc[:last].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(WINDOW):
        x = (c[j : j + last].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(np.arange(last) + WINDOW <= ends[doc[:last]])
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at[1:]] == h[at[:-1]]
    a, b = at[:-1][same], at[1:][same]
    equal = doc[a] == doc[b]
    for j in range(WINDOW):
        equal &= c[a + j] == c[b + j]
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    cover = np.zeros(len(c) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return (inside[ends] - inside[ends - sizes]).tolist()


def script(text: bytes) -> str:
    """The script of most letters, from the lead bytes of their UTF-8 forms."""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    latin = n[65:91].sum() + n[97:123].sum() + n[0xC3:0xCE].sum()
    greek, other = n[0xCE:0xD4].sum(), n[0xD4:0xF5].sum()
    return "other" if other > max(latin, greek) else "Greek or Cyrillic" if greek > latin else "Latin"


_STATE: dict = {}


def meter(path: str) -> Meter:
    if path not in _STATE:
        _STATE[path] = Meter(path)
    return _STATE[path]


MEASURES = ("chars_per_token", "byte_share", "entropy")


def counted(docs: DataFrame, keep: list[str], text: str = "text", lang: str | None = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns of docs plus COUNTS (long), entropy (double), language (that of the row) and script (string)."""
    language = (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string")
    # A text that is kept goes to the tasks once.
    more = [] if text in keep else [F.col(f"`{text}`").alias("measured_text")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], language.alias("row_language"), *more)
    where = keep.index(text) if text in keep else len(keep) + 1

    def task(batches):
        m = meter(vocabulary_path(vocabulary))
        for batch in batches:
            for at, some in row_slices(batch.column(where)):
                got = m.measure(some)
                own = [batch.column(i).slice(at, len(some)) for i in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, *(pa.array(got[k], pa.int64()) for k in COUNTS), pa.array(got["entropy"], pa.float64()), pa.array(list(map(script, some)), pa.string())],
                    names=[*keep, "language", *COUNTS, "entropy", "script"],
                )

    results = ", ".join(["language string", *(f"{k} bigint" for k in COUNTS), "entropy double", "script string"])
    return source.mapInArrow(task, result_schema(docs, keep, results))


def _measures(df: DataFrame) -> DataFrame:
    """df of counted() plus the two shares and base_failed."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumn("chars_per_token", share("word_chars", "n_tokens")).withColumn("byte_share", share("n_byte_tokens", "n_tokens"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def fitted_bands(measured: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """name, n (different texts), and the middle and width of each measure, for languages and scripts with enough texts."""
    texts = measured.filter(~F.col("base_failed") & (F.col("n_tokens") > 0)).select("language", "script", "n_tokens", *MEASURES).distinct()
    names = F.array(F.concat(F.lit("language "), "language"), F.concat(F.lit("script "), "script"))
    rows = texts.withColumn("name", F.explode(names)).filter("name is not null")

    def medians(df: DataFrame, values: dict) -> DataFrame:
        """name, n and the median of each value on the grid: counts by cell first, then a median of counted cells."""
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(v * GRID).cast("long").alias("cell")) for k, v in values.items()]))
        counts = df.select("name", cells.alias("c")).groupBy("name", "c.k", "c.cell").count()
        by_k = counts.groupBy("name", "k").agg(F.sum("count").alias("n"), F.percentile("cell", F.lit(0.5), F.col("count")).alias("m"))
        pick = [F.max(F.when(F.col("k") == k, F.col("m") / GRID)).alias(k) for k in values]
        return by_k.groupBy("name").agg(F.max("n").alias("n"), *pick)

    middles = medians(rows, {f"{k}_middle": F.col(k) for k in MEASURES}).filter(F.col("n") >= limits.texts)
    near = rows.join(broadcast_checked(checkpoint(middles), BROADCAST_BANDS), "name")
    apart = lambda k: F.abs(F.col(k) - F.col(f"{k}_middle")) * F.sqrt("n_tokens")
    widths = medians(near, {f"{k}_width": apart(k) for k in MEASURES}).drop("n")
    # 1.4826 times the median distance is the standard deviation, where values are spread normally.
    wide = [F.greatest(F.lit(limits.least_width), 1.4826 * F.col(f"{k}_width")).alias(f"{k}_width") for k in MEASURES]
    return middles.join(widths, "name").select("name", "n", *[f"{k}_middle" for k in MEASURES], *wide)


def measure(docs: DataFrame, keep: list[str], text: str = "text", lang: str | None = "lang", vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS, limits: Limits = LIMITS) -> DataFrame:
    """keep columns of docs plus the counts of COUNTS (long), chars_per_token, byte_share, entropy (double), band (string),
    base_failed, the verdict on each measure (chars_ok, bytes_ok, entropy_ok) and kept (boolean).

    Null and empty texts count 0, measure 0 and are not kept. Rows with the same text and language get the same verdict.
    Where language and script have too few texts for a band, the script's wide one decides alone. Columns kept under
    one of these names give way to it. The whole is computed when this is called, as bands need all texts.
    """
    results = [*COUNTS, *MEASURES, "band", "base_failed", "chars_ok", "bytes_ok", "entropy_ok", "kept"]
    keep = [c for c in keep if c not in (*results, "language", "script")]
    # Measures are computed once and written; texts that are kept aren't written with them but measured once more.
    found = _measures(stored(counted(docs, [] if text in keep else keep, text, lang, vocabulary)))
    measured = _measures(counted(docs, keep, text, lang, vocabulary)) if text in keep else found
    fits = broadcast_checked(checkpoint(fitted_bands(found, limits)), BROADCAST_BANDS)
    fit = F.struct("n", *[f"{k}_{x}" for k in MEASURES for x in ("middle", "width")])
    for kind in ("language", "script"):
        of_kind = fits.select(F.col("name").alias(f"{kind}_name"), fit.alias(f"{kind}_fit"))
        measured = measured.join(of_kind, F.concat(F.lit(f"{kind} "), kind) == F.col(f"{kind}_name"), "left")
    of = F.coalesce("language_fit", "script_fit")
    apart = lambda k: F.coalesce((F.col(k) - of[f"{k}_middle"]) * F.sqrt("n_tokens") / of[f"{k}_width"], F.lit(0.0))
    wide = lambda field: F.create_map(*[F.lit(x) for name, b in bands.items() for x in (name, getattr(b, field))])[F.col("script")]
    chars = apart("chars_per_token").between(-limits.low_chars_per_token, limits.high_chars_per_token)
    chars = chars & F.col("chars_per_token").between(wide("min_chars_per_token"), wide("max_chars_per_token"))
    much = F.col("byte_share") > F.coalesce(of["byte_share_middle"], F.lit(0.0)) + limits.byte_share
    bytes_ok = ~(much & (apart("byte_share") > limits.high_byte_share)) & (F.col("byte_share") <= wide("max_byte_share"))
    entropy = (apart("entropy") >= -limits.low_entropy) & (F.col("entropy") >= wide("min_entropy"))
    band = F.when(F.col("language_fit").isNotNull(), F.col("language")).otherwise(F.col("script"))
    judged = measured.withColumn("band", band).withColumn("chars_ok", chars).withColumn("bytes_ok", bytes_ok).withColumn("entropy_ok", entropy)
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("chars_ok") & F.col("bytes_ok") & F.col("entropy_ok"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with its counts, measures and verdict."""
    return measure(table(spark, sf_dir, "documents"), ["doc_id"])


def stage(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever these are called."""
    rows = packed(docs, "text", "lang")
    kept = measure(rows, ["text", "lang", ROW]).filter("kept")
    return kept.select(*[column.alias(name) for name, column in unpacked(kept, docs)])
