"""BPE encoding and decoding of whole texts with a public word-end BPE vocabulary.

White space never enters a token of this vocabulary, so a text's ids are its words' ids in order, and each task keeps
the ids of the words it has met. What has no such seam is joined by tree concatenation: texts over PIECE_CHARS are cut
into pieces that other tasks encode, words over RUN_CHARS into halves, and at each join a window around the cut is
encoded again and grown until it agrees with the pieces on both sides. Two token lists that agree there are one
encoding: a BPE encoding is right as soon as each pair of neighbours is.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.common import free, result_schema, table

VOCABULARY = "word_bpe_49k.json"
#: Code points above which a text is cut into pieces for several tasks.
PIECE_CHARS = 65_536
#: Code points above which a single word is encoded by halves.
RUN_CHARS = 4_096
#: Code points on each side of a cut in the first window.
WINDOW = 64
#: Words whose ids a task keeps.
CACHE_WORDS = 200_000
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2_000_000
_MARK = "<|endoftext|>"
_SPECIAL = re.compile(rb"<\|(?:startoftext|endoftext)\|>")


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(values: list, max_bytes: int = SLICE_BYTES) -> Iterator[list]:
    """values in runs of about max_bytes, so that a task's memory does not follow the size of an Arrow batch."""
    out: list = []
    size = 0
    for v in values:
        out.append(v)
        size += len(v)
        if size >= max_bytes:
            yield out
            out, size = [], 0
    if out:
        yield out


def row_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of a text column's rows of about max_bytes; only a run at a time is copied. Nulls are empty."""
    column = column.cast(pa.binary())
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + max_bytes, side="right")))
        yield at, [t or b"" for t in column.slice(at, end - at).to_pylist()]
        at = end


class Encoder:
    """A vocabulary in one task, with a bounded memory of words."""

    def __init__(self, path: str, run_chars: int = RUN_CHARS, window: int = WINDOW):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # A cut inside a special string shows only in a window that holds it whole.
        special = [len(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.run_chars, self.window = run_chars, max([window, *special])
        self.mark = self.library.token_to_id(_MARK)
        self.token = [(self.library.id_to_token(i) or "").encode() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.tokens = pa.array(self.token, pa.binary())
        self.ids: dict[bytes, bytes] = {}

    def triples(self, text: str, at: int = 0) -> np.ndarray:
        """Rows of id, start, end of a text that begins at position at."""
        e = self.library.encode(text, add_special_tokens=False)
        if not e.ids:
            return np.zeros((0, 3), dtype=np.int64)
        return np.column_stack([np.array(e.ids, dtype=np.int64), np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at])

    def join(self, text: str, left: np.ndarray, right: np.ndarray, low: int, cut: int, high: int) -> np.ndarray:
        """The encoding of text[low:high] from those of text[low:cut] and text[cut:high]."""
        w = self.window
        while True:
            a, b = max(low, cut - w), min(high, cut + w)
            middle = self.triples(text[a:b], a)
            head = (0, 0) if a == low else _agreement(left, middle)
            tail = (0, 0) if b == high else _agreement(right[::-1], middle[::-1])
            if head is not None and tail is not None and head[1] + tail[1] <= len(middle):
                return np.concatenate([left[: head[0]], middle[head[1] : len(middle) - tail[1]], right[len(right) - tail[0] :]])
            w *= 2

    def tree(self, text: str, low: int, high: int, piece: int) -> np.ndarray:
        """The encoding of text[low:high] by halves down to piece code points."""
        if high - low <= piece:
            return self.triples(text[low:high], low)
        cut = (low + high) // 2
        return self.join(text, self.tree(text, low, cut, piece), self.tree(text, cut, high, piece), low, cut, high)

    def join_pieces(self, texts: list[str], parts: list[np.ndarray]) -> np.ndarray:
        """The encoding of the pieces' concatenation; parts are their own encodings, positions from 0 in each."""
        text, ends = "".join(texts), np.cumsum([0] + [len(t) for t in texts])
        done = []
        for i, part in enumerate(parts):
            part = part.copy()
            part[:, 1:] += ends[i]
            done.append((int(ends[i]), int(ends[i + 1]), part))
        while len(done) > 1:
            pairs = [(x[0], y[1], self.join(text, x[2], y[2], x[0], x[1], y[1])) for x, y in zip(done[::2], done[1::2], strict=False)]
            done = pairs + done[len(pairs) * 2 :]
        return done[0][2] if done else np.zeros((0, 3), dtype=np.int64)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, as little-endian 32-bit integers; remembered while there is room."""
        odd = [w for w in words if len(w) > self.run_chars or _SPECIAL.search(w)]
        plain = list(words.difference(odd)) if odd else list(words)
        new: dict[bytes, bytes] = {}
        for some in slices(plain, 200_000):
            # One call for many words; the mark between them is a token of its own that no word here holds.
            e = np.array(self.library.encode_batch_fast([f" {_MARK} ".join(w.decode() for w in some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(e == self.mark)
            raw, starts, ends = e.tobytes(), [0, *(at * 4 + 4).tolist()], [*(at * 4).tolist(), 4 * len(e)]
            new.update(zip(some, (raw[s:t] for s, t in zip(starts, ends, strict=True)), strict=True))
        for w in odd:
            text = w.decode()
            new[w] = self.tree(text, 0, len(text), self.run_chars)[:, 0].astype("<u4").tobytes()
        if len(self.ids) < CACHE_WORDS:
            self.ids.update(itertools.islice(new.items(), CACHE_WORDS - len(self.ids)))
        return new

    def words(self, texts: list[bytes]) -> tuple[list[list[bytes]], dict[bytes, bytes]]:
        """The words of some texts, and the ids of all these words."""
        split = [t.split() for t in texts]
        seen = set(itertools.chain.from_iterable(split))
        known, new = self.ids, seen.difference(self.ids)
        return split, ({**known, **self.learn(new)} if new else known)

    def decode(self, ids: bytes) -> bytes:
        """What the library's decode gives: this vocabulary has no decoder, so its tokens with a space between."""
        return b" ".join([self.token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def decode_all(self, packed: list[bytes]) -> pa.Array:
        """The same for many texts at once, by Arrow."""
        ends = np.cumsum([0, *(len(ids) // 4 for ids in packed)])
        tokens = self.tokens.take(pa.array(np.frombuffer(b"".join(packed), dtype="<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens), b" ").cast(pa.string())


def _agreement(own: np.ndarray, window: np.ndarray) -> tuple[int, int] | None:
    """Where a piece's tokens, read towards the cut, meet the window's: how many of the piece's come first and how many
    of the window's they replace. The window's own outermost token is not to be trusted; two neighbours must agree, and
    neither may share its code points with the token before."""
    row = {tuple(r): i for i, r in enumerate(own.tolist())}
    rows = window.tolist()
    for k in range(1, len(rows) - 1):
        i = row.get(tuple(rows[k]))
        if i is None or i + 1 >= len(own) or own[i + 1].tolist() != rows[k + 1]:
            continue
        if rows[k][1:] != rows[k - 1][1:] and (i == 0 or own[i - 1].tolist()[1:] != rows[k][1:]):
            return i, k
    return None


_STATE: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def encode(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """keep columns of docs plus ids (binary: little-endian unsigned 32-bit integers) and decoded (string).

    Null and empty texts have no ids and decode to an empty text. Repeated rows stay apart. Columns kept under the names
    ids and decoded give way to these.
    """
    keep = [c for c in keep if c not in ("ids", "decoded")]
    whole, row, at_, piece, triples = free(keep, "__text", "__row", "__at", "__piece", "__triples")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(whole))
    long = F.length(whole) > piece_chars

    def short_texts(batches):
        e = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            for at, some in row_slices(batch.column(len(keep))):
                split, ids = e.words(some)
                packed = [b"".join(map(ids.__getitem__, ws)) for ws in split]
                out = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(packed, pa.binary()), e.decode_all(packed)], names=[*keep, "ids", "decoded"])

    def pieces(batches):
        e = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            found = [e.triples(t.as_py()).astype("<i8").tobytes() for t in batch.column(piece)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, triples])

    def join(key, pdf):
        pdf = pdf.sort_values(at_)
        e = encoder(vocabulary_path(vocabulary))
        parts = [np.frombuffer(x, dtype="<i8").reshape(-1, 3) for x in pdf[triples]]
        ids = e.join_pieces(list(pdf[piece]), parts)[:, 0].astype("<u4").tobytes()
        return pdf.head(1)[keep].assign(ids=[ids], decoded=[e.decode(ids).decode()])

    done = source.filter(~long).mapInArrow(short_texts, result_schema(docs, keep, "ids binary, decoded string"))
    cut = (
        source.filter(long)
        .withColumn(row, F.monotonically_increasing_id())
        .withColumn(at_, F.explode(F.sequence(F.lit(0), F.ceil(F.length(whole) / piece_chars).cast("int") - 1)))
        .withColumn(piece, F.substr(F.col(whole), F.col(at_) * piece_chars + 1, F.lit(piece_chars)))
        .drop(whole)
        .repartition(row, at_)
    )
    parts = cut.mapInArrow(pieces, result_schema(docs, keep, f"`{row}` bigint, `{at_}` int, `{piece}` string, `{triples}` binary"))
    return done.unionByName(parts.groupBy(row).applyInPandas(join, result_schema(docs, keep, "ids binary, decoded string")))


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns plus decoded, from packed ids; null ids decode to null. A column kept under that name gives way to it."""
    keep = [c for c in keep if c != "decoded"]

    def texts(batches):
        e = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            plain = [None if x is None else e.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(plain, pa.binary()).cast(pa.string())], names=[*keep, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids)).mapInArrow(texts, result_schema(encoded, keep, "decoded string"))


def digests(docs: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row of docs."""
    out = encode(docs, ["doc_id"], piece_chars=piece_chars)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
