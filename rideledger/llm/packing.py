"""Packing of tokenised documents into sequences of a fixed length, by exact complements.

Documents are cut into pieces by tasks, and only how many pieces there are of each length decides how they are combined:
a table of at most as many rows as a sequence has tokens. The plan is made from it: an index of which lengths, which sums
of two and, over it, which sums of three can be had fills the gap beside the longest pieces exactly, a combination as many
times at once as the counts allow; what has no exact complement goes by best fit. A plan is a list of combinations and how
often each is used, so its size doesn't follow the number of pieces. Each piece then finds its sequence from its length and
its position among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideledger.llm.bpe import row_slices, vocabulary_path
from rideledger.llm.common import free, stored, table
from rideledger.llm.ranks import ranked

#: A vocabulary that is there for both libraries.
VOCABULARY = "byte_bpe_50k"
CAPACITY = 2048
#: The id after each document.
END_ID = 0
#: Code points of a text that are encoded at once.
SLICE_CHARS = 1_000_000
#: Pieces of one length that a lookup key has room for, as a power of two.
_RANK_BITS = 48

#: A space between two characters that aren't white space begins a token of its own, whatever is around.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Below it, all libraries agree on what is a letter, a number and white space.
_PLAIN = "\u0250"
_SPECIAL = "<|endoftext|>"


class Encoder:
    """A byte-level vocabulary in one task: the tokenizers library, and for texts of Latin letters the same vocabulary as ranks, which is faster."""

    def __init__(self, name: str):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(f"{name}.json"))
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary_path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = {_SPECIAL: self.library.token_to_id(_SPECIAL)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        return b"".join(map(self._encode, seams(text)))

    def _encode(self, text: str) -> bytes:
        if text.isascii() or max(text) < _PLAIN:
            return self.ranks.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def seams(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A text in parts of about chars code points, which have the same ids apart as together."""
    at = 0
    while at < len(text):
        seam = _SEAM.search(text, at + chars) if len(text) - at > chars else None
        to = seam.start() if seam else len(text)
        yield text[at:to]
        at = to


_STATE: dict = {}


def encoder(name: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if name not in _STATE:
        _STATE[name] = Encoder(name)
    return _STATE[name]


def pieces(docs: DataFrame, keep: list[str], capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """keep columns of docs (text, ...) plus piece, start, length, ids_crc32 (and ids, packed, if asked for), a row a piece.

    A document's tokens are its text's and END_ID; null texts are empty. A document of more than capacity tokens is cut
    into pieces of capacity, from its end, so that the first may be shorter; start counts the tokens before a piece.
    Columns kept under the names of the new ones give way to them.
    """
    new = "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    keep = [c for c in keep if c not in T.StructType.fromDDL(new).names]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + T.StructType.fromDDL(new).fields)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        e = encoder(vocabulary)
        for batch in batches:
            for at, some in row_slices(batch.column(len(keep))):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(some):
                    packed = e.encode(t.decode()) + end
                    n = len(packed) // 4
                    first, view = (n - 1) % capacity + 1, memoryview(packed)
                    for p, a in enumerate([0, *range(first, n, capacity)]):
                        b = first if p == 0 else a + capacity
                        row.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(view[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(packed[4 * a : 4 * b])
                kept = [batch.column(j).slice(at, len(some)).take(pa.array(row)) for j in range(len(keep))]
                made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                made += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias(*free(keep, "__text"))
    return docs.select(*[F.col(f"`{c}`") for c in keep], text).mapInArrow(cut, schema)


class _Stock:
    """How many pieces there are of each length, and which sums of two can be had."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        self.one = np.zeros(capacity + 1, dtype=bool)
        self.sums = np.zeros(2 * capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.add(length, count)

    def add(self, length: int, count: int) -> None:
        """count pieces more, or fewer."""
        before, after = self.n[length], self.n[length] + count
        if (before > 1) != (after > 1):
            self.sums[2 * length] += 1 if after > 1 else -1
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.one)
            self.sums[length + others[others != length]] += 1 if after > 0 else -1
            self.one[length] = after > 0
        self.n[length] = after

    def largest(self, most: int) -> int:
        """The greatest length of at most most tokens, 0 if there is none."""
        found = np.flatnonzero(self.one[: most + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, total: int, most: int | None = None) -> tuple[int, ...]:
        """Two lengths that add up to total, the first as great as can be (and at most most)."""
        if total < 2 or not self.sums[total]:
            return ()
        a = np.arange(min(total - 1, most or total), (total - 1) // 2, -1)
        good = self.one[a] & self.one[total - a] & ((2 * a != total) | (self.n[a] > 1))
        return (int(a[at]), int(total - a[at])) if len(a) and good[at := int(good.argmax())] else ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill a gap exactly, the fewest; none if there are none."""
        if self.one[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        a = np.arange(gap - 2, 0, -1)
        for x in a[self.one[a] & (self.sums[gap - a] > 0)].tolist():
            if 3 * x < gap:
                break
            self.add(x, -1)
            two = self.pair(gap - x, x)
            self.add(x, 1)
            if two:
                return (x, *two)
        return ()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many sequences are like that): uses up counts (pieces by length, each 1 to capacity).

    A length that no piece or two or three pieces complete takes the longest that fits beside it first, and so on; one that
    still leaves a gap waits for best fit. Work grows with the number of lengths, not of pieces.
    """
    stock, out = _Stock(counts, capacity), []
    for length in sorted(counts, reverse=True):
        while stock.n[length]:
            stock.add(length, -1)
            used, gap = [length], capacity - length
            while gap and not (rest := stock.exact(gap)) and (more := stock.largest(gap)):
                stock.add(more, -1)
                used.append(more)
                gap -= more
            if gap and not rest:
                for x in used:
                    stock.add(x, 1)
                break
            for x in rest if gap else ():
                stock.add(x, -1)
                used.append(x)
            need = Counter(used)
            times = min(int(stock.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                stock.add(x, -times * k)
            out.append((tuple(used), times + 1))
    return out + best_fit({int(x): int(stock.n[x]) for x in np.flatnonzero(stock.one)}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pieces by falling length, each where the least room is left; equal ones at once."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, dtype=bool)

    def put(used: tuple[int, ...], times: int) -> None:
        if times:
            gap = capacity - sum(used)
            room[gap].append((used, times))
            open_[gap] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(open_[length:])
            gap = int(fits[0]) + length if len(fits) else capacity
            used, times = room[gap].pop() if len(fits) else ((), left)
            open_[gap] = bool(room[gap])
            each = gap // length
            full = min(times, left // each)
            put(used + (length,) * each, full)
            left -= full * each
            if full < times and 0 < left < each:
                put(used + (length,) * left, 1)
                left, full = 0, full + 1
            if used:
                put(used, times - full)
    return [x for some in room for x in some]


def pack(found: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """found (length, ...; a stored table) plus sequence_id and offset.

    order names columns that tell pieces of one length apart; those that it doesn't are dealt in any order. Sequences are
    numbered from 0; a sequence's pieces lie one after another from 0. No pieces give no rows. The driver sees pieces by
    length, capacity rows at most, and sends tasks the plan, whose size depends on these lengths alone.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, firsts, offsets, used, base = [], [], [], Counter(), 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for x in lengths:
            keys.append((x << _RANK_BITS) + used[x])
            firsts.append(base - used[x])
            offsets.append(offset)
            used[x] += times
            offset += x
        base += times
    by_key = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    lookup = spark.sparkContext.broadcast([np.array(c, dtype=np.int64)[by_key] for c in (keys, firsts, offsets)])
    idx, n = free(found.columns, "__idx", "__n")
    placed = ranked(found, "length", order, idx, n).drop(n)
    schema = T.StructType([*placed.drop(idx).schema.fields, *T.StructType.fromDDL("sequence_id bigint, offset bigint").fields])

    def place(batches):
        keys, firsts, offsets = lookup.value
        for batch in batches:
            rank = batch.column(idx).to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << _RANK_BITS) + rank, side="right") - 1
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != idx]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(firsts[at] + rank), pa.array(offsets[at])], names=schema.names)

    return placed.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that have their ids: what a trainer reads, a row a sequence."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("p"))
    return joined.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document's pieces and their places."""
    found = stored(pieces(table(spark, sf_dir, "documents"), ["doc_id"]))
    out = pack(found, ["doc_id", "piece", "ids_crc32"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
