"""Join of near-equal documents by their word shingles: lossless blocks, then count-vector R-trees, then verification.

A document's set has its distinct shingles of WORDS words, as 64-bit hashes. Equal sets are one class from the start.

Blocks. Two linked sets differ in at most D shingles, D growing with their sizes. Hashed into more than D groups, they
have a group in common that holds the same shingles on both sides; so sets that share no group's contents are never
linked. Groups of one or two shingles say little and are left out wherever a set has enough others.

Trees. A set's shingles are hashed into groups, a few to each, whose counts are a point. Points are packed into leaves with
their largest counts: the overlap of two sets is at most the sum of the smaller counts, of a set and any in a leaf at
most the sum against the leaf's largest counts. Each block's points, without their sets, go through such a tree, which
leaves links that the bound allows, as few as connect what it allows. What these connect over all blocks is a cluster.

Verification. Each class's set goes to its cluster's task once, through a tree again, and what the bound leaves is
verified on the sets, best bound first, between sets that earlier links haven't connected yet. Blocks and clusters
with very many classes are dealt out as pairs of tiles, so none has to fit in a task.
"""

from __future__ import annotations


import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.bpe import slices
from rideledger.llm.common import broadcast_checked, checkpoint, packed, stored, table, unpacked
from rideledger.llm.components import components

WORDS = 3
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Shingles meant to fall into each group of a point, and the least and most bits that number groups.
PER_GROUP, MIN_BITS, MAX_BITS = 1.5, 4, 14
LEAF = 32
#: Classes of a block or cluster that a task takes whole; more are dealt out as pairs of tiles.
TILE_CLASSES = 2_000
#: Sizes are dealt with in classes whose bounds grow by this factor.
RATIO = 1.5
TINY = 3
CACHE_WORDS = 300_000
#: Classes in candidate clusters up to this number are broadcast (24 bytes each) to pick their texts; above it, a join.
BROADCAST_CLASSES = 1_000_000
#: Keys that two classes share, up to this number, are broadcast (8 bytes each); above it, a shuffled join.
BROADCAST_KEYS = 2_000_000
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x + _U(salt)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_SEEN = _Hashes()


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text in order of their hashes; A-Z count as a-z. Fewer words than size are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    if len(_SEEN) > CACHE_WORDS:
        _SEEN.clear()
    h = np.fromiter(map(_SEEN.__getitem__, words), dtype=_U, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, dtype=_U)
    for j in range(min(size, len(h))):
        out = mix(out ^ h[j : j + n], j + 1)
    return np.unique(out)


def _bound(k: int, percent: int) -> int:
    """The smallest size of class k; sets below that of class 0 link with equal sets only."""
    return int(-(-(100 + percent) // (2 * (100 - percent))) * RATIO**k)


def _most_apart(k: int, percent: int) -> int:
    """In how many shingles two linked sets can differ if the larger one's size is in class k."""
    # |A|+|B| - 2|A and B| with |A and B| >= p(|A|+|B|)/(1+p)
    return (100 - percent) * 2 * (_bound(k + 1, percent) - 1) // (100 + percent)


def block_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the contents of a set's groups, for its own size class and any larger one that holds a partner.

    Groups of few shingles, by which unrelated sets meet, are left out if more groups than can differ are larger: of
    two linked sets, the one with the higher bar then has a larger group that is the same in the other.
    """
    n, out = len(s), []
    reach = n * 100 // percent
    k = 0
    while _bound(k, percent) <= reach:
        if n < _bound(k + 1, percent):
            apart = _most_apart(k, percent)
            m = (apart + 1) * (103 if percent >= 90 else 115) // 100 + 3
            g = ((s >> _U(32)) * _U(m)) >> _U(32)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(starts, n))
            keys = np.add.reduceat(mix(s, 11), starts) + mix(g[starts], 1000 + k)
            bar = next((t for t in range(TINY, 0, -1) if np.count_nonzero(sizes >= t) > apart), 0)
            if bar:
                keys = keys[sizes >= bar]
            else:
                keys = np.concatenate([keys, mix(np.setdiff1d(np.arange(m, dtype=_U), g[starts]), 1000 + k)])
            out.append(mix(keys, 12))
        k += 1
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(np.add.reduce(mix(s, 21)) if len(s) else 0), int(np.bitwise_xor.reduce(mix(s, 22)) if len(s) else 0)


def point(s: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall into each group, with about PER_GROUP to a group, so that sets without much in
    common lie far apart whatever their size. The number of groups is a power of two: points fold onto fewer groups."""
    groups = 1 << int(np.clip(np.log2(max(1, len(s) / PER_GROUP)), MIN_BITS, MAX_BITS))
    return np.bincount((s >> _U(40)).astype(np.int64) % groups, minlength=groups).astype("<u2" if len(s) < 65_536 else "<u4")


def stacked(points: list[np.ndarray]) -> np.ndarray:
    """Points as rows, folded onto the fewest groups that one of them has."""
    groups = min(map(len, points))
    return np.stack([p.reshape(-1, groups).sum(axis=0, dtype=np.int32) for p in points])


def _packed(p: np.ndarray) -> bytes:
    return bytes([p.itemsize]) + p.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)


def _signed(x) -> np.ndarray:
    return np.array(x, dtype=_U).view(np.int64)


def sets(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, place (hash of the text), n, node and twin (128 bits of the set), point, keys of each row of docs."""

    def task(batches):
        for batch in batches:
            texts, at = batch.column(2).cast(pa.binary()).to_pylist(), 0
            for some in slices(texts):
                n, node, twin, points, keys = [], [], [], [], []
                for text in some:
                    s = shingle_set(text, size)
                    a, b = _identity(s)
                    n.append(len(s))
                    node.append(a)
                    twin.append(b)
                    points.append(_packed(point(s)))
                    keys.append(block_keys(s, percent))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), pa.array(n, pa.int64()), pa.array(_signed(node)), pa.array(_signed(twin)), pa.array(points, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "place", "n", "node", "twin", "point", "keys"],
                )
                at += len(some)

    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("place"), text.alias("text"))
    return source.mapInArrow(task, f"doc_id {dict(docs.dtypes)['doc_id']}, place bigint, n bigint, node bigint, twin bigint, point binary, keys array<bigint>")


def tree_links(n: np.ndarray, points: np.ndarray, verify=None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (positions in n and points) that connect just what all pairs connect that the bound, and verify, allow."""
    # Runs of like sizes, inside a run by the first counts: leaves hold points that lie together.
    run = np.argsort(n, kind="stable")
    order = np.concatenate([r[np.lexsort((points[r, 2], points[r, 1], points[r, 0]))] for r in np.array_split(run, max(1, len(run) // (LEAF * LEAF)))])
    n, points = n[order].astype(np.int64), points[order]
    first = np.arange(0, len(order), LEAF)
    most, least, largest = np.maximum.reduceat(points, first), np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    label, links = np.arange(len(order)), []
    for i in range(1, len(order)):
        upto = i // LEAF + 1
        low, high = n[i] * percent, n[i] * 100
        near = (largest[:upto] * 100 >= low) & (least[:upto] * percent <= high)
        leaf = np.flatnonzero(near & (np.minimum(most[:upto], points[i]).sum(axis=1) * (100 + percent) >= percent * (n[i] + least[:upto])))
        j = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        j = j[j < i]
        j = j[(label[j] != label[i]) & (n[j] * 100 >= low) & (n[j] * percent <= high)]
        overlap = np.minimum(points[j], points[i]).sum(axis=1)
        passed = overlap * (100 + percent) >= percent * (n[i] + n[j])
        j = j[passed][np.argsort(-overlap[passed], kind="stable")]
        while len(j):
            if verify is None or verify(order[i], order[j[0]]):
                links.append((int(order[i]), int(order[j[0]])))
                label[label == label[j[0]]] = label[i]
                j = j[label[j] != label[i]]
            else:
                j = j[1:]
    return links


def _deal(df: DataFrame) -> DataFrame:
    """df (node, tiles, ...) with low and high: every two rows of the same group are together for one (low, high)."""
    own = df.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", "tiles")


def block_links(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that the bound allows inside blocks (key, node, tiles, n, point), as few as connect them."""

    def task(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                whole, upto = rest, 0 if rest is None else rest.num_rows
            else:
                whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                upto = None
            if not (whole and whole.num_rows):
                continue
            names = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")])
            starts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
            ends = np.append(starts[1:], whole.num_rows)
            if upto is None:  # the last block may go on in the next batch
                starts, ends, rest = starts[:-1], ends[:-1], whole.slice(int(starts[-1]))
            node, n = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            points = [_unpacked(x) for x in whole.column("point").to_pylist()]
            out = [(node[a + i], node[a + j]) for a, b in zip(starts, ends, strict=True) if b - a > 1 for i, j in tree_links(n[a:b], stacked(points[a:b]), None, percent)]
            found = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    dealt = _deal(blocks).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.select("key", "low", "high", "node", "n", "point").mapInArrow(task, "a bigint, b bigint").distinct()


def link_classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, tile: int = TILE_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: doc_id, place, n, node, twin. classes: node, twin, first (none, doc_id, place of the first row
    of its component) of each class of equal sets."""
    found = stored(sets(docs, size, percent))
    full = found.filter("n > 0")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    classes = stored(full.groupBy("node", "twin").agg(F.min(head).alias("head"), F.first(F.struct("n", "point")).alias("c")).select("node", "twin", "head", "c.*"))
    keys = full.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key")
    hits = stored(keys.join(broadcast_checked(stored(shared), BROADCAST_KEYS), "key").distinct())
    half = lambda h: F.sum(h.bitwiseAND(F.lit(2**32 - 1).cast("long")))
    h = F.xxhash64("node")
    who = [F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most"), half(h).alias("s1"), half(F.shiftrightunsigned(h, 32)).alias("s2")]
    # Near copies share most of their groups, in many blocks of the same members: one of these is enough.
    blocks = hits.groupBy("key").agg(*who).groupBy("members", "least", "most", "s1", "s2").agg(F.min("key").alias("key"))
    blocks = blocks.select("key", F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
    members = hits.join(blocks, "key").join(classes.select("node", "n", "point"), "node")
    clusters = checkpoint(components(block_links(members, percent)))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"))
    wanted = stored(
        clusters.join(sizes, "root").join(classes.select("node", "head"), "node").select(
            "node", "root", F.ceil(F.col("members") / tile).cast("int").alias("tiles"), F.col("head.doc_id").alias("w_doc"), F.col("head.place").alias("w_place")
        )
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = (
        docs.select("doc_id", F.xxhash64(text).alias("place"), text.alias("text"))
        .join(broadcast_checked(wanted, BROADCAST_CLASSES), (F.col("place") == F.col("w_place")) & F.col("doc_id").eqNullSafe(F.col("w_doc")))
        .select("node", "root", "tiles", "text")
    )

    def to_sets(batches):
        for batch in batches:
            raw = [shingle_set(t, size).tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["node", "root", "tiles", "members"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        node, members = pdf["node"].to_numpy(), [np.frombuffer(x, dtype=_U) for x in pdf["members"]]

        def linked(i: int, j: int) -> bool:
            a, b = members[i], members[j]
            shared = np.count_nonzero(np.isin(a, b, assume_unique=True))
            return 100 * shared >= percent * (len(a) + len(b) - shared)

        sizes = np.array([len(m) for m in members])
        got = tree_links(sizes, stacked([point(m) for m in members]), linked, percent) if len(members) > 1 else []
        return pd.DataFrame([(node[i], node[j]) for i, j in got], columns=["a", "b"], dtype="int64")

    dealt = _deal(picked.mapInArrow(to_sets, "node bigint, root bigint, tiles int, members binary"))
    links = dealt.groupBy("root", "low", "high").applyInPandas(solve, "a bigint, b bigint")
    joined = components(links)
    firsts = joined.join(classes.select("node", "head"), "node").groupBy("root").agg(F.min("head").alias("best"))
    named = joined.join(firsts, "root").select(F.col("node").alias("l_node"), "best")
    out = classes.join(named, F.col("node") == F.col("l_node"), "left").select("node", "twin", F.coalesce("best", "head").alias("first"))
    return found.drop("keys", "point"), out


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, place, n_shingles, component_id, first (is this row's text and id the component's first) of each row of docs.

    Null and blank texts have no shingles and are alone. Rows with equal sets are one component however they repeat. A
    null doc_id is no smallest id; a component of such rows alone has a null id.
    """
    rows, classes = link_classes(docs, size, percent)
    linked = rows.filter("n > 0").join(classes, ["node", "twin"])
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    kept = linked.select("doc_id", "place", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (head == F.col("first")).alias("is_first"))
    alone = rows.filter("n = 0").select("doc_id", "place", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return kept.unionByName(alone)


def stage(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs less all but the first document of each component, first by doc_id, then by the hash of its text.

    Rows that repeat both id and text (null ids and texts among them) are one document, of which one row stays: any, where
    its other columns differ. Columns may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs, "doc_id", "text").withColumn("place", F.xxhash64(text))
    judged = join(docs.select("doc_id", "text"), size, percent)
    one = judged.groupBy("doc_id", "place").agg(F.min("is_first").alias("is_first"), F.count("*").alias("times"))
    gone = one.filter(~F.col("is_first")).select(F.col("doc_id").alias("g_id"), F.col("place").alias("g_place"))
    again = one.filter("is_first and times > 1").select(F.col("doc_id").alias("a_id"), F.col("place").alias("a_place"), F.lit(True).alias("again"))
    same = lambda i, p: (F.col("place") == F.col(p)) & F.col("doc_id").eqNullSafe(F.col(i))
    rows = rows.join(broadcast_checked(stored(gone), BROADCAST_CLASSES), same("g_id", "g_place"), "left_anti")
    rows = rows.join(broadcast_checked(stored(again), BROADCAST_CLASSES), same("a_id", "a_place"), "left")
    once = rows.filter("again").dropDuplicates(["doc_id", "place"])
    out = rows.filter("again is null").unionByName(once)
    return out.select(*[column.alias(name) for name, column in unpacked(out, docs)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document with its number of shingles and its component."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


