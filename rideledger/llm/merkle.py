"""Merkle manifest of a corpus: one hash for all rows, and a proof for each of them.

Each row is a leaf. The leaves of a source make a tree, whose levels are built by joins of a level with itself: a node
looks up its siblings by their computed indices (exclusive or for binary trees, offsets of slots for wider ones), and the
node in slot zero of each run emits the parent. The sources' roots make one more tree in the same way. Proofs then come
down from the root, a join of nodes with their parents at each level, so all levels together move about half as many proofs
as there are rows; no group larger than a run of siblings is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.common import packed, stored, table
from rideledger.llm.ranks import ranked

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, - for null: so no two rows are spelled alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Iterable[Column]) -> Column:
    return digest(*[field(v) for v in values])


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, digest, ...) plus left and right: the digests of the siblings before and after, put together."""
    idx, out = F.col("idx"), nodes
    slot = idx % arity
    for d in range(1, arity):
        # The node that has this one as the sibling d slots on, counted around the run.
        served = idx.bitwiseXOR(F.lit(1)) if arity == 2 else idx - slot + (slot + (arity - d)) % arity
        out = out.join(nodes.select("tree", served.alias("idx"), F.col("digest").alias(f"__s{d}")), ["tree", "idx"], "left")

    def side(before: bool) -> Column:
        of_slot = [[f"__s{(j - s) % arity}" for j in (range(s) if before else range(s + 1, arity))] for s in range(arity)]
        picked = F.lit("")
        for s, names in enumerate(of_slot):
            if names:
                picked = F.when(slot == s, F.concat_ws("", *names)).otherwise(picked)
        return picked

    return out.select(*nodes.columns, side(True).alias("left"), side(False).alias("right"))


def levels(items: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The stored levels of all trees of items (tree, idx, n, digest, ...), from the items up to the last root.

    A tree's root is the node with n = 1; a tree of one item is its item.
    """
    most = items.agg(F.max("n")).first()[0] or 0
    nodes, out = items, []
    while True:
        level = stored(_with_siblings(nodes, arity) if most > 1 else nodes.select("*", F.lit("").alias("left"), F.lit("").alias("right")))
        out.append(level)
        if most <= 1:
            return out
        most = -(-most // arity)
        first = level.where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        up = lambda c: F.floor(c / F.lit(arity)).cast("long")
        nodes = first.select("tree", up(F.col("idx")).alias("idx"), up(F.col("n") + (arity - 1)).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))


def proofs(built: list[DataFrame], roots: DataFrame, arity: int = ARITY) -> DataFrame:
    """The items of levels() plus path: the siblings before and after at each level, from the item up, then the root's own.

    roots: tree, path, ..., one row a tree, with the path that its root has above it; its other columns come along. Each
    level above the items is written, so no plan grows with the number of levels, and a lost executor costs one level.
    """
    more = [c for c in roots.columns if c != "tree"]
    found: DataFrame | None = None
    for level in reversed(built):
        own = [c for c in level.columns if c not in ("left", "right")]
        at = level.where("n = 1").join(roots, "tree").select(*own, *more)
        if found is not None:
            parents = found.select("tree", F.col("idx").alias("__up"), *more)
            inner = level.where("n > 1").withColumn("__up", F.floor(F.col("idx") / arity).cast("long")).join(parents, ["tree", "__up"])
            step = F.array(F.struct("left", "right"))
            at = at.unionByName(inner.select(*own, *[F.concat(step, "path").alias(c) if c == "path" else F.col(c) for c in more]))
        found = at if level is built[0] else stored(at)
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, order: str = "doc_id", group: str = "source", arity: int = ARITY, also: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, subroot, root, path) of each row of docs, and the columns of also, which docs' columns give.

    Leaves of a group ascend by order (nulls first, then by leaf); groups ascend with null first. Null, empty and very long
    values are spelled out by field(). Repeated rows are leaves of their own, side by side, with proofs of their own. An
    empty table has no rows and no root. Columns of docs that aren't named are no part of a leaf, whatever they are called;
    a named column that docs lacks counts as null.
    """
    needed = list(dict.fromkeys([*columns, order, group]))
    rows = packed(docs, *needed)
    leaves = stored(
        rows.select(
            F.col(order).alias("__order"),
            F.col(group).alias("__group"),
            field(F.col(group)).alias("tree"),
            leaf(F.col(c) for c in columns).alias("digest"),
            *[c.alias(f"__also_{name}") for name, c in (also or {}).items()],
        )
    )
    built = levels(ranked(leaves, "tree", ["__group", "__order", "digest"]), arity)
    tops = built[0].sparkSession.createDataFrame([], "tree string, digest string")
    for level in built:
        tops = tops.unionByName(level.where("n = 1").select("tree", "digest"))
    # The order of groups: null first, then by their bytes.
    named = tops.join(leaves.groupBy("tree").agg(F.first("__group").alias("name")), "tree")
    subroots = stored(named.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "name", "digest"))
    over = levels(ranked(subroots, "tree", ["name"]), arity)
    top = over[-1].where("n = 1").select("tree", F.array().cast(_STEPS).alias("path"), F.col("digest").alias("root"))
    groups = proofs(over, top, arity).select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    out = proofs(built, stored(groups), arity)
    return out.select(
        F.col("__order").alias(order), F.col("__group").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path",
        *[F.col(f"__also_{name}").alias(name) for name in also or {}],
    )


def proof_digest(path: Column) -> Column:
    """One digest of all siblings on the way from a leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's leaf and proof; half of the documents lose their line breaks and are found out."""
    docs = table(spark, sf_dir, "documents")
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    again = F.when(tampered, leaf([bare if c == "text" else F.col(c) for c in COLUMNS]))
    out = manifest(docs, also={"again": again})
    folded = out.withColumn("folded_root", fold(F.coalesce("again", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in COLUMNS) + ")"


#: One step of CRC-32 for each bit; a byte is put in before its eight.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"""

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS bare,
    xor({_CRC}, 4294967295) % 2 = 0 AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS lvl, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, lvl, idx // 3),
tops AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS lvl, idx, n, digest FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY lvl, idx // 3),
sides AS (
  SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
over_sides AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM over a JOIN over b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
up AS (
  SELECT doc_id, source, idx AS row, idx AS at, 0 AS lvl, CASE WHEN tampered THEN bare ELSE leaf END AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT u.doc_id, u.source, u.row, u.at // 3, u.lvl + 1, sha256(s.l || u.acc || s.r), u.proof || s.l || s.r
  FROM up u JOIN sides s ON u.source IS NOT DISTINCT FROM s.source AND u.lvl = s.lvl AND u.at = s.idx),
reached AS (
  SELECT u.*, t.digest AS subroot, t.idx AS top FROM (SELECT *, row_number() OVER (PARTITION BY source, row ORDER BY lvl DESC) AS k FROM up) u
  JOIN tops t ON u.source IS NOT DISTINCT FROM t.source WHERE k = 1),
over_up AS (
  SELECT source, row, subroot, top AS at, 0 AS lvl, acc, proof FROM reached
  UNION ALL
  SELECT u.source, u.row, u.subroot, u.at // 3, u.lvl + 1, sha256(s.l || u.acc || s.r), u.proof || s.l || s.r
  FROM over_up u JOIN over_sides s ON u.lvl = s.lvl AND u.at = s.idx),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, row ORDER BY lvl DESC) AS k FROM over_up) WHERE k = 1),
root AS (SELECT digest AS root FROM over WHERE n = 1)
SELECT p.doc_id, p.leaf, d.subroot, root.root, sha256(d.proof) AS proof_sha256, d.acc AS folded_root, d.acc = root.root AS verified
FROM placed p JOIN done d ON p.source IS NOT DISTINCT FROM d.source AND p.idx = d.row, root
"""
