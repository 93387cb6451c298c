"""Token totals by source, language and tokeniser version, kept up to date by signed deltas.

A batch of changes says of documents what they are now (a count) or that they are gone. Against the ledger of earlier
batches each change becomes signed rows: the document's old count taken away, its new one added. The rows' sums are
the batch's delta, and totals are the sum of all deltas; nothing is counted twice or read again.

A batch counts from the moment its mark is set, after its ledger rows and delta are written. A batch that was lost on
the way is written anew over what it left; one that is marked is known, so committing it again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.bpe import VOCABULARY, encoder, row_slices, vocabulary_path
from rideledger.llm.common import checkpoint_folder, result_schema, stored, table

#: The vocabularies of the query: words with ends, and bytes.
VOCABULARIES = (VOCABULARY, "byte_bpe_50k.tiktoken")
KEYS = ["source", "lang", "version"]
_LEDGER = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint, batch_id bigint"
_DELTA = "source string, lang string, version string, docs bigint, tokens bigint, batch_id bigint"


_BYTES: dict = {}


def counter(vocabulary: str) -> Callable[[list[bytes]], list[int]]:
    """What counts the tokens of each of some texts with a vocabulary file: a ranks file (.tiktoken) or a word-end one."""
    path = vocabulary_path(vocabulary)
    if not vocabulary.endswith(".tiktoken"):
        e = encoder(path)

        def by_words(texts: list[bytes]) -> list[int]:
            split, ids = e.words(texts)
            return [sum(map(len, map(ids.__getitem__, words))) // 4 for words in split]

        return by_words
    if path not in _BYTES:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _BYTES[path] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(_BYTES[path].encode_ordinary(t.decode())) for t in texts]


def version_of(vocabulary: str) -> str:
    return vocabulary.split(".")[0]


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabularies: tuple[str, ...] = (VOCABULARY,)) -> DataFrame:
    """keep columns, version (a vocabulary's name) and n_tokens (bigint) of the whole text: a row for each vocabulary.

    Null and empty texts have 0. Each text is read once for all vocabularies. Columns kept under these two names give
    way to them.
    """
    keep = [c for c in keep if c not in ("version", "n_tokens")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text))

    def task(batches):
        count = [(version_of(v), counter(v)) for v in vocabularies]
        for batch in batches:
            for at, some in row_slices(batch.column(len(keep))):
                own = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                for version, n in count:
                    yield pa.RecordBatch.from_arrays([*own, pa.array([version] * len(some)), pa.array(n(some), pa.int64())], names=[*keep, "version", "n_tokens"])

    return source.mapInArrow(task, result_schema(docs, keep, "version string, n_tokens bigint"))


class Rollup:
    """The ledger and the deltas in a folder that every executor sees."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ledger, self.deltas, self.marks = f"{folder}/ledger", f"{folder}/deltas", f"{folder}/marks"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of the batches that count."""
        path, files = self._path(self.marks)
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def _read(self, folder: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder).filter(F.col("batch_id").isin(batches))

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Add a batch of changes: doc_id, version, source, lang, n_tokens (null: the document is gone), seq. Whether it was new.

        Of several changes of a document in a batch the one with the highest seq counts (then the largest count and
        names). A document that is there already is revised, one that isn't is inserted, and deleting it then does
        nothing. Rows without a doc_id can't be met again: they are inserted as they are. Null sources and languages
        are keys of their own. Batches are numbered in the order of what they say: a number below a known one is an
        error, as later batches have been worked out without it.
        """
        known = self.batches()
        if batch_id in known:
            return False
        if known and batch_id < known[-1]:
            raise ValueError(f"batch {batch_id} comes after batch {known[-1]}")
        changes = stored(changes.select("doc_id", "version", "source", "lang", "n_tokens", "seq"))
        latest = changes.filter("doc_id is not null").groupBy("doc_id", "version").agg(F.max(F.struct("seq", "n_tokens", "source", "lang")).alias("c"))
        new = latest.select("doc_id", "c.source", "c.lang", "version", "c.n_tokens")
        loose = changes.filter("doc_id is null").select("doc_id", "source", "lang", "version", "n_tokens")
        plus = new.unionByName(loose).filter("n_tokens is not null").select("doc_id", *KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("n_tokens").alias("tokens"))
        before = self._read(self.ledger, _LEDGER, known)
        old = before.join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi").groupBy("doc_id", *KEYS)
        minus = old.agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).filter("docs <> 0 or tokens <> 0")
        plus.unionByName(minus).write.mode("overwrite").parquet(f"{self.ledger}/batch_id={batch_id}")
        signed = self._read(self.ledger, _LEDGER, [batch_id])
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.deltas}/batch_id={batch_id}")
        path, files = self._path(f"{self.marks}/{batch_id}")
        files.create(path).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all batches that count; keys without documents are left out."""
        sums = self._read(self.deltas, _DELTA, self.batches()).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")


#: Characters that a revision takes out.
NOISE = r"[#*$%&|<>]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: totals after all documents came in, exact copies of earlier ones went, and noisy texts were counted anew.

    The last two batches are committed twice, as after a lost acknowledgement.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{checkpoint_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    change = lambda df, seq: df.withColumn("seq", F.lit(seq).cast("bigint"))
    counted = lambda df: count_tokens(df, ["doc_id", "source", "lang"], vocabularies=VOCABULARIES)
    rollup.commit(0, change(counted(docs), 0))
    # Copies are the documents that are not the first with their text: met by their own ids, however many share a text.
    firsts = docs.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    copies = stored(docs.filter("doc_id is not null").select("doc_id", "source", "lang").join(firsts, "doc_id", "left_anti"))
    versions = F.explode(F.array(*[F.lit(version_of(v)) for v in VOCABULARIES]))
    gone = copies.select("doc_id", versions.alias("version"), "source", "lang", F.lit(None).cast("bigint").alias("n_tokens"))
    noisy = docs.filter(F.col("text").rlike(NOISE)).join(copies.select("doc_id"), "doc_id", "left_anti")
    revised = counted(noisy.withColumn("text", F.regexp_replace("text", NOISE, "")))
    for batch, changes in ((1, gone), (2, revised), (1, gone), (2, revised)):
        rollup.commit(batch, change(changes, batch))
    return rollup.totals()
