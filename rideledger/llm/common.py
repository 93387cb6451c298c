"""What the text operators share: words, table reads, checkpoints and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: The same white space for str.strip and bytes.translate.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory. Python workers started from now on find this library where the driver found it."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (paths := environment.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows that go to Python at once.
BATCH_ROWS = 1_000
#: The one column that packed() gives to all columns an operator doesn't need.
ROW = "__row"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of docs (null where docs has none) and all others inside one struct, ROW.

    So an operator may name its own columns as it likes, whatever the columns of docs are called.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed] or [F.lit(0).alias("none")]
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).alias(c) for c in needed], F.struct(*others).alias(ROW))


def unpacked(df: DataFrame, docs: DataFrame) -> list[tuple[str, Column]]:
    """(name, column of df) of each column of docs, where df was packed() from docs."""
    inside = set(df.schema[ROW].dataType.names)
    return [(c, F.col(ROW).getField(c) if c in inside else F.col(c)) for c in docs.columns]


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column in taken has it (in any case, as Spark compares them)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def result_schema(docs: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The columns of docs that are kept, then those of a DDL string: what a function over Arrow batches of docs returns.

    Batches of whole texts should be short, or a worker's memory follows 10,000 of them: where the session has Spark's own
    number of rows to a batch, it is lowered to BATCH_ROWS.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + T.StructType.fromDDL(more).fields)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master, whose executors share this machine, gets one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder from now on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is (a shuffled join).

    df should be checkpointed or cheap: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared checkpoint folder and read from there: like checkpoint(), but by columns.

    For tables of which later steps read a few columns each. The folder goes when the session's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before: the folder's owner clears it
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
