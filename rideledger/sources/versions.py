"""Tables in versions: readers see one version whole, and a new one writes only the partitions that change.

A version is a small file that names, for each table and partition, the folder that holds it. Data is written to new
folders first and the version's file renamed into place last, so that a reader has the version before or the one after,
never a part. Folders of partitions that don't change are named again, not written. One job writes at a time; any number
read. All of it goes through Hadoop's file systems, so it works in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file at most.
FILE_ROWS = 5_000_000
#: Characters that Spark writes differently in a folder's name; identifiers that have them can't be partitions.
_SPECIAL = set('"#%\'*/:=?\\{[]^') | {chr(i) for i in range(32)} | {"\x7f"}


@dataclass(frozen=True)
class Version:
    """number 0 is the empty table. tables: name -> partition (a=1/b=2) -> folder of the load that wrote it."""

    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches."""
    where, fs = _path(spark, pattern)
    return [str(s.getPath()) for s in fs.globStatus(where) or []]


def count_files(spark: SparkSession, folder: str) -> int:
    """Files with anything in them in a folder and those below it, hidden ones and marks left out."""
    where, fs = _path(spark, folder)
    found, n, root = fs.listFiles(where, True), 0, str(fs.makeQualified(where))
    while found.hasNext():
        file = found.next()
        inside = str(file.getPath()).removeprefix(root)
        n += file.getLen() > 0 and not any(part[:1] in ("_", ".") for part in inside.split("/"))
    return n


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def partition(by: list[str], values: tuple[str, ...]) -> str:
    """The name of a partition, as Spark writes it."""
    for v in values:
        if not v or _SPECIAL & set(v):
            raise ValueError(f"{v!r} can't name a partition")
    return "/".join(f"{c}={v}" for c, v in zip(by, values, strict=True))


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in names(spark, f"{root}/versions/[0-9]*.json"))


def version(spark: SparkSession, root: str, number: int) -> Version:
    where, fs = _path(spark, f"{root}/versions/{number:010d}.json")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(**json.loads(text))


def latest(spark: SparkSession, root: str) -> Version:
    """The newest version; number 0 where there is none."""
    numbers = _numbers(spark, root)
    return version(spark, root, numbers[-1]) if numbers else Version()


def read(spark: SparkSession, root: str, of: Version, table: str, schema: str, only: set[str] | None = None) -> DataFrame:
    """A table of a version, or only some of its partitions. Partition columns are in schema and stay text."""
    held = of.tables.get(table, {})
    folders = [f"{root}/data/{table}/{load}/{part}" for part, load in sorted(held.items()) if only is None or part in only]
    if not folders:
        return spark.createDataFrame([], schema)
    # Loads differ by folder, so that they are a partition column too; it is no part of the table.
    wide = spark.read.schema(f"{schema}, load string").option("basePath", f"{root}/data/{table}").parquet(*folders)
    return wide.drop("load")


def publish(spark: SparkSession, root: str, base: Version, frames: dict[str, DataFrame], by: list[str], replaced: set[str], note: dict) -> Version:
    """The version after base: partitions in replaced are what frames have of them, perhaps nothing; others stay.

    Frames are written as they are dealt: their caller decides on the number and order of files.
    """
    load, tables = f"load=v{uuid.uuid4().hex}", dict(base.tables)
    for name, frame in frames.items():
        folder = f"{root}/data/{name}/{load}"
        frame.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(folder)
        made = {p.split(f"/{load}/", 1)[1] for p in names(spark, folder + "/*=*" * len(by))}
        if not made <= replaced:
            raise ValueError(f"{name} has partitions that it doesn't replace: {sorted(made - replaced)[:3]}")
        kept = {part: at for part, at in tables.get(name, {}).items() if part not in replaced}
        tables[name] = kept | dict.fromkeys(made, load)
    new = Version(base.number + 1, tables, note)
    final, fs = _path(spark, f"{root}/versions/{new.number:010d}.json")
    if fs.exists(final):
        raise RuntimeError(f"version {new.number} of {root} is there already: another job writes to it")
    temporary, _ = _path(spark, f"{root}/versions/.{load}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    if not fs.rename(temporary, final):
        raise RuntimeError(f"version {new.number} of {root} can't be put in place")
    return new


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Older versions go, and the folders that only they name. keep is as many as readers may still be reading."""
    numbers = _numbers(spark, root)
    for number in numbers[:-keep]:
        delete(spark, f"{root}/versions/{number:010d}.json")
    kept = [version(spark, root, n) for n in numbers[-keep:]]
    used = {f"{table}/{load}/{part}" for v in kept for table, parts in v.tables.items() for part, load in parts.items()}
    for folder in names(spark, f"{root}/data/*/load=*"):
        table_load = "/".join(folder.rsplit("/", 2)[1:])
        parts = {u.removeprefix(f"{table_load}/") for u in used if u.startswith(f"{table_load}/")}
        if not parts:
            delete(spark, folder)
            continue
        depth = next(iter(parts)).count("/") + 1
        for path in names(spark, folder + "/*=*" * depth):
            if path.split(f"/{table_load}/", 1)[1] not in parts:
                delete(spark, path)
