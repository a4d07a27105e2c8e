"""Versioned tables: a generation is a set of Parquet folders, published by one rename.

A folder `root` holds the written data and, in `_generations`, a small file per generation that lists the folders of every table. A writer first
writes all data and then the list under a name of its own, and renames that to the next number. The rename fails where the number is taken, so of two writers one
loses, and a writer that dies before it leaves the former generation as it was. Readers take the highest number. On stores whose rename
is not atomic, let one writer run at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LISTS = "_generations"


class Conflict(RuntimeError):
    """Another writer published the generation first."""


@dataclass(frozen=True)
class Generation:
    number: int
    tables: dict[str, list[str]]
    schemas: dict[str, str]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.schemas[name]))).parquet(*self.tables[name])


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, lists = _fs(spark, f"{root}/{LISTS}")
    if not fs.exists(lists):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(lists)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def current(spark: SparkSession, root: str) -> Generation | None:
    """The newest generation of `root`, None before the first."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    fs, path = _fs(spark, f"{root}/{LISTS}/{numbers[-1]:010d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Generation(numbers[-1], **json.loads(text))


def new_folder(root: str, number: int) -> str:
    """Where a writer of generation `number` puts its data."""
    return f"{root}/{number:010d}-{uuid.uuid4().hex}"


def write(df: DataFrame, folder: str, name: str) -> str:
    df.write.parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def publish(spark: SparkSession, root: str, generation: Generation) -> Generation:
    """Make written folders the newest generation; raises Conflict where its number is taken."""
    fs, target = _fs(spark, f"{root}/{LISTS}/{generation.number:010d}.json")
    _, own = _fs(spark, f"{root}/{LISTS}/_{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    stream = fs.create(own)
    stream.write(json.dumps({"tables": generation.tables, "schemas": generation.schemas}).encode())
    stream.close()
    if fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, False)
        raise Conflict(f"generation {generation.number} of {root} was published by another writer")
    return generation


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete the lists of all but the newest `keep` generations, and data that no list kept names and no later writer can own."""
    numbers = _numbers(spark, root)
    if not numbers:
        return
    fs, lists = _fs(spark, f"{root}/{LISTS}")
    kept = numbers[-keep:]
    used = set()
    for n in kept:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{LISTS}/{n:010d}.json"))
        used |= {f.rsplit("/", 2)[-2] for folders in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"].values() for f in folders}
        stream.close()
    for n in numbers[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{LISTS}/{n:010d}.json"), False)
    for status in fs.listStatus(lists.getParent()):
        name = status.getPath().getName()
        if name != LISTS and name not in used and int(name.split("-")[0]) <= kept[-1]:
            fs.delete(status.getPath(), True)
