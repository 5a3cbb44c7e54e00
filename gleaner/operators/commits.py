"""Atomic versions of a set of tables in a shared folder.

Tables of a version are written under `versions/`, into a folder of the attempt's own. A version exists once its commit,
one small file under `commits/`, is there: it is written beside and renamed, which fails if another writer's is there
already. The highest commit is the current version. A writer that dies leaves a folder that nothing refers to, and a
retry takes a new one; readers never see half a version, and old versions stay readable until `prune`.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NUMBER = re.compile(r"^(\d{12})\.json$")


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was going to be."""


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    label: str


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return path, path(root).getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf)


def _names(spark: SparkSession, root: str, folder: str) -> list[str]:
    path, fs, _ = _fs(spark, root)
    at = path(f"{root}/{folder}")
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def latest(spark: SparkSession, root: str) -> Commit | None:
    """The current version; None where none was ever committed. Versions that need an earlier one without any commit are an error."""
    numbers = [int(m[1]) for n in _names(spark, root, "commits") if (m := _NUMBER.match(n))]
    if not numbers:
        lost = [v for v in _names(spark, root, "versions") if not v.startswith(f"{1:012d}-")]
        if lost:
            raise FileNotFoundError(f"{root}/commits is gone, but there are versions that follow a committed one: {', '.join(sorted(lost)[:3])}")
        return None
    text = "".join(r[0] for r in spark.read.text(f"{root}/commits/{max(numbers):012d}.json").collect())  # one short line
    body = json.loads(text)
    return Commit(max(numbers), f"{root}/versions/{body['folder']}", body["label"])


def _publish(spark: SparkSession, root: str, number: int, folder: str, label: str) -> None:
    path, fs, context = _fs(spark, root)
    fs.mkdirs(path(f"{root}/commits"))
    beside, final = path(f"{root}/commits/.{folder}"), path(f"{root}/commits/{number:012d}.json")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps({"folder": folder, "label": label}).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    try:
        context.rename(beside, final, none)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            fs.delete(beside, False)
            raise Conflict(f"version {number} of {root} is committed already") from e
        raise


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int, label: str) -> Commit:
    """Write tables as the version that follows version `after` (0: none); Conflict if there is one by then."""
    now = latest(spark, root)
    if (now.number if now else 0) != after:
        raise Conflict(f"{root} is at version {now.number if now else 0}, not {after}")
    folder = f"{after + 1:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{root}/versions/{folder}/{name}")
    _publish(spark, root, after + 1, folder, label)
    return Commit(after + 1, f"{root}/versions/{folder}", label)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete versions older than the last `keep` ones and what dead writers left of numbers that are committed; their names."""
    now = latest(spark, root)
    if now is None:
        return []
    path, fs, _ = _fs(spark, root)
    current = set()
    for n in range(max(1, now.number - keep + 1), now.number + 1):
        lines = spark.read.text(f"{root}/commits/{n:012d}.json").collect()
        current.add(json.loads("".join(r[0] for r in lines))["folder"])
    gone = [v for v in _names(spark, root, "versions") if v not in current and int(v[:12]) <= now.number]
    for v in gone:
        fs.delete(path(f"{root}/versions/{v}"), True)
    return gone
