"""Tables of Parquet folders that are read at one version and changed by one rename.

Below a root, ``data`` has the folders that loads wrote, one for each bucket of a key, and ``versions`` a small JSON file
for each version, which names the folders of each table's buckets. Files are never changed: a load writes new folders
and then the next version's file under another name, which it renames. A rename onto a version that is already there
fails, so of two loads at once one has to start again. A reader stays with the folders of its version; a load that
stops on its way leaves nothing but folders that no version names, and `vacuum` removes those.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Parts = dict[str, list[str]]


class Conflict(RuntimeError):
    """Another load has made this version in the meantime."""


class Version(NamedTuple):
    number: int
    #: name of a table -> (schema as JSON, bucket -> folders)
    tables: dict[str, tuple[str, Parts]]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def latest(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """Version ``number``, or the newest; None if there is none."""
    found = [n for n in _names(spark, f"{root}/versions") if n.endswith(".json")]
    name = found[-1] if number is None and found else f"{number:012d}.json" if number is not None else None
    if name not in found:
        return None
    text = "\n".join(r["value"] for r in spark.read.text(f"{root}/versions/{name}").collect())
    return Version(int(name[:-5]), {k: (s, p) for k, (s, p) in json.loads(text).items()})


def read(spark: SparkSession, root: str, version: Version, table: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of ``table``, of some buckets only if they are given."""
    schema, parts = version.tables[table]
    kind = StructType.fromJson(json.loads(schema))
    folders = [f"{root}/{f}" for b, fs in sorted(parts.items()) if buckets is None or int(b) in buckets for f in fs]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(root: str, rows: DataFrame, bucket: Column | None, order: list[str] | None = None) -> tuple[str, Parts]:
    """(schema, bucket -> new folders) of ``rows``. Large buckets become several files, sorted by ``order``. Without
    ``bucket`` rows are written by the tasks that make them, neither dealt out nor sorted, as one bucket."""
    spark, load = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    if bucket is None:
        rows.write.option("compression", "zstd").parquet(f"{root}/{load}/_bucket=0")
        return rows.schema.json(), {"0": [f"{load}/_bucket=0"]}
    dealt = rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket")
    dealt.sortWithinPartitions("_bucket", *(order or [])).write.partitionBy("_bucket").parquet(f"{root}/{load}")
    parts = {n.split("=")[1]: [f"{load}/{n}"] for n in _names(spark, f"{root}/{load}") if n.startswith("_bucket=")}
    return rows.schema.json(), parts


def commit(spark: SparkSession, root: str, base: Version | None, tables: dict[str, tuple[str, Parts]]) -> Version:
    """Makes the version after ``base`` with ``tables`` in place of its own; its other tables stay."""
    new = Version(base.number + 1 if base else 0, {**(base.tables if base else {}), **tables})
    fs, draft = _fs(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new.tables).encode()))
    out.close()
    jvm, name = spark._jvm, f"{root}/versions/{new.number:012d}.json"
    at = jvm.org.apache.hadoop.fs.Path(name)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(at):
            raise Conflict(f"{name} is there already; read it and load again") from e
        raise
    return new


def upsert(spark: SparkSession, root: str, table: str, base: Version | None, rows: DataFrame, key: str, buckets: int, gone: DataFrame | None = None) -> tuple[str, Parts]:
    """(schema, parts) of ``table`` after ``rows``, distinct by ``key``, took the place of stored rows of their keys and rows
    of the keys ``gone`` went. Only buckets that hold such keys are written anew."""
    if not base or table not in base.tables:
        return write(root, rows, bucket_of(key, buckets), [key])
    keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
    touched = [r["b"] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect()]
    kept = read(spark, root, base, table, touched).join(keys, key, "left_anti")
    schema, parts = write(root, kept.unionByName(rows), bucket_of(key, buckets), [key])
    return schema, {**{b: f for b, f in base.tables[table][1].items() if int(b) not in touched}, **parts}


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes all but the newest ``keep`` versions, and folders that no kept version names; returns how many folders. Not
    for a root that is being read at an older version or written."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json")]
    used = {f for n in numbers[-keep:] for _, parts in latest(spark, root, n).tables.values() for fs in parts.values() for f in fs}
    for n in numbers[:-keep]:
        fs, at = _fs(spark, f"{root}/versions/{n:012d}.json")
        fs.delete(at, False)
    gone = 0
    for load in _names(spark, f"{root}/data"):
        for part in _names(spark, f"{root}/data/{load}"):
            if f"data/{load}/{part}" not in used and part.startswith("_bucket="):
                fs, at = _fs(spark, f"{root}/data/{load}/{part}")
                gone += fs.delete(at, True)
    return gone
