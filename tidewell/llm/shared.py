"""Places and small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows alike that one task makes again of their number.
COPIES = 10_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (local tests), a fresh folder is made and set on the session.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidewell.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tidewell.shared.dir", base)
    return base.rstrip("/")


def find_package(spark: SparkSession) -> None:
    """Python workers on this machine find this package where the driver found it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: later jobs start from the files,
    and an executor that goes away takes nothing with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeated(df: DataFrame, copies: str, number: str) -> DataFrame:
    """Rows of ``df`` as many times as its column ``copies`` says, numbered from 0 in column ``number``. They are cut in
    blocks of `COPIES` first, which go to tasks by their own hash, so that no task makes all copies of a row."""
    last = F.floor((F.col(copies) - 1) / COPIES)
    blocks = df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(number, F.col(number) * COPIES)
    dealt = blocks.repartition(F.xxhash64(*blocks.columns))
    return dealt.withColumn(number, F.explode(F.sequence(F.col(number), F.least(F.col(number) + COPIES, F.col(copies)) - 1)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` is used where it means the same and is faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where columns of ``df`` have them (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
