"""Registered queries: a DataFrame over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyword
from ..shared import find_package, shared_dir
from ..sources import versions
from .fixtures import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GIVEN: dict[str, tuple[Callable, str | None]] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Views:
    """Tables and fixture views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        find_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def kept(self, name: str, source: DataFrame, build: Callable[[str], object]) -> str:
        """A root below the shared folder that ``build`` fills when it is first asked for, and again for other files of
        ``source``, or ones that were changed."""
        file = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
        files = source.select(F.xxhash64(*file).alias("h")).distinct().agg(F.expr("coalesce(bit_xor(h), 0)").alias("h"), F.count("*").alias("n")).first()
        root = f"{shared_dir(self.spark)}/kept-{name}-{files['n']}-{files['h'] & (1 << 64) - 1:016x}"
        if versions.latest(self.spark, root) is None:
            build(root)
        return root

    def kept_index(self, name: str, chunks: DataFrame) -> keyword.KeywordIndex:
        """The keyword index ``name`` of ``chunks``, which are made of documents."""
        return keyword.open_index(self.spark, self.kept(f"{name}-index", self.documents, lambda root: keyword.build_index(self.spark, root, chunks)))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views named in ``text``."""
        used = [t for t in [*TABLES, *VIEWS] if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def with_views(sql: str, views: dict[str, str]) -> str:
    """``sql`` with the views that it names as its WITH list."""
    used = [v for v in views if re.search(rf"\b{v}\b", sql)]
    heads = [f"{v} AS ({views[v]})" for v in used]
    body = sql.strip()
    if heads and body.upper().startswith("WITH "):
        body = "WITH " + ", ".join(heads) + ", " + body[5:]
    elif heads:
        body = "WITH " + ", ".join(heads) + " " + body
    return body


def query(name: str, sql: str | None = None):
    """Registers ``f(views)`` as query ``name``; fixture views that ``sql`` names become its WITH list."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        GIVEN[name] = f, sql
        if sql:
            ORACLES[name] = with_views(sql, VIEWS)
        return f

    return add
