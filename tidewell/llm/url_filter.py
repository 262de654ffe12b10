"""URL filtering as a sort-merge range join.

A host is reversed label by label (labels parted by ``/``, which no host has) and followed by ``?`` and the path (which
neither has), so every rule ``host + path`` becomes the interval of keys that begin with the rule's own key. A rule also holds for subdomains, so a URL is asked once for
each of its host's suffixes that has no more labels than the longest rule host. Keys are range-partitioned and
sorted; each partition sweeps once over its keys and the sorted rules and keeps the stack of rules whose interval
is open. Rows alike are counted first, and the key carries the page id, so one hot host or URL is spread over many
partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, repeated

LABEL, SEP = "/", "?"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, at, 1)), F.regexp_extract(whole, at, 2)


def rule_key(host: str, path: str) -> str:
    return LABEL.join(reversed(host.split("."))) + SEP + path


def _sweep(parts: Iterator[pa.RecordBatch], rules: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted keys. ``rules``: sorted (key, number); a key's open rules form a stack, innermost on top."""
    stack: list[tuple[str, int]] = []
    at, last, found = 0, None, None
    for part in parts:
        out = []
        for key in part.column("_key").to_pylist():
            if key != last:
                last = key
                while at < len(rules) and rules[at][0] <= key:
                    while stack and not rules[at][0].startswith(stack[-1][0]):
                        stack.pop()
                    stack.append(rules[at])
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                found = stack[-1][1] if stack else -1
            out.append(found)
        kept = ["_id", "_url", "_copies"]
        yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(out, pa.int64())], names=[*kept, "_rule"])


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = 200_000,
) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (``host + path`` or null), verdict.

    ``rules``: (verdict, host, path prefix). The longest fitting rule (characters of host and path; then of the
    host) wins; of equal rules the first; a rule whose host has a character that no host can have, or A-Z, fits nothing. Rules go to the tasks in sorted blocks of ``max_rules``; further blocks
    are further sweeps over the same keys, so no broadcast is larger than a block and none is dropped.
    Null or odd URLs get empty host and path and the default verdict; repeated rows stay repeated; other columns
    of ``pages``, whatever their names, are not touched. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    numbered: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if not set(host) & set("/?#"):
            numbered.setdefault((host, path), verdict)
    known = sorted(numbered, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r))  # a greater number wins
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count("*").alias("_copies"))
    host, path = host_path(F.col("_url"))
    depth = max((h.count(".") + 1 for h, _ in known), default=1)
    labelled = rows.select("_id", "_url", "_copies", F.reverse(F.split(host, r"\.")).alias("_labels"), path.alias("_path"))
    suffixes = F.sequence(F.lit(1), F.least(F.lit(depth), F.size("_labels")))
    keys = F.transform(suffixes, lambda n: F.concat(F.array_join(F.slice("_labels", F.lit(1), n), LABEL), F.lit(SEP), F.col("_path")))
    asked = labelled.select("_id", "_url", "_copies", F.explode(keys).alias("_key"))
    asked = asked.repartitionByRange("_key", "_id").sortWithinPartitions("_key")
    best = None
    schema = "_id {0}, _url string, _copies bigint, _rule bigint".format(rows.schema["_id"].dataType.simpleString())
    ordered = iter(sorted((rule_key(h, p), n) for n, (h, p) in enumerate(known)))
    while block := list(islice(ordered, max_rules)):
        held = spark.sparkContext.broadcast(block)
        swept = asked.mapInArrow(lambda parts, held=held: _sweep(parts, held.value), schema)
        best = swept if best is None else best.unionByName(swept)
    if best is None:
        best = asked.select("_id", "_url", "_copies", F.lit(-1).cast("long").alias("_rule"))
    best = best.groupBy("_id", "_url").agg(F.max("_rule").alias("_rule"), F.max("_copies").alias("_copies"))
    names = spark.createDataFrame([(n, h + p, numbered[h, p]) for n, (h, p) in enumerate(known)], "_rule bigint, rule string, verdict string")
    best = best.join(F.broadcast(names) if len(known) <= max_rules else names, "_rule", "left")
    best = repeated(best, "_copies", "_no")
    host, path = host_path(F.col("_url"))
    return best.select(F.col("_id").alias("page_id"), host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

