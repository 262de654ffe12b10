"""From raw documents to packed training sequences: STAGES in order, each over all that the one before kept.

A stage is (name, function); a function takes (spark, docs, sf_dir). ``run`` writes each stage's result as Parquet in
the shared folder and gives it to the next as ``docs``. All stages but the last return the columns of ``documents``.
Rows are told apart by doc_id and a hash of the text; rows alike in both are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import decontam, knn_quality, near_dedup, packing
from tidewell.llm.queries import KEEP_SCORE, TOKENIZERS, held_out
from tidewell.llm.shared import cut, fresh, table


def _marked(docs: DataFrame, mark: str) -> DataFrame:
    """``docs`` with doc_id and the text's hash in column ``mark``. As one struct they are one key of window and join, and
    null ids are like others."""
    return docs.withColumn(mark, F.struct("doc_id", F.xxhash64("text").alias("text_hash")))


def _told(keys: DataFrame) -> DataFrame:
    """The distinct (doc_id, text_hash) of ``keys`` as column ``told``."""
    return keys.select(F.struct("doc_id", F.coalesce("text_hash", F.lit(0)).alias("text_hash")).alias("told")).distinct()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours don't reject."""
    model = knn_quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    (score,) = fresh(docs, "_score")
    return docs.withColumn(score, knn_quality.quality_score(docs, model)).filter(F.col(score) >= KEEP_SCORE).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of rows alike in id and text the first by a hash of all columns
    (those that can be hashed). That first is taken before the join, in each task and then over all, so copies of one row
    are one row a task by the time that they are shuffled."""
    told = _told(near_dedup.near_duplicates(docs).filter("kept"))
    mark, number = fresh(docs, "_mark", "_number")
    # the join goes by the window's key, so texts are shuffled once; a semi-join would be moved below the window
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    first = Window.partitionBy(mark).orderBy(F.xxhash64(*plain))
    rows = _marked(docs, mark).withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1)
    return rows.join(told, rows[mark] == told["told"]).drop(mark, number, told["told"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    told = _told(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))
    (mark,) = fresh(docs, "_mark")
    rows = _marked(docs, mark)
    return rows.join(told, rows[mark] == told["told"], "left_anti").drop(mark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences."""
    return packing.pack_documents(docs, tokenizer=f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: No stage but decontamination can be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
