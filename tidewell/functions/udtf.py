"""The table function `chunk(text, size, overlap)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_ix int, text string")
class Chunk:
    """Word windows of one text, for SQL; tables of texts are faster through `chunk_words`."""

    def eval(self, text: str, size: int, overlap: int):
        words = (text or "").split()
        starts = [0] if 0 < len(words) <= size else range(0, len(words), max(1, size - overlap))
        for i, s in enumerate(starts):
            yield i, " ".join(words[s : s + size])


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk", Chunk)
