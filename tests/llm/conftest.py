import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with names that operators use."""
    rows = [(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, " \t\n"), (5, "!!! ???"), (6, "word"), (None, "a null id has a text too"), (None, None)]
    rows += [(7, "copy of one text that is repeated here"), (7, "copy of one text that is repeated here"), (8, "copy of one text that is repeated here")]
    rows += [(9, " ".join(f"w{i}" for i in range(60_000))), (10, "x" * 300_000), (11, "naïve İstanbul ÀÉ 漢字 \U0001f600 <|endoftext|> don't"), (12, "Copy of ONE text, that is repeated: here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("rid", "label", "rank", "score", "shard_", "_part", "_w", "n", "bucket", "item")])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
