"""Retention over several batches and starts."""

from pyspark.sql import functions as F

from tidewell.streaming import streams as S


def test_retention_holds_over_batches_and_starts(spark, tmp_path):
    def days(i, *ds):
        path = str(tmp_path / f"in/n={i}")
        spark.createDataFrame([(i * 100 + d, f"2024-01-{d:02d} 12:00:00") for d in ds], "id long, t string").select("id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(path)

    def run():
        src = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        S.retain_stream(src, 7, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.id for r in spark.read.option("basePath", str(tmp_path / "rows")).parquet(str(tmp_path / "rows")).select("id").collect())

    days(1, 1, 2, 3)
    assert run() == [101, 102, 103]
    days(2, 9, 10)
    assert run() == [209, 210]  # the first batch's days are over
    days(3, 1, 3, 4, 10)
    assert run() == [209, 210, 304, 310]  # late old rows set no limit of their own
