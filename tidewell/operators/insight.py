"""Sales and feedback statistics. Money is summed as decimals, so sums don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_period(df: DataFrame, start: str, end: str, col: str = "date") -> DataFrame:
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def some_rows(df: DataFrame) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError("no records within period")
    return df


def infer_period(df: DataFrame, col: str = "date") -> DataFrame:
    day = F.try_to_date(F.substring(F.col(col).cast("string"), 1, 10))
    return df.agg(F.min(day).alias("from"), F.max(day).alias("to"))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows for which all rules hold, others with reason: the first rule that doesn't)."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def daily_sales(records: DataFrame) -> DataFrame:
    return records.groupBy("date").agg(F.sum("amount").alias("amount"))


def sales_summary(records: DataFrame) -> DataFrame:
    """One row: total, days observed, mean a day, count (null when 0), best and worst day (earliest of equals)."""
    by_day = records.groupBy("date").agg(F.sum("amount").alias("amount"), F.sum("cnt").alias("cnt"))
    early, late = F.struct("amount", (-F.unix_date("date")).alias("d")), F.struct("amount", F.unix_date("date").alias("d"))
    return by_day.agg(
        F.sum("amount").cast("double").alias("total"),
        F.count("*").alias("days"),
        (F.sum("amount").cast("double") / F.count("*")).alias("mean_daily"),
        F.nullif(F.sum("cnt"), F.lit(0)).alias("count_total"),
        F.max_by("date", early).alias("best_day"),
        F.min_by("date", late).alias("worst_day"),
    )


def weekday_mean(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.weekday("date").alias("weekday")).agg((F.sum("amount").cast("double") / F.count("*")).alias("mean_amount"))


def dimension_stats(records: DataFrame) -> DataFrame:
    """dim, value, amount, share, rank for every key of the map column ``dimension``."""
    total = records.agg(F.sum("amount").alias("_total"))
    by = records.select("amount", F.explode("dimension").alias("dim", "value")).groupBy("dim", "value").agg(F.sum("amount").alias("amount"))
    share = F.when(F.col("_total") != 0, F.col("amount").cast("double") / F.col("_total").cast("double")).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("amount"), "value"))
    return by.crossJoin(F.broadcast(total)).select("dim", "value", "amount", share.alias("share"), rank.alias("rank"))


def anomalies(daily: DataFrame, value: str = "amount", z: float = 2.5, least_days: int = 7) -> DataFrame:
    """Days whose value is ``z`` population deviations from the mean or more: date, value, z_score, direction."""
    v = F.col(value).cast("double")
    stats = daily.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"), F.count("*").alias("_n"))
    score = (v - F.col("_m")) / F.col("_s")
    out = daily.crossJoin(F.broadcast(stats)).filter((F.col("_n") >= least_days) & (F.col("_s") > 0)).withColumn("z_score", score)
    return out.filter(F.abs("z_score") >= z).select("date", value, "z_score", F.when(F.col("z_score") > 0, "spike").otherwise("drop").alias("direction"))


def compare_periods(records: DataFrame, cur: tuple[str, str], prev: tuple[str, str]) -> DataFrame:
    """current, prior, growth (null when the prior total isn't positive)."""
    total = lambda p: F.sum(F.when(F.col("date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date")), F.col("amount"))).cast("double")
    both = records.agg(total(cur).alias("current"), total(prev).alias("prior"))
    return both.withColumn("growth", F.when(F.col("prior") > 0, (F.col("current") - F.col("prior")) / F.col("prior")))


def dimension_growth(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """dim, value, growth of values on both sides of two `dimension_stats` whose prior amount is positive."""
    old = prev.select("dim", "value", F.col("amount").alias("prior")).filter("prior > 0")
    return cur.join(old, ["dim", "value"]).select("dim", "value", ((F.col("amount").cast("double") - F.col("prior").cast("double")) / F.col("prior").cast("double")).alias("growth"))


def rating_stats(records: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("rating") == n).alias(f"n{n}") for n in range(1, 6)]
    low = F.count_if(F.col("rating") <= 2)
    return records.agg(F.avg(F.col("rating").cast("double")).alias("mean_rating"), F.count("rating").alias("rated"), *levels, low.alias("negative"), (low.cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("negative_ratio"))


def count_share(records: DataFrame, col: str) -> DataFrame:
    """value, n, share of all rows; blanks don't count as values."""
    total = records.agg(F.count("*").alias("_total"))
    by = records.filter(F.trim(F.coalesce(F.col(col), F.lit(""))) != "").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n").cast("double") / F.col("_total")).alias("share"))


def daily_surge(records: DataFrame, z: float = 2.5) -> DataFrame:
    return anomalies(records.groupBy("date").agg(F.count("*").alias("n")), "n", z)


def domain_coverage(records: DataFrame, domains: dict[str, list[str]], order: list[str], n: int = 50) -> DataFrame:
    """Per domain the share of the first ``n`` rows (by ``order``) that have all its fields (coverage), whether that is 0.8 at least
    (fits), and whether it is the only domain that fits (chosen)."""
    first = records.orderBy(*order).limit(n)
    has = lambda fields: F.avg(F.when(F.expr(" AND ".join(f"`{f}` IS NOT NULL" for f in fields)), 1.0).otherwise(0.0)) if all(f in records.columns for f in fields) else F.lit(0.0)
    one = first.agg(*[has(fields).alias(d) for d, fields in domains.items()])
    long_ = one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("coverage")) for d in domains])).alias("x")).select("x.*")
    winners = F.count_if("fits").over(Window.partitionBy())
    return long_.withColumn("fits", F.col("coverage") >= 0.8).withColumn("chosen", F.col("fits") & (winners == 1))


def feedback_sample(records: DataFrame, n: int = 60, cut: int = 200) -> DataFrame:
    """Negative ones first, then the newest; at most ``n``; texts cut."""
    negative = F.coalesce(F.col("rating") <= 2, F.lit(False))
    return records.withColumn("negative", negative).orderBy(F.desc("negative"), F.desc("date"), "text", "rating").limit(n).withColumn("text", F.substring("text", 1, cut))


def request_summary(records: DataFrame) -> DataFrame:
    """rows, days, dimension keys, as a log line has them."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("dimension")))))
    return records.agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("days"), keys.alias("dim_keys"))
