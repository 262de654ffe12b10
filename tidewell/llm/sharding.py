"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows go from partition p to shard s is drawn from the law that a uniform permutation of all rows gives to
these counts. After that every partition only has to permute its own rows and send the drawn numbers, and every
shard to permute what it gets: nobody sees all rows. Only the matrix (partitions x shards numbers) is made on the
driver; everything on rows is DataFrame code.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

HALF, HALF_LOG_2PI = Decimal("0.5"), Decimal("0.91893853320467274178032973640561763986139747363778")
#: Copies of a row that stay together when rows are numbered.
COPIES = 1024


def log_factorial(n: int) -> Decimal:
    """To 40 digits and more: by the factorial itself, or by Stirling's series, whose next term is under 1e-23 from 1000 on."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    return (x + HALF) * x.ln() - x + HALF_LOG_2PI + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def law(good: int, bad: int, draws: int) -> Iterator[tuple[int, float]]:
    """(number of good ones, probability) of ``draws`` taken without replacement out of ``good + bad``, outwards from the mode.

    The first probability is taken from long decimals, as a difference of numbers of up to 1e15 leaves none of a float's
    digits; the others follow by ratios, so their sum is 1 but for rounding."""
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (good + 1) * (draws + 1) // (good + bad + 2)))
    with localcontext(Context(prec=50)):
        choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        p = float((choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws)).exp())
    yield mode, p
    up, down, p_up, p_down = mode, mode, p, p
    while (up < high and p_up) or (down > low and p_down):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            yield up, p_up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            yield down, p_down


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement out of ``good + bad`` are good: inversion, walking outwards from the
    mode, so the steps grow with the deviation and not with the counts."""
    u, first = rng.random(), None
    for value, p in law(good, bad, draws):
        first = value if first is None else first
        if (u := u - p) <= 0:
            return value
    return first  # what rounding left over, under 1e-9


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``sizes`` (rows of each partition), columns to ``shards`` (rows of each shard)."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in sizes:
        row, rest, total = [], size, sum(left)
        for s, room in enumerate(left):
            total -= room
            got = hypergeometric(rng, room, total, rest)
            row.append(got)
            left[s] -= got
            rest -= got
        out.append(row)
    return out


def shuffle_into_shards(
    df: DataFrame,
    *,
    key_cols: list[str],
    n_shards: int = 16,
    seed: int = 20240229,
    rows_per_partition: int = 100_000,
    least_partitions: int = 64,
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard): a uniform random
    order cut into shards whose row counts are at most one apart.

    ``key_cols`` name columns that tell rows apart. Rows alike in all columns are counted and numbered first, and the
    order is a function of the key columns, that number and the seed, so that many copies are spread like other rows and
    a task that runs again deals the same way. (Tables with maps or variants can't be counted; there copies stay together.)
    Nulls are a value like others; an empty table gives an empty result; columns of ``df`` named shard or slot are
    replaced, all others stay as they are. ``df`` goes by shuffle; select narrow columns.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    if any(x in df.schema.simpleString() for x in ("map<", "variant")):
        rows = rows.withColumn("no", F.lit(0).cast("long"))
    else:
        counted = rows.groupBy("row").agg(F.count("*").alias("copies"))
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
        spread = counted.withColumn("first", piece).withColumn("first", F.col("first") * COPIES).repartition(F.xxhash64("row", "first"))
        rows = spread.select("row", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("copies")) - 1)).alias("no"))
    rows = cut(rows, "sharding-rows")
    n = rows.count()
    parts = max(least_partitions, -(-n // rows_per_partition))
    keys = [*[F.col(f"row.`{c}`") for c in key_cols], F.col("no")]
    whole = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    keyed = rows.withColumn("part", F.pmod(whole(1), F.lit(parts)))
    sizes = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a partition
    extra = random.Random(seed).sample(range(n_shards), n % n_shards)
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], [n // n_shards + (s in extra) for s in range(n_shards)], seed)
    ends = [(p, [sum(row[: s + 1]) for s in range(n_shards)]) for p, row in enumerate(matrix)]
    sent = spark.createDataFrame(ends, "part bigint, ends array<bigint>")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(whole(2), *keys))
    dealt = keyed.withColumn("rank", rank).join(sent, "part")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int")
    # The second permutation orders each shard by a fresh random number. Its leading part cuts the shard into
    # pieces, so a shard is never sorted by one task; a piece's first slot is the sum of the pieces before it.
    pieces = max(8, parts // n_shards + 1)
    dealt = cut(dealt.select("row", "no", shard.alias("shard"), F.pmod(whole(3), F.lit(pieces)).alias("piece")), "sharding")
    counts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(whole(4), *keys)) - 1
    placed = dealt.withColumn("own", own).join(counts, ["shard", "piece"])
    given = [F.col(f"row.`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*given, "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))
