"""Order statistics that stay distributed when one key holds most of the rows.

A plain window over a hot key sorts that key in one task. The operators here split each
key into ordered buckets, aggregate the buckets (small), and combine the prefix with a
window inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.session import materialise

SALTS = 16
ROW_BITS = 33
SKETCH_ACCURACY = 10_000
BRACKET_MARGIN = 0.002
WHOLE_RANGE_BELOW = 5_000
BROADCAST_ROWS = 50_000
#: Buckets of a range in running sums.
SPAN = 1024
#: Brackets that hold more rows than this are narrowed again, by a grid of so many quantiles of theirs.
BRACKET_ROWS, GRID = 200_000, 256


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column,
          rank: str = "rank") -> DataFrame:
    """The first k rows per key; the limit is applied before the shuffle as well."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
            sums: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums and maxima per key up to each row, itself included unless told otherwise.

    ``bucket``, a whole number, must not fall along the order (a day, an id range): rows of one
    bucket meet in one task, whole keys never do. Buckets are added up in ranges of ``SPAN`` of
    them, and only the ranges of a key meet, so a key may have many millions of buckets.
    """
    sums, maxima = sums or {}, maxima or {}
    inputs = {f"_in_{name}": column for name, column in {**sums, **maxima}.items()}
    rows = df.withColumns({**inputs, "_bucket": bucket})
    at = [*keys, "_bucket"]
    totals = rows.groupBy(*at).agg(
        *[F.sum(f"_in_{name}").alias(f"_all_{name}") for name in sums],
        *[F.max(f"_in_{name}").alias(f"_all_{name}") for name in maxima])
    ranged = totals.withColumn("_range", F.floor(F.col("_bucket") / F.lit(SPAN)))
    by_range = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(f"_all_{name}").alias(f"_all_{name}") for name in sums],
        *[F.max(f"_all_{name}").alias(f"_all_{name}") for name in maxima])

    def earlier(window: W, prefix: str) -> list[Column]:
        before = window.rowsBetween(W.unboundedPreceding, -1)
        return [*[F.sum(f"_all_{n}").over(before).alias(f"{prefix}{n}") for n in sums],
                *[F.max(f"_all_{n}").over(before).alias(f"{prefix}{n}") for n in maxima]]

    ranges = by_range.select(*keys, "_range", *earlier(W.partitionBy(*keys).orderBy("_range"), "_far_"))
    near = ranged.select(*at, "_range", *earlier(
        W.partitionBy(*keys, "_range").orderBy("_bucket"), "_near_"))
    before = near.join(ranges, [*keys, "_range"]).select(
        *at,
        *[F.coalesce(F.col(f"_far_{n}") + F.col(f"_near_{n}"), F.col(f"_far_{n}"), F.col(f"_near_{n}"))
          .alias(f"_pre_{n}") for n in sums],
        *[F.greatest(f"_far_{n}", f"_near_{n}").alias(f"_pre_{n}") for n in maxima])
    inside = W.partitionBy(*at).orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow if inclusive else -1)
    local = rows.select(
        *df.columns, "_bucket",
        *[F.sum(f"_in_{name}").over(inside).alias(f"_own_{name}") for name in sums],
        *[F.max(f"_in_{name}").over(inside).alias(f"_own_{name}") for name in maxima])
    results = [F.coalesce(F.col(f"_pre_{n}") + F.col(f"_own_{n}"), F.col(f"_pre_{n}"),
                          F.col(f"_own_{n}")).alias(n) for n in sums]
    results += [F.greatest(f"_pre_{n}", f"_own_{n}").alias(n) for n in maxima]
    return local.join(before, at).select(*df.columns, *results)


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                name: str = "index") -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, bucket, sums={name: F.lit(1)})


def number_rows(scan: DataFrame, sequence: str = "feed_seq", name: str = "row_number") -> DataFrame:
    """Contiguous 1-based numbers for a scan stamped with monotonically_increasing_id.

    Only the row count of each scan task is aggregated; the rows do not move.
    """
    task = F.shiftright(sequence, ROW_BITS)
    counts = scan.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    offsets = counts.select("_task", F.coalesce(F.sum("_rows").over(
        W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.col(sequence).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (scan.withColumn("_task", task).join(offsets, "_task")
            .withColumn(name, local + F.col("_offset") + 1).drop("_task", "_offset"))


def nearest_rank(n: Column, p: float) -> Column:
    """0-based index of percentile p among n sorted values, half to even."""
    index = F.bround(F.lit(p) * (n - 1), 0).cast("long")
    return F.greatest(F.lit(0), F.least(n - 1, index))


def upper_median_rank(n: Column, p: float) -> Column:
    """0-based index n // 2."""
    return F.floor(n / 2).cast("long")


def bounded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised small table, marked for broadcast once its row count is known to fit;
    beyond the limit the join is left to a shuffle."""
    kept = materialise(small)
    return F.broadcast(kept) if kept.count() <= limit else kept


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column,
                    quantiles: dict[str, float], rule=nearest_rank) -> DataFrame:
    """count, null_count, min, max, mean and exact quantiles per key.

    A mergeable sketch brackets each quantile; brackets of a large key are narrowed by sketches of
    what lies inside them, until they hold few rows or one value. Only values inside the bracket
    are grouped and ordered, everything below is one count. The bracket table (one row per key) is
    materialised, so the data are read twice and once more for each narrowing. A bracket that misses
    its rank stops the job rather than giving a wrong number.
    """
    names, probs = list(quantiles), list(quantiles.values())
    rows = df.select(*keys, value.cast("double").alias("_v"))
    ends = [max(0.0, p - BRACKET_MARGIN) for p in probs] + [
        min(1.0, p + BRACKET_MARGIN) for p in probs]
    stats = bounded(rows.groupBy(*keys).agg(
        F.count("_v").alias("count"), F.count_if(F.col("_v").isNull()).alias("null_count"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"),
        F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_ends")))
    whole = F.col("count") <= WHOLE_RANGE_BELOW
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("q"), rule(F.col("count"), p).alias("rank"),
            F.when(whole | F.lit(ends[i] <= 0), F.col("min"))
             .otherwise(F.get("_ends", F.lit(i))).alias("lo"),
            F.when(whole | F.lit(ends[len(probs) + i] >= 1), F.col("max"))
             .otherwise(F.get("_ends", F.lit(len(probs) + i))).alias("hi"))
        for i, p in enumerate(probs)])
    bounds = stats.select(*keys, brackets.alias("_b"))
    present = rows.where(F.col("_v").isNotNull())
    most = stats.agg(F.max("count")).first()[0] or 0
    if most * 2 * BRACKET_MARGIN > BRACKET_ROWS:
        bounds = narrowed(present, bounds, keys)
    met = present.join(bounds, list(keys)) if keys else present.crossJoin(bounds)
    hits = (met.select(*keys, "_v", F.explode("_b").alias("b")).where(F.col("_v") <= F.col("b.hi"))
            .groupBy(*keys, "b.q", "b.rank",
                     F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("v"))
            .agg(F.count("*").alias("c")))
    order = W.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first())
    reached = hits.withColumn("_upto", F.sum("c").over(order)).where(F.col("_upto") > F.col("rank"))
    found = reached.groupBy(*keys).agg(*[
        F.min_by(F.coalesce("v", F.raise_error(F.lit("quantile bracket missed")).cast("double")),
                 F.when(F.col("q") == i, F.col("_upto"))).alias(name)
        for i, name in enumerate(names)])
    summary = stats.drop("_ends")
    joined = summary.join(found, list(keys), "left") if keys else summary.crossJoin(found)
    checked = [F.when((F.col("count") > 0) & F.col(name).isNull(),
                      F.raise_error(F.lit("quantile bracket missed")).cast("double"))
               .otherwise(F.col(name)).alias(name) for name in names]
    return joined.select(*keys, "count", "null_count", "min", *checked, "max", "mean")


def narrowed(present: DataFrame, bounds: DataFrame, keys: Sequence[str],
             rows: int | None = None) -> DataFrame:
    """Brackets (``_b``: q, rank, lo, hi) of at most ``rows`` rows each, or of one value.

    A round counts what lies below and inside each bracket and takes a grid of quantiles inside it; the
    grid points around the rank are the next bracket, with one more on either side.
    """
    limit = rows or BRACKET_ROWS
    kind = bounds.schema["_b"].dataType.elementType.simpleString()
    while True:
        met = present.join(bounds, list(keys)) if keys else present.crossJoin(bounds)
        within = F.when(F.col("_v").between(F.col("b.lo"), F.col("b.hi")), F.col("_v"))
        grids = materialise(
            met.select(*keys, "_v", F.explode("_b").alias("b"))
            .groupBy(*keys, "b").agg(
                F.count_if(F.col("_v") < F.col("b.lo")).alias("_below"), F.count(within).alias("_inside"),
                F.percentile_approx(within, [i / GRID for i in range(GRID + 1)], SKETCH_ACCURACY).alias("_grid")))
        wide = (F.col("_inside") > limit) & (F.col("b.lo") < F.col("b.hi"))
        if grids.where(wide).isEmpty():
            return bounds
        at = F.floor((F.col("b.rank") - F.col("_below")) / F.col("_inside") * GRID).cast("int")
        low = F.greatest(F.get("_grid", F.greatest(at - 1, F.lit(0))), F.col("b.lo"))
        high = F.least(F.get("_grid", F.least(at + 2, F.lit(GRID))), F.col("b.hi"))
        # The ends of the grid are approximate too; the bracket's own ends are safe.
        next_ = F.struct(F.col("b.q").alias("q"), F.col("b.rank").alias("rank"),
                         F.when(wide & (at > 1), low).otherwise(F.col("b.lo")).alias("lo"),
                         F.when(wide & (at + 2 < GRID), high).otherwise(F.col("b.hi")).alias("hi"))
        moved = grids.select(*keys, next_.cast(kind).alias("n"), "b")
        if moved.where((F.col("n.lo") > F.col("b.lo")) | (F.col("n.hi") < F.col("b.hi"))).isEmpty():
            return bounds
        bounds = materialise(moved.groupBy(*keys).agg(F.collect_list("n").alias("_b")) if keys
                             else moved.agg(F.collect_list("n").alias("_b")))


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Column,
                salts: int = SALTS) -> DataFrame:
    """Inner join whose hot keys are split over ``salts`` tasks.

    The small side is repeated once per salt; when it fits a broadcast, the adaptive plan
    uses one and the big side is not shuffled at all.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
