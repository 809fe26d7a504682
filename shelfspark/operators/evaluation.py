"""Ranking metrics, reports, sweeps and the regression gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import bounded, dense_index, top_k
from shelfspark.operators.search import fuse

ALPHAS = [i / 10 for i in range(11)]
METRIC_COLUMNS = ["ndcg_10", "recall_10", "recall_50", "precision_10", "mrr", "hit_10"]
TRACKED = ("ndcg_10", "recall_10", "mrr")
TOLERANCE = 0.03
RANKS_PER_BUCKET = 4096


def dedupe_ranking(rankings: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """First occurrence of each sku per list, ranks closed up.

    Lists are numbered in rank buckets, so a list of any length is spread over tasks.
    """
    first = rankings.groupBy(*keys, "sku").agg(F.min("rank").alias("_first"))
    return dense_index(first, keys, [F.col("_first"), F.col("sku")],
                       F.floor(F.col("_first") / RANKS_PER_BUCKET), "rank").drop("_first")


def gain(rel: Column, exponential: bool = True) -> Column:
    return F.pow(F.lit(2.0), rel) - 1 if exponential else rel.cast("double")


def discounted(rel: Column, rank: Column, exponential: bool = True) -> Column:
    return gain(rel, exponential) / F.log2(rank + F.lit(1))


def ideal_dcg(judgments: DataFrame, k: int = 10, exponential: bool = True) -> DataFrame:
    """Best possible DCG and the number of relevant skus per query; none relevant, no row."""
    relevant = judgments.where(F.col("rel") > 0)
    best = top_k(relevant, ["qid"], [F.desc("rel")], k, rank="_r")
    idcg = best.groupBy("qid").agg(
        F.sum(discounted(F.col("rel"), F.col("_r"), exponential)).alias("idcg"))
    return relevant.groupBy("qid").agg(F.count("*").alias("n_rel")).join(idcg, "qid")


def join_judgments(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """Ranking rows with their judgment; unjudged counts as irrelevant."""
    return rankings.join(judgments.select("qid", "sku", "rel"), ["qid", "sku"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(0)))


def score_queries(queries: DataFrame, rankings: DataFrame, judgments: DataFrame,
                  by: Sequence[str] = (), exponential: bool = True) -> DataFrame:
    """All metrics per query (and per value of ``by``); null where nothing is relevant."""
    keys = [*by, "qid"]
    judged = join_judgments(dedupe_ranking(rankings, keys), judgments)
    hit, rank = F.col("rel") > 0, F.col("rank")
    dcg = F.sum(F.when(hit & (rank <= 10), discounted(F.col("rel"), rank, exponential)))
    found = judged.groupBy(*keys).agg(
        dcg.alias("dcg"), F.count_if(hit & (rank <= 10)).alias("hits_10"),
        F.count_if(hit & (rank <= 50)).alias("hits_50"),
        F.min(F.when(hit, rank)).alias("first"))
    base = queries
    if by:
        base = queries.crossJoin(bounded(rankings.select(*by).distinct()))
    ideal = ideal_dcg(judgments, 10, exponential)
    all_scores = base.join(ideal, "qid", "left").join(found, keys, "left")

    def defined(value: Column) -> Column:
        return F.when(F.col("n_rel") > 0, F.coalesce(value, F.lit(0.0)))

    return all_scores.select(
        *[c for c in base.columns],
        defined(F.col("dcg") / F.col("idcg")).alias("ndcg_10"),
        defined(F.col("hits_10") / F.col("n_rel")).alias("recall_10"),
        defined(F.col("hits_50") / F.col("n_rel")).alias("recall_50"),
        defined(F.col("hits_10") / F.lit(10)).alias("precision_10"),
        defined(1 / F.col("first")).alias("mrr"),
        defined(F.when(F.col("hits_10") > 0, 1.0)).alias("hit_10"))


def macro_columns(metrics: Sequence[str] = METRIC_COLUMNS) -> list[Column]:
    """Mean of the defined values, rounded, and how many there were."""
    out = [F.count("*").alias("n_queries")]
    for name in metrics:
        out += [F.round(F.avg(name), 4).alias(name), F.count(name).alias(f"{name}_n")]
    return out


def report(scores: DataFrame) -> DataFrame:
    """Per tenant and class, and overall, from one pass of grouping sets."""
    grouped = scores.groupingSets(
        [[F.col("tenant"), F.col("query_class")], []], F.col("tenant"), F.col("query_class")
    ).agg(*macro_columns(), F.grouping("tenant").alias("_all"))
    bucket = F.when(F.col("_all") == 1, "OVERALL").otherwise(
        F.concat_ws("::", "tenant", "query_class"))
    return grouped.select(bucket.alias("bucket"), "n_queries", *[
        c for name in METRIC_COLUMNS for c in (name, f"{name}_n")])


def class_report(scores: DataFrame) -> DataFrame:
    """Per class and overall."""
    grouped = scores.groupingSets([[F.col("query_class")], []], F.col("query_class")).agg(
        *macro_columns(), F.grouping("query_class").alias("_all"))
    bucket = F.when(F.col("_all") == 1, "overall").otherwise(F.col("query_class"))
    return grouped.select(bucket.alias("bucket"), "n_queries", *[
        c for name in METRIC_COLUMNS for c in (name, f"{name}_n")])


def lift(with_change: DataFrame, without: DataFrame, metric: str = "ndcg_10",
         bucket: str = "OVERALL") -> DataFrame:
    """Difference of one metric between two reports."""
    a = with_change.where(F.col("bucket") == bucket).select("bucket", F.col(metric).alias("after"))
    b = without.where(F.col("bucket") == bucket).select("bucket", F.col(metric).alias("before"))
    return a.join(b, "bucket").withColumn("lift", F.col("after") - F.col("before"))


def paired_lift(queries: DataFrame, with_change: DataFrame, without: DataFrame, judgments: DataFrame,
                metrics: Sequence[str] = TRACKED) -> DataFrame:
    """Per metric the means after and before a change, their difference, and how many queries got
    better and worse: both passes are scored together, query by query."""
    passes = with_change.select("qid", "sku", "rank").withColumn("changed", F.lit(True)).unionByName(
        without.select("qid", "sku", "rank").withColumn("changed", F.lit(False)))
    scores = score_queries(queries.select("qid"), passes, judgments, by=["changed"])
    paired = scores.groupBy("qid").agg(*[
        F.max(F.when(F.col("changed") == F.lit(side), F.col(m))).alias(f"{m}_{name}")
        for m in metrics for side, name in ((True, "after"), (False, "before"))])
    rows = paired.select("qid", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_after").alias("after"), F.col(f"{m}_before").alias("before"))
        for m in metrics])).alias("m")).select("m.*")
    gained = F.round(F.col("after") - F.col("before"), 9)
    return rows.groupBy("metric").agg(
        F.avg("after").alias("after"), F.avg("before").alias("before"), F.avg(gained).alias("lift"),
        F.count_if(gained > 0).alias("better"), F.count_if(gained < 0).alias("worse"))


def alpha_sweep(lists: DataFrame, queries: DataFrame, judgments: DataFrame,
                alphas: Sequence[float] = ALPHAS, depth: int = 10,
                classes: Sequence[str] = ()) -> DataFrame:
    """(query_class, alpha, ndcg) for every blend weight from one pair of scored lists.

    The lists hold at most two pools per query, so the grid multiplies a bounded table. Each of
    ``classes`` has its rows, of 0 where no query is of that class.
    """
    grid = lists.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    ranked = top_k(fuse(grid, F.col("alpha")), ["alpha", "qid"],
                   [F.desc("score"), F.asc("sku")], depth)
    judged = join_judgments(ranked, judgments).groupBy("alpha", "qid").agg(F.sum(
        F.when(F.col("rel") > 0, discounted(F.col("rel"), F.col("rank")))).alias("dcg"))
    wanted = queries.select("qid", "query_class").join(ideal_dcg(judgments), "qid", "left").select(
        "qid", "query_class", "idcg",
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    scored = wanted.join(judged, ["alpha", "qid"], "left").withColumn(
        "ndcg", F.when(F.col("idcg").isNotNull(), F.coalesce(F.col("dcg"), F.lit(0.0))
                       / F.col("idcg"))).select("query_class", "alpha", "ndcg")
    if classes:
        pairs = F.array(*[F.struct(F.lit(c).alias("query_class"), F.lit(float(a)).alias("alpha"))
                          for c in classes for a in alphas])
        scored = scored.unionByName(lists.sparkSession.range(1).select(F.inline(pairs)).withColumn(
            "ndcg", F.lit(None).cast("double")))
    return scored.groupBy("query_class", "alpha").agg(
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"))


def best_alphas(sweep: DataFrame) -> DataFrame:
    """Best weight per class; the lowest wins a tie."""
    return top_k(sweep, ["query_class"], [F.desc(F.round("ndcg", 9)), F.asc("alpha")], 1).select(
        "query_class", "alpha", "ndcg")


def dynamic_advantage(sweep: DataFrame) -> DataFrame:
    """Best single weight, its macro score, the per-class score and the difference."""
    fixed = sweep.groupBy("alpha").agg(F.avg("ndcg").alias("fixed_macro"))
    single = fixed.agg(F.max(F.struct(
        F.round("fixed_macro", 9).alias("r"), (-F.col("alpha")).alias("neg"),
        "fixed_macro")).alias("b")).select(
        (-F.col("b.neg")).alias("fixed_alpha"), F.col("b.fixed_macro").alias("fixed_macro"))
    dynamic = best_alphas(sweep).agg(F.avg("ndcg").alias("dynamic_macro"))
    return single.crossJoin(F.broadcast(dynamic)).withColumn(
        "advantage", F.col("dynamic_macro") - F.col("fixed_macro"))


def tuned_alphas(sweep: DataFrame) -> DataFrame:
    """Best weight per class, and beside each the best single weight of all classes, the macro
    scores of that one and of the classes' own, and what these gain."""
    return best_alphas(sweep).crossJoin(F.broadcast(dynamic_advantage(sweep)))


def baseline_gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE,
                  metrics: Sequence[str] = TRACKED) -> DataFrame:
    """(bucket, metric, current, baseline, drop) for every value that fails the gate.

    Buckets only one side has are skipped; a value either side lacks fails.
    """
    def long(frame: DataFrame, name: str) -> DataFrame:
        doubles = [F.col(m).cast("double").alias(m) for m in metrics]
        return frame.select("bucket", *doubles).unpivot("bucket", list(metrics), "metric", name)

    both = long(current, "current").join(long(baseline, "baseline"), ["bucket", "metric"])
    drop = F.col("baseline") - F.col("current")
    return both.withColumn("drop", drop).where(F.col("drop").isNull() | (F.col("drop") > tolerance))


def intersect_keys(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return current.select("bucket").intersect(baseline.select("bucket"))
