"""Ranking metrics, sweeps and gates over the golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.routing import CLASSES, classify_query
from shelfspark.operators import evaluation as ev
from shelfspark.operators import search as hs
from shelfspark.plans import search_queries as sq
from shelfspark.plans import standins as st
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.session import materialise, scratch_path
from shelfspark.sources import feeds


@register("src_golden", f"""WITH {st.GOLDEN_SQL}
SELECT qid, tenant, sku, CAST(rel AS BIGINT) AS rel FROM judgments""")
def src_golden(spark, sf):
    """Judgment maps exploded back to rows."""
    maps = st.judgments(spark, sf).groupBy("qid", "tenant").agg(F.map_from_entries(
        F.collect_list(F.struct("sku", "rel"))).alias("judgments"))
    return plain(feeds.explode_judgments(maps))


# Rankings with repeats: every line of an order ranks its part; judgments by supplier.
RANKINGS_SQL = """rankings AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS qid,
    'P-' || (l_partkey % 40) AS sku, l_orderkey * 10 + l_linenumber AS rank FROM lineitem),
  judged AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS qid, 'P-' || (l_partkey % 40) AS sku,
    CAST(max(l_linenumber) % 4 AS BIGINT) AS rel FROM lineitem WHERE l_suppkey % 3 = 0
    AND l_orderkey % 500 <> 7 GROUP BY 1, 2),
  asked AS (SELECT DISTINCT CAST(l_orderkey % 500 AS VARCHAR) AS qid,
    'm' || (l_orderkey % 3) AS tenant, CASE l_orderkey % 4 WHEN 0 THEN 'exploratory'
      WHEN 1 THEN 'identifier' ELSE 'attribute' END AS query_class FROM
    (SELECT DISTINCT l_orderkey % 500 AS l_orderkey FROM lineitem)),
  closed AS (SELECT qid, sku, row_number() OVER (PARTITION BY qid ORDER BY min(rank), sku) AS rank
    FROM rankings GROUP BY 1, 2),
  hits AS (SELECT c.*, coalesce(rel, 0) AS rel FROM closed c LEFT JOIN judged USING (qid, sku)),
  ideal AS (SELECT qid, count(*) AS n_rel, sum(CASE WHEN r <= 10 THEN (pow(2, rel) - 1)
      / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid
      ORDER BY rel DESC) AS r FROM judged WHERE rel > 0) GROUP BY 1),
  found AS (SELECT qid, sum(CASE WHEN rank <= 10 AND rel > 0 THEN (pow(2, rel) - 1)
      / log2(rank + 1) END) AS dcg, count(*) FILTER (rel > 0 AND rank <= 10) AS h10,
      count(*) FILTER (rel > 0 AND rank <= 50) AS h50, min(CASE WHEN rel > 0 THEN rank END) AS first
    FROM hits GROUP BY 1),
  scores AS (SELECT a.*, CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg_10,
      CASE WHEN n_rel > 0 THEN coalesce(h10, 0) / n_rel END AS recall_10,
      CASE WHEN n_rel > 0 THEN coalesce(h50, 0) / n_rel END AS recall_50,
      CASE WHEN n_rel > 0 THEN coalesce(h10, 0) / 10 END AS precision_10,
      CASE WHEN n_rel > 0 THEN coalesce(1 / first, 0) END AS mrr,
      CASE WHEN n_rel > 0 THEN CASE WHEN h10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS hit_10
    FROM asked a LEFT JOIN ideal USING (qid) LEFT JOIN found USING (qid))"""


def _line_rankings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").withColumn("q", F.col("l_orderkey") % 500)
    qid, sku = F.col("q").cast("string"), F.concat(F.lit("P-"), (F.col("l_partkey") % 40)
                                                   .cast("string"))
    rankings = lines.select(qid.alias("qid"), sku.alias("sku"), (
        F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    judged = lines.where("l_suppkey % 3 = 0 AND q <> 7").groupBy(
        qid.alias("qid"), sku.alias("sku")).agg((F.max("l_linenumber") % 4).alias("rel"))
    asked = lines.select("q").distinct().select(
        qid.alias("qid"), F.concat(F.lit("m"), (F.col("q") % 3).cast("string")).alias("tenant"),
        F.when(F.col("q") % 4 == 0, "exploratory").when(F.col("q") % 4 == 1, "identifier")
         .otherwise("attribute").alias("query_class"))
    return asked, rankings, judged


@register("dedupe_ranking", f"""WITH {RANKINGS_SQL} SELECT qid, sku, rank FROM closed""")
def dedupe_ranking(spark, sf):
    return plain(ev.dedupe_ranking(_line_rankings(spark, sf)[1]))


@register("join_judgments", f"""WITH {RANKINGS_SQL} SELECT qid, sku, rank, rel FROM hits""")
def join_judgments(spark, sf):
    _, rankings, judged = _line_rankings(spark, sf)
    return plain(ev.join_judgments(ev.dedupe_ranking(rankings), judged))


@register("m_dcg_ndcg", f"""WITH {RANKINGS_SQL},
linear AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg_linear FROM hits
  WHERE rank <= 10 AND rel > 0 GROUP BY 1)
SELECT s.qid, round(dcg, 6) AS dcg, round(dcg_linear, 6) AS dcg_linear, round(ndcg_10, 6) AS ndcg_10
FROM scores s JOIN found USING (qid) LEFT JOIN linear USING (qid)""")
def m_dcg_ndcg(spark, sf):
    asked, rankings, judged = _line_rankings(spark, sf)
    hits = ev.join_judgments(ev.dedupe_ranking(rankings), judged)
    counted = (F.col("rank") <= 10) & (F.col("rel") > 0)
    dcg = hits.groupBy("qid").agg(
        F.sum(F.when(counted, ev.discounted(F.col("rel"), F.col("rank")))).alias("dcg"),
        F.sum(F.when(counted, ev.discounted(F.col("rel"), F.col("rank"), False)))
         .alias("dcg_linear"))
    scores = ev.score_queries(asked, rankings, judged).select("qid", "ndcg_10")
    return plain(dcg.join(scores, "qid"))


@register("m_recall_precision_rr_hit", f"""WITH {RANKINGS_SQL}
SELECT qid, round(recall_10, 6) AS recall_10, round(precision_10, 6) AS precision_10,
  round(mrr, 6) AS mrr, hit_10 FROM scores""")
def m_recall_precision_rr_hit(spark, sf):
    return plain(ev.score_queries(*_line_rankings(spark, sf)).select(
        "qid", "recall_10", "precision_10", "mrr", "hit_10"))


@register("m_score_query", f"""WITH {RANKINGS_SQL}
SELECT qid, tenant, query_class, round(ndcg_10, 6) AS ndcg_10, round(recall_10, 6) AS recall_10,
  round(recall_50, 6) AS recall_50, round(precision_10, 6) AS precision_10, round(mrr, 6) AS mrr,
  hit_10 FROM scores""")
def m_score_query(spark, sf):
    return plain(ev.score_queries(*_line_rankings(spark, sf)))


REPORT_METRICS = ", ".join(f"round(avg({m}), 4) AS {m}, count({m}) AS {m}_n"
                           for m in ev.METRIC_COLUMNS)


@register("agg_metric_macro", f"""WITH {RANKINGS_SQL}
SELECT count(*) AS n_queries, {REPORT_METRICS} FROM scores""")
def agg_metric_macro(spark, sf):
    return plain(ev.score_queries(*_line_rankings(spark, sf)).agg(*ev.macro_columns()))


@register("agg_eval_report", f"""WITH {RANKINGS_SQL}
SELECT CASE WHEN grouping(tenant) = 1 THEN 'OVERALL' ELSE tenant || '::' || query_class END
  AS bucket, count(*) AS n_queries, {REPORT_METRICS} FROM scores
GROUP BY GROUPING SETS ((tenant, query_class), ())""")
def agg_eval_report(spark, sf):
    return plain(ev.report(ev.score_queries(*_line_rankings(spark, sf))))


CLASS_SQL = f"""SELECT CASE WHEN grouping(query_class) = 1 THEN 'overall' ELSE query_class END
  AS bucket, count(*) AS n_queries, {REPORT_METRICS} FROM scores
GROUP BY GROUPING SETS ((query_class), ())"""


@register("agg_eval_report_class", f"WITH {RANKINGS_SQL} {CLASS_SQL}")
def agg_eval_report_class(spark, sf):
    return plain(ev.class_report(ev.score_queries(*_line_rankings(spark, sf))))


GATE_SQL = f"""WITH {RANKINGS_SQL}, current AS ({CLASS_SQL}),
baseline AS (SELECT bucket, ndcg_10 + 0.05 AS ndcg_10, recall_10 + 0.01 AS recall_10,
  CASE WHEN bucket = 'attribute' THEN NULL ELSE mrr END AS mrr FROM current
  WHERE bucket <> 'identifier'),
c AS (SELECT bucket, metric, current FROM (SELECT bucket, ndcg_10, recall_10, mrr FROM current)
  UNPIVOT INCLUDE NULLS (current FOR metric IN (ndcg_10, recall_10, mrr))),
b AS (SELECT bucket, metric, baseline FROM baseline
  UNPIVOT INCLUDE NULLS (baseline FOR metric IN (ndcg_10, recall_10, mrr)))"""


def _gate(spark, sf):
    current = ev.class_report(ev.score_queries(*_line_rankings(spark, sf)))
    baseline = current.where("bucket <> 'identifier'").select(
        "bucket", (F.col("ndcg_10") + 0.05).alias("ndcg_10"),
        (F.col("recall_10") + 0.01).alias("recall_10"),
        F.when(F.col("bucket") != "attribute", F.col("mrr")).alias("mrr"))
    return current, baseline


@register("join_baseline_gate", f"""{GATE_SQL}
SELECT bucket, metric, round(current, 6) AS current, round(baseline, 6) AS baseline,
  round(baseline - current, 6) AS drop FROM c JOIN b USING (bucket, metric)
WHERE baseline IS NULL OR current IS NULL OR baseline - current > 0.03""")
def join_baseline_gate(spark, sf):
    return plain(ev.baseline_gate(*_gate(spark, sf)))


@register("quality_gate", f"""{GATE_SQL}
SELECT count(*) FILTER (baseline IS NULL OR current IS NULL OR baseline - current > 0.03)
  AS failures, count(*) FILTER (baseline IS NULL OR current IS NULL OR baseline - current > 0.03)
  = 0 AS passed FROM c JOIN b USING (bucket, metric)""")
def quality_gate(spark, sf):
    failed = ev.baseline_gate(*_gate(spark, sf))
    return failed.agg(F.count("*").alias("failures"), (F.count("*") == 0).alias("passed"))


@register("intersect_keys", f"""{GATE_SQL} SELECT DISTINCT bucket FROM c JOIN b USING (bucket)""")
def intersect_keys(spark, sf):
    return ev.intersect_keys(*_gate(spark, sf))


@register("sink_results_json", f"""WITH {RANKINGS_SQL} {CLASS_SQL}""")
def sink_results_json(spark, sf):
    report = ev.class_report(ev.score_queries(*_line_rankings(spark, sf)))
    path = scratch_path(spark, "report")
    report.write.json(path, ignoreNullFields=False)
    return plain(spark.read.schema(report.schema).json(path))


# --- retrieval measured end to end ----------------------------------------------------

def _golden(spark, sf):
    return classify_query(sq.queries(spark, sf)).select("qid", "tenant", "query", "query_class")


@register("retrieval_report", f"""{sq.RANKED_SQL},
hits AS (SELECT p.qid, p.query_class, rank_before + 1 AS rank, coalesce(rel, 0) AS rel
  FROM pool p LEFT JOIN judgments j ON j.qid = p.qid AND j.sku = p.sku WHERE rank_before < 50),
rels AS (SELECT qid, count(*) AS n_rel, sum(3 / log2(r + 1)) FILTER (r <= 10) AS idcg FROM
  (SELECT qid, row_number() OVER (PARTITION BY qid) AS r FROM judgments) GROUP BY 1),
found AS (SELECT qid, sum(3 / log2(rank + 1)) FILTER (rel > 0 AND rank <= 10) AS dcg,
  count(*) FILTER (rel > 0 AND rank <= 10) AS h10, min(rank) FILTER (rel > 0) AS first
  FROM hits GROUP BY 1),
s AS (SELECT c.query_class, coalesce(dcg, 0) / idcg AS ndcg, coalesce(h10, 0) / n_rel AS recall,
  coalesce(1 / first, 0) AS rr FROM classified c JOIN rels USING (qid) LEFT JOIN found USING (qid))
SELECT CASE WHEN grouping(query_class) = 1 THEN 'overall' ELSE query_class END AS bucket,
  count(*) AS ndcg_10_n, round(avg(ndcg), 4) AS ndcg_10, round(avg(recall), 4) AS recall_10,
  round(avg(rr), 4) AS mrr FROM s GROUP BY GROUPING SETS ((query_class), ())""")
def retrieval_report(spark, sf):
    """Search the golden set and score it."""
    asked = sq.queries(spark, sf).withColumns({"rerank": F.lit(False), "limit": F.lit(50)})
    hits = hs.search(asked, st.docs(spark, sf))
    scores = ev.score_queries(_golden(spark, sf), hits, st.judgments(spark, sf))
    return plain(ev.class_report(scores).where("ndcg_10_n > 0").select(
        "bucket", "ndcg_10_n", "ndcg_10", "recall_10", "mrr"))


@register("pass_judgment_depth", f"""{sq.RANKED_SQL}
SELECT p.qid, p.sku, rank_before + 1 AS rank FROM pool p
JOIN (SELECT qid, count(*) AS n FROM judgments GROUP BY 1) USING (qid) WHERE rank_before < n""")
def pass_judgment_depth(spark, sf):
    depth = st.judgments(spark, sf).groupBy("qid").agg(F.count("*").cast("int").alias("limit"))
    asked = sq.queries(spark, sf).join(depth, "qid").withColumn("rerank", F.lit(False))
    return plain(hs.search(asked, st.docs(spark, sf)).select("qid", "sku", "rank"))


def _sweep_sql(classes: str, source: str) -> str:
    """Score per class and weight; ``source``, which ``classes`` states, has the class of a query."""
    return f"""{sq.LISTS_SQL}, {classes},
grid AS (SELECT l.*, CAST(i AS DOUBLE) / 10 AS alpha FROM lists l, range(11) t(i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY
    round(alpha * vec + (1 - alpha) * kw, 9) DESC, sku) AS rank FROM grid),
dcgs AS (SELECT alpha, r.qid, sum(3 / log2(rank + 1)) AS dcg FROM ranked r JOIN judgments j
  ON j.qid = r.qid AND j.sku = r.sku WHERE rank <= 10 GROUP BY 1, 2),
rels AS (SELECT qid, sum(3 / log2(r + 1)) FILTER (r <= 10) AS idcg FROM
  (SELECT qid, row_number() OVER (PARTITION BY qid) AS r FROM judgments) GROUP BY 1),
per AS (SELECT query_class, a.alpha, CASE WHEN idcg IS NOT NULL THEN coalesce(dcg, 0) / idcg END
    AS ndcg FROM {source} c CROSS JOIN (SELECT CAST(i AS DOUBLE) / 10 AS alpha FROM range(11) t(i))
    a LEFT JOIN rels USING (qid) LEFT JOIN dcgs d ON d.qid = c.qid AND d.alpha = a.alpha),
sweep AS (SELECT query_class, alpha, coalesce(avg(ndcg), 0) AS ndcg FROM per GROUP BY 1, 2)"""


SWEEP_SQL = _sweep_sql(sq._class_sql("golden", "query"), "classified")


def _sweep(spark, sf, golden=None, classes=()):
    lists = hs.candidate_lists(sq.queries(spark, sf), st.docs(spark, sf))
    return ev.alpha_sweep(lists, _golden(spark, sf) if golden is None else golden,
                          st.judgments(spark, sf), classes=classes)


@register("alpha_sweep", f"""{SWEEP_SQL}
SELECT query_class, alpha, round(ndcg, 6) AS ndcg FROM sweep""")
def alpha_sweep(spark, sf):
    return plain(_sweep(spark, sf))


@register("join_grid", f"""{sq.LISTS_SQL}
SELECT qid, CAST(i AS DOUBLE) / 10 AS alpha, count(*) AS n FROM lists, range(11) t(i)
GROUP BY ALL""")
def join_grid(spark, sf):
    lists = hs.candidate_lists(sq.queries(spark, sf), st.docs(spark, sf))
    grid = lists.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ev.ALPHAS])))
    return grid.groupBy("qid", "alpha").agg(F.count("*").alias("n"))


@register("argmax_alpha", f"""{_sweep_sql(st.LABELS_SQL.strip(), 'labelled')},
whole AS (SELECT k.query_class, w.alpha, coalesce(ndcg, 0) AS ndcg FROM
  (VALUES ('exploratory'), ('attribute'), ('identifier')) k(query_class)
  CROSS JOIN (SELECT CAST(i AS DOUBLE) / 10 AS alpha FROM range(11) t(i)) w
  LEFT JOIN sweep s ON s.query_class = k.query_class AND s.alpha = w.alpha),
own AS (SELECT query_class, alpha, ndcg FROM (SELECT *, row_number() OVER (
  PARTITION BY query_class ORDER BY round(ndcg, 9) DESC, alpha) AS r FROM whole) WHERE r = 1),
fixed AS (SELECT alpha, avg(ndcg) AS m FROM whole GROUP BY 1 ORDER BY round(m, 9) DESC, alpha
  LIMIT 1),
best AS (SELECT avg(ndcg) AS m FROM own)
SELECT query_class, own.alpha, round(ndcg, 6) AS ndcg, fixed.alpha AS fixed_alpha,
  round(fixed.m, 6) AS fixed_macro, round(best.m, 6) AS dynamic_macro,
  round(round(best.m, 9) - round(fixed.m, 9), 6) AS advantage FROM own, fixed, best""")
def argmax_alpha(spark, sf):
    """Classes are the golden set's labels, not what the router takes the queries for."""
    golden = st.golden_queries(spark, sf).select("qid", F.col("label").alias("query_class"))
    # 33 rows, read by every part of the answer.
    return plain(ev.tuned_alphas(materialise(_sweep(spark, sf, golden, CLASSES))))


@register("dynamic_advantage", f"""{SWEEP_SQL},
fixed AS (SELECT alpha, avg(ndcg) AS m FROM sweep GROUP BY 1 ORDER BY round(m, 9) DESC, alpha
  LIMIT 1),
best AS (SELECT avg(ndcg) AS m FROM (SELECT query_class, max(ndcg) AS ndcg FROM sweep GROUP BY 1))
SELECT fixed.alpha AS fixed_alpha, round(fixed.m, 6) AS fixed_macro,
  round(best.m, 6) AS dynamic_macro, round(best.m - fixed.m, 6) AS advantage FROM fixed, best""")
def dynamic_advantage(spark, sf):
    return plain(ev.dynamic_advantage(_sweep(spark, sf)))


# --- one metric at a time -------------------------------------------------------------

def _one_metric(name: str, columns: str) -> None:
    wanted = [c.strip() for c in columns.split(",")]
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in wanted)

    @register(name, f"WITH {RANKINGS_SQL} SELECT qid, {shown} FROM scores")
    def metric(spark, sf):
        return plain(ev.score_queries(*_line_rankings(spark, sf)).select("qid", *wanted))


_one_metric("m_ndcg", "ndcg_10")
_one_metric("m_recall", "recall_10, recall_50")
_one_metric("m_precision", "precision_10")
_one_metric("m_rr", "mrr")
_one_metric("m_hit", "hit_10")


@register("m_dcg", f"""WITH {RANKINGS_SQL} SELECT qid, round(dcg, 6) AS dcg FROM found""")
def m_dcg(spark, sf):
    _, rankings, judged = _line_rankings(spark, sf)
    hits = ev.join_judgments(ev.dedupe_ranking(rankings), judged)
    counted = (F.col("rank") <= 10) & (F.col("rel") > 0)
    return plain(hits.groupBy("qid").agg(F.sum(F.when(counted, ev.discounted(
        F.col("rel"), F.col("rank")))).alias("dcg")))
