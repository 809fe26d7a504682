"""Retrieval and evaluation on a small labelled catalog."""

import math

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.routing import classify_query
from shelfspark.functions.text import word_tokens, words
from shelfspark.functions.vectors import hashed_embedder
from shelfspark.operators import delta, evaluation, filters, search
from shelfspark.operators import feed_mapping as fm

# A kitchen and garden shop: sku, title, description, price, brand.
SHOP = """
PAN-CI-28|Ironwood Cast Iron Frying Pan|Even heat, pouring lips, oven safe|64|Ironwood
PAN-CI-32|Ironwood Cast Iron Frying Pan Large|For six portions, oven safe|72|Ironwood
PAN-AL-24|Feder Light Aluminium Crepe Pan|Flat rim, quick to heat|31|Feder
POT-ST-05|Ladle House Enamel Stock Pot|Five litres, tight lid|58|Ladle House
WOK-CS-30|Ironwood Carbon Steel Wok|Round bottom, beech handle|49|Ironwood
KNF-CH-20|Halde Chef Knife Walnut|Twenty centimetre blade, walnut handle|85|Halde
KNF-CH-O2|Halde Chef Knife Olive|Twenty centimetre blade, olive handle|85|Halde
LMP-SO-01|Halde Solar Garden Lantern|Dusk sensor, warm light|39|Halde
LMP-SO-02|Halde Solar Path Spikes|Set of four, dusk sensor|27|Halde
HOS-RB-25|Feder Rubber Hose|Twenty five metres, brass ends|44|Feder
JAR-GL-750|Halde Glass Storage Jar 750ml|Clip lid, rubber seal|9|Halde
BIN-CP-60|Ladle House Compost Bin|Sixty litres, vented|55|Ladle House
""".strip()

GOLDEN = {
    "PAN-CI-28": {"PAN-CI-28": 2}, "LMP-SO-01": {"LMP-SO-01": 2}, "JAR-GL-750": {"JAR-GL-750": 2},
    "Ironwood cast iron frying pan": {"PAN-CI-28": 2, "PAN-CI-32": 2},
    "Halde chef knife": {"KNF-CH-20": 2, "KNF-CH-O2": 2},
    "Halde solar dusk sensor": {"LMP-SO-01": 2, "LMP-SO-02": 2},
    "something with a chef knife blade": {"KNF-CH-20": 2, "KNF-CH-O2": 2},
}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(*line.split("|"), i) for i, line in enumerate(SHOP.splitlines())]
    raw = spark.createDataFrame(rows, "sku string, title string, description string, price string,"
                                      " brand string, feed_seq long")
    feeds = raw.withColumn("tenant", F.explode(F.array(F.lit("one"), F.lit("two"))))
    # The second tenant sells the same skus under other names.
    feeds = feeds.withColumn("title", F.when(F.col("tenant") == "two", F.concat(
        F.lit("Paper kite "), "feed_seq")).otherwise(F.col("title"))).withColumn(
        "description", F.when(F.col("tenant") == "one", F.col("description")))
    products = fm.accepted(fm.map_feed(feeds, fm.ColumnMapping(), keep_raw=False)).drop("raw")
    stored = delta.stored_projection(products)
    text = F.concat_ws("\n", "title", "brand", F.nullif("description", F.lit("")))
    return stored.withColumn("embedding", hashed_embedder(256)(text)).withColumn(
        "text", search.searchable_text()).cache()


def ask(spark, queries, tenant="one"):
    return spark.createDataFrame([(q, tenant, q) for q in queries],
                                 "qid string, tenant string, query string")


def run(spark, shop, queries, tenant="one", **columns):
    asked = ask(spark, queries, tenant)
    for name, value in columns.items():
        asked = asked.withColumn(name, value)
    return search.search(asked, shop, embedder=hashed_embedder(256))


def test_golden_set(spark, shop):
    hits = run(spark, shop, list(GOLDEN), rerank=F.lit(False))
    judged = spark.createDataFrame([(q, s, r) for q, js in GOLDEN.items() for s, r in js.items()],
                                   "qid string, sku string, rel int")
    asked = classify_query(ask(spark, list(GOLDEN)))
    scores = evaluation.score_queries(asked.select("qid", "tenant", "query_class"), hits, judged)
    overall = evaluation.class_report(scores).where("bucket = 'overall'").first()
    assert overall.n_queries == len(GOLDEN)
    assert overall.ndcg_10 > 0.93 and overall.recall_10 == 1.0 and overall.mrr > 0.9
    identifiers = evaluation.class_report(scores).where("bucket = 'identifier'").first()
    assert identifiers.mrr == 1.0
    baseline = evaluation.class_report(scores)
    assert evaluation.baseline_gate(baseline, baseline).count() == 0
    worse = baseline.withColumn("mrr", F.col("mrr") - 0.05)
    assert {r.metric for r in evaluation.baseline_gate(worse, baseline).collect()} == {"mrr"}


def test_tenants_never_mix(spark, shop):
    both = ask(spark, ["Ironwood cast iron frying pan"]).unionByName(
        ask(spark, ["paper kite 3"], "two"))
    hits = search.search(both, shop, embedder=hashed_embedder(256)).collect()
    assert {h.tenant for h in hits if h.qid == "paper kite 3"} == {"two"}
    assert {h.tenant for h in hits if h.qid != "paper kite 3"} == {"one"}
    first = [h.sku for h in hits if h.qid == "paper kite 3" and h["rank"] == 1]
    assert first == ["POT-ST-05"]


def test_filters_apply_before_ranking(spark, shop):
    wanted = F.from_json(F.lit('{"brands": ["Feder"], "max_price": 40}'),
                         search.matches.__globals__["FILTER_FIELDS"])
    hits = run(spark, shop, ["Ironwood cast iron frying pan"], filters=wanted).collect()
    assert [h.sku for h in hits] == ["PAN-AL-24"]
    nothing = run(spark, shop, ["pan"], filters=filters.no_filters()).collect()
    assert len(nothing) == 10


def test_alpha_ends_are_keyword_and_vector(spark, shop):
    query = "Halde solar dusk sensor"
    asked = ask(spark, [query])
    keyword = search.top_k(search.bm25(asked, shop), ["qid"], [F.desc("score"), F.asc("sku")], 2)
    zero = run(spark, shop, [query], alpha=F.lit(0.0), rerank=F.lit(False))
    assert [r.sku for r in zero.where("rank <= 2").orderBy("rank").collect()] == [
        r.sku for r in keyword.orderBy("rank").collect()]


def test_rerank_is_stable_and_skipped_for_codes(spark, shop):
    queries = ["chef knife", "PAN-CI-28"]
    asked = ask(spark, queries)
    hits = search.search(asked, shop, embedder=hashed_embedder(256), rerank_default=True)
    rows = {(h.qid, h["rank"]): h for h in hits.collect()}
    assert rows["chef knife", 1].reranked and not rows["PAN-CI-28", 1].reranked
    assert {rows["chef knife", i].sku for i in (1, 2)} == {"KNF-CH-20", "KNF-CH-O2"}
    assert rows["chef knife", 1].rank_before_rerank < rows["chef knife", 2].rank_before_rerank
    assert rows["chef knife", 1].score == rows["chef knife", 1].rerank_score == 1.5


def test_sorted_pool(spark, shop):
    hits = run(spark, shop, ["Halde"], limit=F.lit(50), rerank=F.lit(False))
    cheap = search.search_sorted(hits, shop, "price_asc", 3).orderBy("rank").collect()
    assert [c.sort_value for c in cheap] == [9.0, 27.0, 31.0]


def test_stats_count_rows_without_the_metric(spark, shop):
    got = filters.catalog_stats(shop, "rating", brands=["Halde"]).where("tenant = 'one'").first()
    assert (got["count"], got.minimum, got["mean"]) == (5, None, None)


def ranking(spark, skus, qid="q"):
    return spark.createDataFrame([(qid, s, i) for i, s in enumerate(skus)],
                                 "qid string, sku string, rank int")


def score(spark, skus, judged, **options):
    judgments = spark.createDataFrame([("q", s, r) for s, r in judged.items()],
                                      "qid string, sku string, rel int")
    asked = spark.createDataFrame([("q",)], "qid string")
    return evaluation.score_queries(asked, ranking(spark, skus), judgments, **options).first()


def test_hand_computed_metrics(spark):
    graded = {"A": 3, "B": 2, "C": 1}
    assert score(spark, ["A", "B", "C"], graded).ndcg_10 == 1.0
    assert score(spark, ["C", "B", "A"], graded).ndcg_10 == pytest.approx(0.680606, abs=1e-6)
    assert score(spark, ["x", "y", "A"], {"A": 1}).ndcg_10 == 0.5
    # A repeated sku counts once.
    repeated = score(spark, ["A", "A", "A", "B"], {"A": 1, "B": 1})
    assert repeated.recall_10 == 1.0 and repeated.precision_10 == 0.2
    missed = score(spark, ["x"], {"A": 1})
    assert (missed.mrr, missed.hit_10, missed.recall_10) == (0.0, 0.0, 0.0)
    undefined = score(spark, ["x"], {"A": 0})
    assert (undefined.ndcg_10, undefined.mrr) == (None, None)


@pytest.mark.parametrize(("exponential", "expected"), [(True, 9.3927893), (False, 4.7618595)])
def test_dcg_gains(spark, exponential, expected):
    hits = spark.createDataFrame([(3, 1), (2, 2), (1, 3)], "rel int, rank int")
    dcg = hits.agg(F.sum(evaluation.discounted(F.col("rel"), F.col("rank"), exponential))).first()[0]
    assert dcg == pytest.approx(expected, abs=1e-6) and not math.isnan(dcg)


def test_pools_follow_each_query(spark):
    """A query that asks for more than the usual pool gets it, beside one that doesn't."""
    docs = spark.range(300).select(F.lit("one").alias("tenant"), F.concat(
        F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("sku"), F.lit("red bowl").alias("text"))
    asked = spark.createDataFrame([("a", "one", "bowl", 100), ("b", "one", "bowl", 7), ("c", "one", "red", 60)],
                                  "qid string, tenant string, query string, limit int")
    hits = search.search(asked, docs).groupBy("qid").count().collect()
    assert {h["qid"]: h["count"] for h in hits} == {"a": 100, "b": 7, "c": 60}


def test_bm25_by_blocks(spark, monkeypatch):
    """Blocks of queries, shuffled or not, give the scores of saved postings; a cut list stays short."""
    words = ["pan", "pot", "lid", "wok", "ladle", "tin"]
    docs = spark.createDataFrame(
        [(f"t{i % 2}", f"D{i:04d}", " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 7))) for i in range(900)]
        + [("t0", "none", None), ("t1", "blank", "")], "tenant string, sku string, text string").coalesce(1)
    asked = spark.createDataFrame([(f"q{j}", f"t{j % 2}", f"{words[j % 6]} {words[j // 2 % 6]} rare{j}") for j in range(9)],
                                  "qid string, tenant string, query string")
    rows = lambda found: {(r.tenant, r.qid, r.sku): round(r.score, 6) for r in found.collect()}
    want = rows(search.bm25(asked, docs, search.postings(docs)))
    assert rows(search.bm25(asked, docs)) == want
    best = search.bm25(asked, docs, k=3)
    order = [F.desc("score"), F.asc("sku")]
    first = search.top_k(search.bm25(asked, docs), ["qid"], order, 3).select("qid", "sku", "rank")
    assert sorted(search.top_k(best, ["qid"], order, 3).select("qid", "sku", "rank").collect()) == sorted(first.collect())
    assert best.count() < len(want) / 2
    monkeypatch.setattr(search.keyword_blocks, "QUERY_ROWS", 2)
    monkeypatch.setattr(search.keyword_blocks, "BROADCAST_BLOCKS", 0)
    assert rows(search.bm25(asked, docs)) == want


def test_candidate_lists_are_stored(spark):
    """What follows reads the lists again and again without searching again."""
    docs = spark.createDataFrame([("t", f"D{i}", f"pan pot{i}") for i in range(5)], "tenant string, sku string, text string")
    asked = spark.createDataFrame([("q", "t", "pan pot3")], "qid string, tenant string, query string")
    plan = search.candidate_lists(asked, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_packs_hold_asked_words_only(spark):
    """What travels of a document is its length and the words that queries ask for."""
    docs = spark.createDataFrame([("t", "A", "Straße 12 – red_red x"), ("t", "B", None), (None, "C", "red")],
                                 "tenant string, sku string, text string").coalesce(1)
    blocks = search.keyword_blocks
    asked = blocks.shared_terms(spark.createDataFrame([("red",), ("straße",), ("blue",)], "term string"))
    (pack,) = blocks._packs(docs, asked).collect()
    assert sorted(pack["words"]) == ["red", "straße"] and pack["sizes"] == [5] and pack["counts"] == [3]
    counts = {r["term"]: tuple(r)[2:] for r in blocks.term_counts(docs, asked).collect()}
    assert counts == {"": (2, 1, 5), "red": (1, 0, 0), "straße": (1, 0, 0)}


def test_words_in_tasks_are_those_of_the_column(spark):
    texts = ["Straße 12 – red_red", "ÀÉ²½ x’s Ⅷ١٢", "", "\t\u00a0a\u3000b\u0085c", "ΣΑΣ İx 東京2020 😀ok"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_tokens(F.col("t")).alias("w"))
    assert {r.t: r.w for r in frame.collect()} == {t: words(t) for t in texts}
