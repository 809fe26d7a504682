"""Registered queries against their SQL on the smallest tables.

One or two per family by default; TEST_ALL_QUERIES=1 runs all of them, and check_queries.py
does so on any folder.
"""

import os
from pathlib import Path

import duckdb
import pytest

from check_queries import canonical
from shelfspark.plans import all_oracles, all_queries

SAMPLE = [
    "src_csv_feed", "src_row_number", "map_columns", "reject_rows", "parse_price", "clean_text_pages",
    "stored_projection", "sink_upsert_table", "dedupe_last_wins", "join_delta", "agg_parse_stats",
    "join_roundtrip_diff", "agg_catalog_stats", "agg_catalog_stats_many", "filter_search",
    "agg_numeric_summary_lines", "agg_category_diversity", "dq_report", "group_contrast", "knn_topk",
    "enrich_classify", "classify_query", "bm25_preview", "search", "search_filtered", "alpha_sweep",
    "m_score_query", "agg_eval_report", "join_baseline_gate", "verify_turns", "agg_generation",
    "join_paired_tiers", "merge_evidence", "conversation_state", "join_tool_call_result",
    "join_semantic_cache", "agg_usage_by_model", "hist_quantile", "alert_latency", "alert_cost",
    "rate_limit", "stream_usage", "stream_rate_limit", "incremental_ingest",
]
NAMES = list(all_queries()) if os.environ.get("TEST_ALL_QUERIES") else SAMPLE


def test_every_query_states_its_result():
    assert set(all_queries()) == set(all_oracles())


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, tables, name):
    frame = all_queries()[name](spark, sf)
    got = [tuple(r) for r in frame.collect()]
    sql = all_oracles().get(name)
    if sql is None:
        return
    cursor = tables.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(got, frame.columns) == canonical(cursor.fetchall(), columns)


def test_judgments_in_several_passes(spark, tmp_path, monkeypatch):
    """Passages of any length, more of them than a pass takes, found wherever a text holds them."""
    from shelfspark.plans import standins

    monkeypatch.setattr(standins, "PASSAGES", 2)
    passages = ["a b", "one two three", "x  y z w v", "lone", "wo three\tfou", "q w e r t y"]
    texts = ["zz one two three four", "one two three\tfour", "x  y z w v", "x y z w v", "alone a bc", None, "q w e r ty"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(f"en-{i}", f"D{d}") for i, p in enumerate(passages) for d, t in enumerate(texts) if t and p in t}
    found = standins.judgments(spark, str(tmp_path))
    assert {(r.qid, r.sku) for r in found.collect()} == want and len(want) >= 5
    assert found.count() == len(want)



def answer(spark, folder, name):
    """Rows of a query by class, once they are those of its SQL."""
    frame = all_queries()[name](spark, str(folder))
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cursor, got = con.execute(all_oracles()[name]), frame.collect()
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical([tuple(r) for r in got], frame.columns) == canonical(cursor.fetchall(), columns)
    return {r.query_class: r for r in got}


def test_best_alphas_by_label(spark, tmp_path):
    """Queries count for the class they were made for, a class without any scores 0, and the best single
    weight stands beside the classes' own."""
    passages = [(0, "plain words of a passage that is long and bare of cues"), (3, "red cotton for small hands"),
                (1, "a walk along the river in spring"), (4, "lamp oil and lamp glass")]
    texts = ["here " + p + " there" for _, p in passages] + [
        "lamp lamp lamp lamp", "red red red red hands", "river river spring", "bare bare passage", "red cotton for small"]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    got = answer(spark, tmp_path, "argmax_alpha")
    assert set(got) == {"exploratory", "attribute", "identifier"}
    assert got["attribute"].ndcg > 0 and got["exploratory"].ndcg > 0
    assert (got["identifier"].alpha, got["identifier"].ndcg) == (0.0, 0.0)
    beside = {tuple(r)[3:] for r in got.values()}
    assert len(beside) == 1
    _, fixed, dynamic, advantage = beside.pop()
    assert dynamic == pytest.approx(sum(r.ndcg for r in got.values()) / 3, abs=2e-6)
    assert advantage == pytest.approx(dynamic - fixed, abs=2e-6)


def test_tuned_alphas(spark):
    """By hand: the lowest weight wins a tie, of a class and of all classes together."""
    from shelfspark.operators import evaluation as ev

    scores = {"a": {.1: .5, .2: .9, .3: .9}, "b": {.1: .7, .2: .3, .3: .1}, "c": {.1: .0, .2: .0, .3: .0}}
    sweep = spark.createDataFrame([(c, w, s) for c, row in scores.items() for w, s in row.items()],
                                  "query_class string, alpha double, ndcg double")
    got = {r.query_class: tuple(r)[1:] for r in ev.tuned_alphas(sweep).collect()}
    shared = (.1, pytest.approx(.4), pytest.approx(1.6 / 3), pytest.approx(.4 / 3))
    assert got == {"a": (.2, .9, *shared), "b": (.1, .7, *shared), "c": (.1, .0, *shared)}
