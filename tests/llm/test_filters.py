"""Decontamination, language, quality, rules and the pipeline."""

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from shelfspark.llm import decontaminate, lang_id, quality_fm, quality_rules

from .conftest import CLASHES
from .test_duplicates import classes_and_links, dropped_lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def hits_of(text, items):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(10, len(own))
        windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1 if own else 0):
            if tuple(words[k:k + size]) in windows:
                hit |= {*range(k, k + size)}
                found.add(str(name))
    return len(words), len(hit), len(found)


LONG_ITEM = " ".join(f"item{k}" for k in range(25))
ITEMS = [(1, LONG_ITEM), (10, "Short item, here!"), (2, ""), (3, None), (10, "another short"), (4, "É ß x")]
TEXTS = [
    (1, "before " + LONG_ITEM.upper() + " after"), (2, "a short item here and SHORT ITEM HERE"),
    (3, " ".join(f"item{k}" for k in range(9))), (4, "item " * 30), (5, None), (6, ""),
    (7, "x " * 5000 + "é ß x É ß X"), (8, "another short item here"), (9, LONG_ITEM + ". " + LONG_ITEM)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*ITEMS, (None, "nobody knows")], "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.SLICE_WINDOWS, 3])
def test_hits_equal_brute_force(spark, documents, items, limit):
    found = decontaminate.hit_report(documents(TEXTS, CLASHES), items, limit=limit).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found} == {
        i: hits_of(t, ITEMS) for i, t in TEXTS}


def test_clean_documents_stay(spark, documents, items, odd):
    docs = documents(TEXTS, CLASHES)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in TEXTS if not hits_of(t, ITEMS)[1]}
    assert decontaminate.decontaminate(odd, items).count() == odd.count()
    assert decontaminate.hit_report(documents([]), items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_spans_are_cut(spark, documents, items):
    kept = {r["doc_id"]: r["text"] for r in
            decontaminate.decontaminate(documents(TEXTS), items, remove="spans").collect()}
    assert kept[1] == "before  after" and kept[9] == "" and kept[2] == "a  and " and kept[5] is None
    with pytest.raises(ValueError):
        decontaminate.decontaminate(documents(TEXTS), items, remove="nothing")


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = lang_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_distance_equals_brute_force(spark):
    rows = [("xx", "abab abba"), ("yy", "cdcd ab"), (None, "zzz"), ("xx", None)]
    learned = lang_id.profiles(spark.createDataFrame(rows, "lang string, text string"), top=6)

    def grams(text):
        found = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"\0{word}\0"
            found.update(("", "", c) for c in word)
            found.update(("", *padded[k:k + 2]) for k in range(len(padded) - 1))
            found.update(tuple(padded[k:k + 3]) for k in range(len(padded) - 2))
        return found

    def ranked(counts):
        def key(g):
            return [0x1FFFFF if c == "" else ord(c) for c in g]
        return sorted(counts, key=lambda g: (-counts[g], key(g)))[:6]

    taught = {n: {g: k for k, g in enumerate(ranked(sum((grams(t) for m, t in rows if m == n and t), Counter())))}
              for n in ("xx", "yy")}
    texts = [(1, "abba"), (2, "cd dc cd"), (3, "1 2"), (4, None), (5, "Qq")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in lang_id.predict(docs, learned, top=6).collect():
        own = ranked(grams(dict(texts)[r["doc_id"]] or ""))
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {n: sum(abs(k - p[g]) if g in p else 6 for k, g in enumerate(own)) for n, p in taught.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 - far[best] / (6 * len(own)))


def test_language_of_odd_rows(spark, odd, documents):
    found = lang_id.language_report(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] for r in found if r["doc_id"] is None)
    kept = lang_id.keep_known(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 3, 4, 5})
    assert lang_id.language_report(documents([])).count() == 0
    nobody = odd.withColumn("lang", odd["lang"].substr(9, 1)).where("doc_id IS NULL")
    assert {r["lang_pred"] for r in lang_id.language_report(nobody).collect()} == {"und"}


FOREIGN = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "zh": "人人生而自由，在尊严和权利上一律平等", "mixed": "Все люди x рождаются свободными и равными",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"}


def test_unlearned_languages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    english = docs.where("lang = 'en'")
    for taught, gone in ((docs, ("ru", "zh")), (english, FOREIGN)):
        foreign = spark.createDataFrame([(-k - 1, FOREIGN[n], None) for k, n in enumerate(gone)], docs.schema)
        kept = lang_id.keep_known(taught.union(foreign))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in taught.collect())


def test_few_texts_reject_only_what_shares_nothing(spark):
    rows = [(k, "the same words", "en") for k in range(20)] + [(50, "then other", None), (51, "Ж", None)]
    kept = lang_id.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == {*range(20), 50}


def test_quality_of_held_out_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_fm.quality_report(docs, labels)
    assert found.count() == docs.count()
    out = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.9 * len(out)


def test_sum_of_squares_is_the_sum_over_pairs():
    import numpy as np

    draw = np.random.default_rng(0)
    machine = quality_fm.Machine(0.3, 9, np.zeros((0, 2)))
    machine.weights, machine.factors = draw.normal(size=9), draw.normal(size=(9, quality_fm.FACTORS))
    x = draw.normal(size=(4, 9))
    for row, raw in zip(x, machine.raw(x)[0]):
        pairs = sum(row[i] * row[j] * machine.factors[i] @ machine.factors[j]
                    for i in range(9) for j in range(i))
        assert raw == pytest.approx(0.3 + row @ machine.weights + pairs)


def test_quality_of_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame(
        [(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 1)],
        "doc_id long, quality int, toxic int")
    found = quality_fm.quality_report(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert {r["score"] for r in quality_fm.quality_report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.quality_report(documents([]), labels).count() == 0


def rules_of(rows, trusted, buckets):
    """Base counts and scores by plain loops."""
    def hash64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def pair(a, b):
        return hash64(b.to_bytes(8, "little"), hash64(a.to_bytes(8, "little")))

    def bucket(h):
        return (h - (1 << 64) if h >> 63 else h) % buckets

    told, raw, target = {}, Counter(), Counter()
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        hashes = [hash64(w.encode()) for w in words]
        grams = [bucket(h) for h in hashes] + [bucket(pair(a, b)) for a, b in zip(hashes, hashes[1:])]
        raw.update(grams)
        if i in trusted:
            target.update(grams)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = set()
        for k in range(len(words) - 2):
            if windows[tuple(words[k:k + 3])] > 1:
                repeated |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        told.setdefault(i, []).append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
                                       len(lines) - len(set(lines)), len(repeated), grams))
    scale = sum(target.values()) / max(1, sum(raw.values()))
    ratio = {b: math.log((target[b] + 2) / (raw[b] * scale + 2)) for b in raw}
    return {i: sorted((*c[:5], round(sum(ratio[b] for b in c[5]) / len(c[5]), 4) if c[5] else 0.0) for c in found)
            for i, found in told.items()}


@pytest.mark.parametrize("buckets", [64, quality_rules.BUCKETS])
def test_rules_equal_brute_force(spark, odd, documents, buckets):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    rows += [(200 + k, f"good words in a plain row {k} " * 12) for k in range(6)]
    rows += [(300 + k, f"bad### w*** | x{k} " * 20 + "\na\na\n \n") for k in range(6)]
    labels = spark.createDataFrame([(200 + k, 1, 0) for k in range(6)] + [(300, 0, 0), (301, 1, 1), (301, 1, 0),
                                    (200, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_rules.rule_report(documents(rows, CLASHES), labels, buckets=buckets).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], round(r["llr"], 4)))
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["llr"] >= quality_rules.THRESHOLD)
    want = rules_of(rows, {200 + k for k in range(6)}, buckets)
    assert got.keys() == want.keys()
    for i, own in want.items():
        for a, b in zip(sorted(got[i]), own):
            assert a == pytest.approx(b, abs=2e-4)


def test_rules_without_python_or_rows(spark, sf, documents):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality_rules.rule_report(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules.rule_report(documents([]), labels).count() == 0
    found = quality_rules.rule_report(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] for r in found if r["quality"] == 1 and r["toxic"] == 0)
    assert not any(r["kept"] for r in found if r["quality"] == 0)


def test_pipeline_stages_equal_brute_force(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    from shelfspark.llm.pipeline import tokenizer_path

    texts = [("The quick brown fox jumps over the lazy dog and runs far away into the wood " + str(k)) for k in range(6)]
    shared = "This line is in many of the documents"
    rows = [(k, f"{t}\n{shared}\nown line number {k * 7919} of this text") for k, t in enumerate(texts)]
    rows += [(20, None), (21, "123 ..."), (22, texts[0]), (23, LONG_ITEM), (24, "petit texte sans histoire aucune")]
    folder = f"file://{tmp_path}"
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "tokens"]

    live = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    live = [(i, "\n".join(kept)) for i, _, kept in dropped_lines(live)]
    heads = {c for _, c, _ in classes_and_links(live)}
    live = [(i, t) for i, t in live if i in heads and not hits_of(t, ITEMS)[1]]
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in live)
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()) == want

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        docs = kept
