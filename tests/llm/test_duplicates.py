"""Line dedup and the near-duplicate join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from shelfspark.llm import components, jaccard_join, line_dedup

from .conftest import CLASHES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def classes_and_links(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 5 * common >= 4 * len(sets[a][1] | sets[b][1]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least[r] is None else min(least[r], i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def copies(seed, groups=12, size=9):
    """Random texts, each with copies that differ in a few words."""
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [draw.choice("abcdefghij") + str(draw.randint(0, 400)) for _ in range(draw.randint(4, 160))]
        for _ in range(draw.randint(1, size)):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5, 9])):
                own[draw.randrange(len(own))] = str(draw.randint(0, 99))
            rows.append((len(rows), " ".join(own)))
    return rows


def test_join_equals_brute_force(spark, documents):
    rows = copies(1) + [(1000, ""), (1001, None), (1002, "..."), (1003, "a b"), (1004, "A, B!")]
    found = jaccard_join.near_duplicates(documents(rows, CLASHES)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == classes_and_links(rows)


def test_groups_larger_than_a_block(spark, documents):
    draw = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):
        own = list(base)
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(120)] = f"x{draw.randint(0, 9)}"
        rows.append((k, " ".join(own)))
    found = jaccard_join.near_duplicates(documents(rows), block=8).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == classes_and_links(rows)


def chain(n, words=40, step=12):
    """Texts that overlap with their neighbours by less than the threshold."""
    return [(k, " ".join(f"w{i}" for i in range(k * step, k * step + words))) for k in range(n)]


def test_a_chain_is_compared_along_its_candidates(spark, documents):
    rows = chain(300, 60, 6)
    signed = jaccard_join._signed(documents(rows).select("doc_id", "text"))
    shared = jaccard_join.shared_keys(signed)
    keys = defaultdict(set)
    for r in shared.collect():
        keys[r["key"]].add(r["node"])
    pairs = {(a, b) for nodes in keys.values() for a in nodes for b in nodes if a < b}
    held = jaccard_join._with_shingles(signed.select("node", "doc_id").join(documents(rows), "doc_id").selectExpr(
        "node", "1L AS weight", "doc_id", "text")).drop("doc_id")
    groups = jaccard_join.candidate_groups(shared)
    for block in (1000, 32, 4):
        found = jaccard_join.linked(held, groups, shared, block=block).collect()
        assert sum(r["compared"] for r in found) == len(pairs) < 300 * 20
    got = [tuple(r) for r in jaccard_join.near_duplicates(documents(rows), block=32).collect()]
    assert sorted(got) == classes_and_links(rows)


def thue_morse(n):
    """Two-letter strings that collide in polynomial hashes modulo powers of two."""
    text = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_strings_that_fool_hashes_modulo_powers_of_two(spark, documents):
    one, other = thue_morse(2048)
    rows = [(1, f"{one}\nsame line here"), (2, f"{other}\nsame line here"), (3, f"{one}\n{other}"), (4, other)]
    check_lines(documents, rows)
    found = [tuple(r) for r in jaccard_join.near_duplicates(documents(rows)).collect()]
    assert sorted(found) == classes_and_links(rows)


def test_join_of_odd_rows(spark, odd):
    found = jaccard_join.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert [r["class_id"] for r in found if r["doc_id"] is None] == [None, None]
    by_id = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found}
    assert by_id[9] == (8, 1) and by_id[8] == (8, 1)
    assert sorted(r["n_links"] for r in found if r["doc_id"] == 6) == [1, 1]


def test_one_id_with_two_texts(spark, documents):
    """Each text of an id has its own near copies, in whichever order the rows come."""
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(1, a), (1, b), (1, a), (10, a + " more"), (11, b + " more"), (12, "a text like no other here")]
    for given in (rows, rows[::-1]):
        found = jaccard_join.near_duplicates(documents(given)).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == classes_and_links(rows)


def test_empty_join(spark, documents):
    assert jaccard_join.near_duplicates(documents([])).count() == 0


def test_one_of_each_class_stays(spark, documents):
    rows = copies(2, 6, 6)
    kept = jaccard_join.keep_one(documents(rows, ["node"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in classes_and_links(rows)})
    assert kept.columns == [*documents([]).columns, "node"]


def test_pruning_keeps_similar_pairs():
    least = jaccard_join.least_matches(0.8)
    assert (np.diff(least[::jaccard_join.STEP]) > 0).all()
    draw = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = np.unique(draw.integers(0, 1 << 63, 300).astype(np.uint64))
        other = base.copy()
        other[:28] = draw.integers(0, 1 << 63, 28)
        sets += [base, np.unique(other)]
    a, b = np.arange(0, 120, 2), np.arange(1, 120, 2)
    kept, _ = jaccard_join.prune(jaccard_join.signatures(sets), a, b, least)
    assert len(kept) == 60
    far, _ = jaccard_join.prune(jaccard_join.signatures(sets), a, (b + 2) % 120, least)
    assert len(far) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 10), (5, 5), (3, 1), (20, 21), (40, 20), (41, 40), (42, 41)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [
        (1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (10, 7), (20, 20), (21, 20), (40, 20), (41, 20), (42, 20)]
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0


def dropped_lines(rows):
    spaces = " \t\n\x0b\f\r"
    first = {}
    lower = {c: c + 32 for c in range(65, 91)}
    keyed = [(i, [(x, x.strip(spaces).translate(lower)) for x in (t or "").split("\n")]) for i, t in rows]
    for i, found in keyed:
        for _, key in found:
            if len(key) >= 10 and i is not None:
                first[key] = min(first.get(key, i), i)
    return [(i, len(found), [x for x, key in found if i is None or len(key) < 10 or first[key] == i])
            for i, found in keyed]


def line_rows():
    draw = random.Random(8)
    pool = [" ".join(draw.choice(["Der", "die", "É", "und", "x9"]) for _ in range(draw.randint(1, 6)))
            for _ in range(60)]
    rows = []
    for k in range(80):
        picked = [draw.choice(["", " ", "\t"]) + draw.choice(pool) + draw.choice(["", "\r", "  "])
                  for _ in range(draw.randint(0, 9))]
        rows.append((k // 2 if k > 70 else k, "\n".join(picked)))
    return rows


def check_lines(documents, rows, **settings):
    found = line_dedup.dedup_report(documents(rows, CLASHES), **settings).collect()
    want = [(i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
            for i, n, kept in dropped_lines(rows)]
    key = lambda r: (r[0] is not None, *r)
    assert sorted(map(tuple, found), key=lambda r: tuple(map(str, r))) == sorted(
        want, key=lambda r: tuple(map(str, r)))
    del key


def test_lines_equal_brute_force(spark, documents):
    check_lines(documents, line_rows())


def test_lines_of_odd_rows(spark, odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_lines(documents, rows + [(None, "same line of some length"), (99, "Same line of SOME length ")])


def test_full_filters_only_suspect_more(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "_LEAST_BITS", 64)
    monkeypatch.setattr(line_dedup, "BITS_PER_LINE", 1)
    rows = line_rows()
    docs = documents(rows)
    few = line_dedup.lines_to_drop(docs, max_bits=64).collect()
    many = line_dedup.lines_to_drop(docs).collect()
    assert sorted((r["doc_id"], sorted(map(bytes, r["gone"]))) for r in few) == sorted(
        (r["doc_id"], sorted(map(bytes, r["gone"]))) for r in many)


def test_texts_without_their_lines(spark, documents):
    rows = line_rows()
    kept = line_dedup.dedup_lines(documents(rows + [(500, None)], CLASHES))
    want = sorted((i, "\n".join(k)) for i, _, k in dropped_lines(rows))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (500, None) in got and sorted(x for x in got if x[0] != 500) == want
    assert kept.columns == [*documents([]).columns, *CLASHES]


def test_no_lines(spark, documents):
    assert line_dedup.dedup_report(documents([])).count() == 0
