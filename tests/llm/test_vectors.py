"""Hard negatives and dimension-sharded clustering against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from shelfspark.llm import hard_negatives as hn
from shelfspark.llm import sharded_kmeans as km

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()),
    T.StructField("list", T.StringType()), T.StructField("cluster", T.StringType())])


def sample(n, d=64, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d))
    rows = (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)
    return [(int(i), rows[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


ODD = [(None, [0.5] * 64, 1), (901, None, 1), (902, [], 2), (903, [0.1] * 63 + [None], 1),
       (904, [0.1] * 63 + [float("nan")], 1), (905, [float("inf")] + [0.1] * 63, 2),
       (906, [0.2] * 64, None), (907, [0.2] * 65, 3), (908, [0.25] * 3, 3), (950, [0.0] * 64, 1),
       (1000, [0.3] * 64, 2), (1000, [0.3] * 64, 2), (1000, [0.1] * 64, 1), (1001, [3e30] + [0.0] * 63, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS)


def whole(rows):
    return [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]


def clip(x):
    return max(-(1 << 26), min(1 << 26, x))


def usable(row):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def negatives_of(rows):
    """The contract, pair by pair."""
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [clip(math.floor(256 * float(np.float32(x)))) for x in v])
            for i, v, label in rows if i is not None and label is not None and usable((i, v, label))]
    anchors = {}
    for i, label, v in kept:
        if i % 50 == 0 and (i not in anchors or (label, v) < anchors[i]):
            anchors[i] = (label, v)
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, g) for i, g, w in kept)
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            fit = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("rows", [sample(700), sample(400, labels=1), sample(300) + ODD, ODD,
                                  sample(150, d=20), sample(90, d=130), [(0, [0.5] * 64, 1)] * 40],
                         ids=lambda r: f"{len(r)} rows")
def test_hard_negatives(spark, rows):
    found = hn.hard_negatives(frame(spark, rows), rows=120)
    assert sorted(map(tuple, found.collect())) == negatives_of(rows)


def test_no_anchors(spark):
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, [(1, [0.5] * 64, 1)])).count() == 0


def test_intervals_hold_and_drop_rows():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(3000, 64)) * 32)
    block = hn.RowBlock.of(np.arange(3000), np.zeros(3000, np.int64), vectors)
    held = vectors[np.argsort(np.zeros(3000), kind="stable")]
    left = []
    for q in vectors[:40]:
        scores = held @ q
        probe = hn.Probe(hn.rotated(q[None, :])[0])
        for least, most in ((np.sort(scores)[-4], np.inf), (0, 500), (scores.max(), scores.max())):
            kept = probe.within(block, np.arange(3000), least, most)
            assert set(np.flatnonzero((scores >= least) & (scores <= most))) <= set(kept)
        left.append(len(probe.within(block, np.arange(3000), np.sort(scores)[-4], np.inf)))
    assert np.mean(left) < 1500


def lloyd_of(rows, k=40, rounds=5, start="2:"):
    kept = [(r[0], [clip(math.floor(256 * float(np.float32(x)))) for x in r[1]])
            for r in rows if usable(r) and len(r[1]) == 64]
    named = sorted((hashlib.sha256(f"{start}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (o, _) in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    total = sum(d for _, d in own)
    inertia = {c: sum(d for o, d in own if o == c) for c in range(len(centres))}
    return sorted(((i, o, d, inertia[o], total, hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest())
                   for (i, _), (o, d) in zip(kept, own)), key=str)


@pytest.mark.parametrize("rows", [sample(300), sample(30), sample(90) + ODD, ODD, [(7, [0.5] * 64, 1)] * 60],
                         ids=lambda r: f"{len(r)} rows")
def test_lloyd(spark, rows):
    found = km.lloyd(frame(spark, rows), chunk=64)
    assert sorted(map(tuple, found.collect()), key=str) == lloyd_of(rows)


def test_lloyd_empty(spark):
    assert km.lloyd(frame(spark, [])).count() == 0


def test_wide_components_are_exact():
    rng = np.random.default_rng(3)
    part, centres = rng.integers(-2**26, 2**26, (50, 16)), rng.integers(-2**26, 2**26, (7, 16))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)) for c in centres] for p in part]
    assert km.partial_distances(part, centres).tolist() == want
