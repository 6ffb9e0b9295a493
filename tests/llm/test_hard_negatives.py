import math

import numpy as np
import pytest

from tablesmith.llm import hard_negatives as mining


def brute(rows, low=80, high=100):
    parts = []
    for i, label, e in dict.fromkeys((i, y, None if e is None else tuple(e)) for i, y, e in rows):
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * x) for x in e]
        if sum(x * x for x in v) <= 2 ** 55:
            parts.append((i, label, v))
    out = []
    for i, label, v in parts:
        if i % 100:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, y) for j, y, w in parts if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in score if s[2] == label)[:5]:
            fit = sorted(s for s in score if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:5]
            out += [(i, j, k, n[1], -p, -n[0]) for k, n in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, y, e, 1, "x") for i, y, e in rows],
                               "vec_id long, label int, embedding array<double>, tie int, vec string").repartition(3)
    found = mining.hard_negatives(df, **k)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def some(n=600, dim=24, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    return [(k * 7, int(y), (0.6 * centres[y] + rng.normal(size=dim)).tolist()) for k, y in enumerate(label)]


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mining, "ROW_BLOCK", 100)
    monkeypatch.setattr(mining, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(mining, "STRIP", 2)
    rows = some()
    same = rows[3][2]
    rows += [(10_000 + k, 1 + k % 2, same) for k in range(30)]  # ties at the first places
    rows += [rows[0], rows[0], (None, 1, same), (5, None, same), (6, 1, None), (100_000, 1, [1.0, float("nan")] * 12),
             (8, 1, [float("inf")] * 24), (9, 1, [1e30] * 24), (100_100, 1, [None] * 24), (11, 1, []), (100_200, 1, []),
             (13, 2, []), (14, 1, [2.0]), (100_300, 1, [3.0]), (16, 2, [2.9]), (17, 3, [1.0]), (18, 1, [-5.0]), (100_400, 9, [7.0]),
             (100_500, 1, [0.0] * 24), (100_600, 2, [-0.3] * 24), (19, 2, [0.4] * 24), (20, 5, [5e5] * 1)]
    want = brute(rows)
    assert len({r[0] for r in want}) > 5
    assert got(spark, rows) == want
    assert got(spark, rows, low=50, high=95) == brute(rows, 50, 95)


def test_ids_that_several_rows_share(spark):
    rows = [(100, 1, [1.0, 0.0]), (100, 2, [0.9, 0.1]), (1, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.85, 0.0]), (100, 2, [0.9, 0.1])]
    found = got(spark, rows)
    assert found == brute(rows) and {r[0] for r in found} == {100} and all(100 not in (r[1], r[3]) for r in found)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, 1, [1.0])]) == got(spark, [(100, 1, [1.0])]) == []


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    v = np.floor(256 * rng.normal(size=(400, dim)) * rng.choice([1e-2, 1, 1e3], (400, 1)))
    w = np.concatenate([v[:40], np.floor(256 * rng.normal(size=(40, dim))), np.zeros((1, dim))])
    bits, *facts = mining.codes(v)
    made = mining.Anchors(w)
    low, high = made.intervals(slice(0, len(w)), bits, *facts)
    exact = w @ v.T
    assert (low <= exact).all() and (exact <= high).all()


def test_intervals_of_close_vectors_drop_most_rows():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(5000, 64))
    w = v[:20] + 0.1 * rng.normal(size=(20, 64))
    v, w = np.floor(256 * v), np.floor(256 * w)
    bits, *facts = mining.codes(v)
    low, high = mining.Anchors(w).intervals(slice(0, 20), bits, *facts)
    left = [(h >= mining._kth(lo, 1)).mean() for lo, h in zip(low, high)]
    assert np.mean(left) < 0.02
