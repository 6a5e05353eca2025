"""Hard negatives against plain Python integers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import negatives

DDL = "vec_id bigint, label int, embedding array<double>, _v string, _tile int, score int"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def brute_force(rows, is_anchor, k=5, low=80, high=100):
    taken = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) or not math.isfinite(c * 256) for c in x):
            continue
        v = [int(math.floor(c * 256)) for c in x]
        while v and not v[-1]:
            v.pop()
        if (i, label, tuple(v)) not in taken:
            taken.append((i, label, tuple(v)))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), negatives.LOW), negatives.HIGH)
    out = []
    for row in taken:
        i, label, v = row
        if not is_anchor(i):
            continue
        ranked = sorted((-score(v, w), j, m, w) for j, m, w in taken)
        positives = [(-s, j) for s, j, m, w in ranked if m == label and (j, m, w) != row][:k]
        for p, j in positives:
            hits = [(-s, n) for s, n, m, _ in ranked if m != label and low * p <= 100 * -s <= high * p][:k]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DDL).repartition(3)
    made = negatives.hard_negatives(frame, F.col("vec_id") % 4 == 0, **options)
    assert made.columns == COLS
    return sorted(tuple(r) for r in made.collect())


def cloud(n, width, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0.3, 1) for _ in range(width)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, dict(shard=16, tiles=6, block=3), dict(shard=5, tiles=3, block=1)])
def test_equals_brute_force(spark, options):
    rows = cloud(150, 5, 3)
    same = [0.5, 0.25, 0.5, 0.5, 1.0]
    rows += [(200 + i, i % 2, same) for i in range(30)] + [(300 + i, 1, [0.0] * 5) for i in range(9)]  # copies, ties, a hot vector
    rows += [(400, None, same), (None, 1, same), (404, 1, None), (408, 1, [0.1, None, 0.2]), (412, 1, [float("nan"), 1.0]), (416, 1, [float("inf")]),
             (420, 2, []), (424, 2, [0.5, 0.25]), (428, 1, [-0.0, 0.0, 0.7]), (432, 1, same), (432, 1, same), (436, 3, same), (436, 1, same)]
    want = brute_force(rows, lambda i: i % 4 == 0)
    assert want and run(spark, rows, **options) == want


def test_scores_beyond_doubles(spark):
    rows = cloud(40, 3, 5, labels=2)
    rows += [(100, 0, [3.0e7, 1.0, 2.0]), (101, 0, [2.9e7, 1.5, 0.5]), (102, 1, [2.8e7, 1.25, 0.5]), (103, 1, [2.8e7, 1.5, 0.5]), (104, 0, [1e200, 0.0, 0.0]),
             (105, 0, [1e300, 1.0, 0.0]), (106, 1, [1e250, 1.0, 0.0]), (107, 1, [1.0, 1e307, 0.0]), (108, 1, [-1e30, 4.0, 0.0])]
    want = brute_force(rows, lambda i: i % 4 == 0)
    assert any(abs(r[5]) > 1 << 53 for r in want) and any(r[5] == negatives.HIGH for r in want)
    assert run(spark, rows) == want
    assert run(spark, rows, shard=8, tiles=4) == want


def test_other_windows(spark):
    rows = cloud(120, 4, 9)
    for low, high in ((0, 50), (95, 95), (0, 100)):
        assert run(spark, rows, low=low, high=high, positives=3, negatives=2, shard=20) == [
            r for r in brute_force(rows, lambda i: i % 4 == 0, 5, low, high) if r[2] <= 2 and r[1] in first(rows, r[0], 3)]


def first(rows, anchor, n):
    vectors = {i: (label, [int(math.floor(c * 256)) for c in x]) for i, label, x in rows}
    label, v = vectors[anchor]
    return [j for _, j in sorted((-sum(a * b for a, b in zip(v, w)), j) for j, (m, w) in vectors.items() if m == label and j != anchor)[:n]]


def test_nothing_to_find(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []  # no anchor
    assert run(spark, [(4, 0, [1.0]), (5, 1, [1.0])]) == []  # no positive
    assert run(spark, [(4, 0, [-1.0]), (5, 0, [1.0]), (6, 1, [0.5])]) == []  # negative scores only
    assert run(spark, [(4, 0, []), (8, 0, []), (5, 1, [])]) == brute_force([(4, 0, []), (8, 0, []), (5, 1, [])], lambda i: i % 4 == 0)
