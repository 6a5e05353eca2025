"""Top-k search where components are huge, against plain Python integers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import knn

DDL = "vec_id bigint, embedding array<double>, _v string, _norm int, score int, rank int"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def brute_force(rows, k):
    taken = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) or not math.isfinite(c * 256) for c in x):
            continue
        v = [int(math.floor(c * 256)) for c in x]
        while v and not v[-1]:
            v.pop()
        if (i, v) not in taken:
            taken.append((i, v))
    out = []
    for i, v in taken:
        if i % 10 == 0:
            ranked = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -knn.HIGH), knn.HIGH), j) for j, w in taken if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, rows, **options):
    made = knn.top_inner(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DDL).repartition(3), F.col("vec_id") % 10 == 0, **options)
    assert made.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in made.collect())


@pytest.mark.parametrize("options", [{}, dict(pivots=4, block=2, shard=20)])
def test_finite_vectors_of_any_length(spark, options):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    rows += [(100, [262_144.0, 1.0, 0.5, 0.25]), (101, [262_144.0, 1.0, 0.5, 0.5]), (110, [3e38, -2.0, 1.0]), (111, [1e200, 1.0]), (120, [-1e300, 4.0]),
             (121, [2.0**60, 3.0]), (130, [1.0 / 3, 2.0**50, 7.0]), (131, [1.0 / 3, 2.0**50, 7.5]), (140, []), (150, [0.0, 0.0]), (160, None),
             (170, [None, 1.0]), (180, [float("nan")]), (190, [float("inf"), 0.0]), (191, [1e307]), (100, [262_144.0, 1.0, 0.5, 0.25]), (None, [1.0])]
    want = brute_force(rows, 5)
    assert {r[0] for r in want} >= {100, 110, 120, 130, 140, 150} and any(abs(r[3]) == knn.HIGH for r in want)
    assert run(spark, rows, **options) == want


def test_nothing_to_find(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == [] and run(spark, [(10, [1.0])]) == []
    assert run(spark, [(10, [1.0]), (10, [2.0]), (11, [1.0])], k=3) == [(10, 1, 11, 65536), (10, 1, 11, 131072)]
