"""The classifier's fit and the fingerprints, restated plainly."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import fingerprints, quality, queries
from barloom.llm.rolling import Powers, shared

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def statistics_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return quality.statistics(data, np.array([0, len(data)]))[0]


def test_the_fit_solves_the_normal_equations_of_all_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    text = documents(spark)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    ids = sorted(i for i in known if i in text)
    x, y = np.stack([statistics_of(text[i]) for i in ids]), np.array([known[i] for i in ids], float)
    np.testing.assert_allclose(model.mean, x.mean(0), rtol=1e-9, atol=1e-12)
    spread = x.std(0)
    np.testing.assert_allclose(model.spread, np.where(spread < 1e-9, 1, spread), rtol=1e-7)
    spare = {r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").where(F.pmod(F.xxhash64("i", F.lit("spare")), F.lit(4)) == 0).collect()}
    fitted = np.array([i not in spare for i in ids])
    z = np.clip((x - model.mean) / model.spread, -6, 6)
    waves = np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.directions + model.phases)
    design = np.column_stack([np.ones(len(x)), z, waves])[fitted]
    gram = design.T @ design
    gram[1:, 1:] += quality.RIDGE * fitted.sum() * np.eye(len(gram) - 1)
    np.testing.assert_allclose(gram @ model.weights, design.T @ y[fitted], atol=1e-5)
    # The calibration never falls, and its level over each stretch of equal scores is the share of good documents there.
    assert (np.diff(model.knots[1]) >= 0).all()
    scores = {r["doc_id"]: r for r in queries.op1_quality(spark, SF).collect()}
    assert set(scores) == set(text)
    for i, t in text.items():
        r = scores[i]
        assert r["score"] == pytest.approx(model.score(statistics_of(t)[None])[0], abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_pooled_levels_are_the_isotonic_fit():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 25))
        count = rng.integers(1, 9, n).astype(float)
        good = np.minimum(rng.integers(0, 9, n), count).astype(float)
        sums = lambda a, b: good[a : b + 1].sum() / count[a : b + 1].sum()
        level = [max(min(sums(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        got = quality.pool(count, good)
        blocks = np.array([round(v, 9) for v in level])
        for v in np.unique(blocks):  # a block's level, moved a little towards one half
            mine = np.flatnonzero(blocks == v)
            g, c = good[mine].sum(), count[mine].sum()
            np.testing.assert_allclose(got[mine], (g + 0.5 * (g > 0)) / (c + 0.5))


# -- fingerprints -------------------------------------------------------------------------


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_sketch(data, width=fingerprints.WIDTH, scale=fingerprints.SCALE):
    if not data:
        return set()
    h = shared(6)
    table, salt = [int(v) for v in h.table], int(h.salt)
    shingles = {data[i : i + width] for i in range(max(1, len(data) - width + 1))}
    found = {mixed(sum(table[b] * pow(Powers.BASE, i, 1 << 64) for i, b in enumerate(s)) + len(s) * salt & MASK) for s in shingles}
    kept = {v for v in found if v < (1 << 64) // scale}
    return kept or {min(found)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_a_plain_statement(spark):
    text = documents(spark)
    ids = sorted(text)[:60]
    docs = spark.createDataFrame([(i, text[i][:3000]) for i in ids] + [(10**6, None), (10**6 + 1, "é"), (10**6 + 2, "x" * 40)], "doc_id bigint, text string")
    given = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    assert len(rows) == len(given)
    off = []
    for (i, t), (_, following) in zip(given, given[1:] + given[:1]):
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        own, new, other = (plain_sketch(v.encode()) for v in (t, changed, following))
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{v:016x}" for v in sorted(own)) and r["edited_fingerprint"] == "".join(f"{v:016x}" for v in sorted(new))
        assert r["near_edited"] == likeness(own, new) and r["near_next"] == likeness(own, other)
        a, b = ({v[k : k + 16] for k in range(max(1, len(v) - 15))} if v else set() for v in (t.encode(), changed.encode()))
        off.append(abs(likeness(a, b) - r["near_edited"]))
    assert np.mean(off) < 0.08


def test_one_id_on_many_rows(spark):
    rows = [(7, f"text number {i % 3} " * 5) for i in range(600)] + [(8, "last one " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    made = fingerprints.compare_with_next(docs).collect()
    assert len(made) == 601 and len({r["fingerprint"] for r in made}) == 4
