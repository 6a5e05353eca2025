"""Components: equal to a plain union-find, and few tasks."""

import random
import uuid

from barloom.llm import components, near
from barloom.llm.common import Stored

EDGE = "_a bigint, _b bigint"


def by_hand(edges):
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def tasks(spark, run):
    """How many tasks ran, with 20 partitions to each shuffle."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", group)
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)


def test_components_and_merged_equal_union_find(spark):
    rng = random.Random(11)
    first = [(rng.randrange(-60, 200), rng.randrange(-60, 200)) for _ in range(90)] + [(5, 5), (300, 301), (301, 300), (300, 301)]
    first += [(900, 400 + i) for i in range(20)] + [(1000, 1001 + i) for i in range(20)]  # the hub last, the hub first
    more = [(900, 1007), (301, 2000), (2000, 2001), (3001, 3000), (3000, 3001), (7, 7)] + [(rng.randrange(-60, 200), rng.randrange(-60, 400)) for _ in range(20)]
    store = Stored(spark)
    found = components.components(spark.createDataFrame(first, EDGE), store)
    rows = found.collect()
    assert dict(rows) == by_hand(first) and len(rows) == len(dict(rows))
    after = components.merged(found, spark.createDataFrame(more, EDGE), store).collect()
    assert len(after) == len(dict(after))
    want, got = by_hand(first + more), dict(after)
    assert {k: v for k, v in got.items() if v != k or k in want} == want
    assert components.components(spark.createDataFrame([(4, 4)], EDGE), store).count() == 0


def test_components_take_few_tasks(spark):
    store = Stored(spark)
    stars = store.keep(spark.createDataFrame([(1, i) for i in range(2, 40)] + [(100, i) for i in range(101, 140)], EDGE))
    path = store.keep(spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 5), (9, 2)], EDGE))
    assert tasks(spark, lambda: components.components(stars, store).collect()) <= 120  # 220 with a round that only confirms
    assert tasks(spark, lambda: components.components(path, store).collect()) <= 560  # was 660


def test_near_duplicates_take_few_tasks(spark):
    """Groups of near copies whose links name components that later links join."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(60):
        words = list(base[i % 3])
        for _ in range(i % 4):
            words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = Stored(spark).keep(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert tasks(spark, lambda: near.near_duplicates(docs).collect()) <= 950  # was 1,177
