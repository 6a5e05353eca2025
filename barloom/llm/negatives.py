"""Hard negatives by inner product, through STR-packed R-trees.

For an anchor and each of its positives (the best rows of its label), the negatives are the
best rows of other labels whose score is in a window below the positive's. A bounding box
gives an interval of inner products: each coordinate adds the smaller and the larger of its
two products. A box is left out if its interval misses all windows, or ends strictly below
the worst of the k results that are known (equal scores may have smaller ids).

The tree has three parts. Its top are at most ``TILES`` tiles, cut by sort-tile-recursive order at
quantiles of the two coordinates that vary most; their boxes are all that the driver sees. A
tile with more than ``SHARD`` vectors is dealt over shards. Each shard packs its own vectors, label by
label, into leaves and levels of boxes, and searches them best first. A search has two
rounds: each query asks the tile with the highest bound, and then, with the k-th score found there,
the tiles whose bounds still allow better. Queries go to the shards, a shard's vectors
come once (or once for each ``BLOCK`` queries), sorted before the queries in the same task, so a task holds
one shard and a batch of queries.

Vectors of one label that are equal are one entry with its k + 1 smallest ids: more cannot be
among the results. Queries are such entries, too.

Cases: a null id, label or vector, a null or non-finite component, or one that is not finite
when scaled, takes no part; shorter vectors count as padded with zeros; rows equal in id,
label and vector count once, and a row is no positive of itself. Scores are exact; beyond 64
bits they stop at the ends of the range. No anchors, no positives or no negatives in a window
give no rows. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import Stored, arrow, partitions

SCALE = 256
TILES = 1024
SHARD = 8192
BLOCK = 65_536  # queries that ask one copy of a shard
LEAF = 64
FAN = 8
EXACT = float(1 << 52)  # below it, inner products in doubles are exact
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def reached(score: int) -> float:
    """A score as the bound of a box's interval; at the ends of the range, scores stand for all beyond."""
    return -np.inf if score <= LOW else np.inf if score >= HIGH else float(score)


ENTRY_DDL = "label bigint, _v binary, _ids array<bigint>"
ASK_DDL = "label bigint, _v binary, _lo array<bigint>, _hi array<bigint>, _floor array<bigint>"
HIT_DDL = "label bigint, _v binary, _hi bigint, score bigint, vec_id bigint, _own boolean"


# -- vectors ------------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Whole-numbered components without trailing zeros, as 32-bit integers where they fit."""
    x = x[: np.flatnonzero(x)[-1] + 1] if x.any() else x[:0]
    return b"\4" + x.astype("<i4").tobytes() if (np.abs(x) < 2**31).all() else b"\10" + (x + 0.0).astype("<f8").tobytes()


def unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, "<i4" if v[0] == 4 else "<f8", offset=1).astype(float)


def matrix(values: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for row, v in zip(out, values):
        x = unpacked(v)
        row[: len(x)] = x
    return out


def intervals(up: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a query (its positive and its negative part) with a point of each box.

    Where doubles overflow, the interval is open at that end.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, _v = floor(scale * x), _width; only rows that take part."""
    ddl = "vec_id bigint, label bigint, _v binary, _width int"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(float) * scale)
                if np.isfinite(x).all():
                    rows.append((i, label, packed(x), len(x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    given = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding"))
    return given.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(run, ddl)


# -- the tree of one shard ----------------------------------------------------------------


def str_order(x: np.ndarray, leaf: int, axes: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: slabs of one axis, each tiled along the next."""
    order = np.arange(len(x))
    if len(x) <= leaf or not len(axes):
        return order
    order = np.argsort(x[:, axes[0]], kind="stable")
    slabs = int(np.ceil((len(x) / leaf) ** (1 / len(axes))))
    size = leaf * -(-len(x) // (leaf * slabs))
    return np.concatenate([order[lo : lo + size][str_order(x[order[lo : lo + size]], leaf, axes[1:])] for lo in range(0, len(x), size)])


class Tree:
    """Levels of boxes over packed vectors; level 0 are the leaves."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, ids: list[list[int]], leaf: int = LEAF, fan: int = FAN):
        with np.errstate(over="ignore", invalid="ignore"):
            axes = np.argsort(-x.var(0), kind="stable")[:3]
            norm = np.sqrt((x**2).sum(1))
        by_label = [np.flatnonzero(labels == label) for label in np.unique(labels)]
        order = np.concatenate([mine[str_order(x[mine], leaf, axes)] for mine in by_label])
        self.x, self.labels, self.ids = x[order], labels[order], [ids[i] for i in order]
        self.longest, self.largest = float(norm.max()), float(np.abs(self.x).max(initial=0))
        # A leaf ends where a label does; so most boxes know their only label.
        steps = np.concatenate([at + np.arange(0, len(mine), leaf) for at, mine in zip(np.cumsum([0, *map(len, by_label)]), by_label)])
        self.levels = []
        lo, hi, first, last = self.x, self.x, self.labels, self.labels
        while True:
            lo, hi = np.minimum.reduceat(lo, steps), np.maximum.reduceat(hi, steps)
            ends = np.append(steps[1:], len(first))
            first, last = np.minimum.reduceat(first, steps), np.maximum.reduceat(last, steps)
            self.levels.append((lo, hi, first, last, steps, ends))
            if len(lo) == 1:
                break
            steps = np.arange(0, len(lo), fan)

    def scores(self, q: np.ndarray, exact: list[int] | None, lo: int, hi: int) -> np.ndarray:
        """Integer scores of the vectors lo to hi; ``exact``: the query as integers if doubles may round."""
        if exact is None:
            return (self.x[lo:hi] @ q).astype(np.int64)
        sums = [sum(a * int(b) for a, b in zip(exact, row) if a) for row in self.x[lo:hi].tolist()]
        return np.array([min(max(s, LOW), HIGH) for s in sums], np.int64)

    def search(self, name: bytes, label: int, same: bool, low: list[int], high: list[int], floor: list[int], k: int) -> list[list[tuple]]:
        """Per window the k best (-score, id, own) among the rows of this label, or of all others."""
        q = np.zeros(self.x.shape[1])
        v = unpacked(name)
        q[: len(v)] = v
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            reach = float(np.abs(q).sum() * self.largest)
            rounds = not np.sqrt(q @ q) * self.longest < EXACT
        slack = 1e-9 * reach + 1e-3
        exact = [int(a) for a in q.tolist()] if rounds else None
        floor = [max(a, b) for a, b in zip(floor, low)]
        best: list[list[tuple]] = [[] for _ in low]
        top = reached(max(high))

        def low_end() -> float:
            return -np.inf if min(floor) <= LOW else float(min(floor))

        def admitted(level: int, lo: int, hi: int):
            box_lo, box_hi, first, last, _, _ = self.levels[level]
            least, most = intervals(up, down, box_lo[lo:hi], box_hi[lo:hi])
            right = (first[lo:hi] <= label) & (label <= last[lo:hi]) if same else (first[lo:hi] != label) | (last[lo:hi] != label)
            right &= (most + slack >= low_end()) & (least - slack <= top)
            return [(-most[i], level, lo + i) for i in np.flatnonzero(right).tolist()]

        queue = admitted(len(self.levels) - 1, 0, 1)
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound + slack < low_end():
                break
            _, _, _, _, begins, ends = self.levels[level]
            lo, hi = int(begins[node]), int(ends[node])
            if level:
                for child in admitted(level - 1, lo, hi):
                    heapq.heappush(queue, child)
                continue
            got = self.scores(q, exact, lo, hi)
            fits = (self.labels[lo:hi] == label) == same
            for w in range(len(low)):
                at = np.flatnonzero(fits & (got >= floor[w]) & (got <= high[w]))
                if len(at) > k:
                    at = at[got[at] >= np.partition(got[at], -k)[-k]]
                if len(at):
                    own = [same and not (self.x[lo + i] != q).any() for i in at.tolist()]
                    new = [(-int(got[i]), vec, mine) for i, mine in zip(at.tolist(), own) for vec in self.ids[lo + i]]
                    best[w] = sorted(best[w] + new)[:k]
                    if len(best[w]) == k:
                        floor[w] = max(floor[w], -best[w][-1][0])
        return best


# -- the top of the tree ------------------------------------------------------------------


class Tiles:
    """Boxes of the tiles, their sizes, and the cuts between them."""

    def __init__(self, entries: DataFrame, width: int, n: int, shard: int, most: int):
        self.width = width
        tiles = min(most, max(1, -(-n // shard)))
        self.slabs = int(np.ceil(np.sqrt(tiles)))
        self.per = -(-tiles // self.slabs)
        self.axes = self._widest(entries)
        first, second = self.axes
        ddl = "_x double, _y double"
        out = arrow(ddl)

        def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, first]), pa.array(x[:, second])], schema=out)

        def cuts(column: str, parts: int) -> Column:
            return F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000) if parts > 1 else F.array().cast("array<double>")

        xy = entries.select("_v").mapInArrow(two, ddl)
        self.first = np.array(xy.agg(cuts("_x", self.slabs)).first()[0], float)
        slab = F.size(F.filter(F.array(*[F.lit(float(c)) for c in self.first]), lambda c: c <= F.col("_x"))) if len(self.first) else F.lit(0)
        self.second = {r[0]: np.array(r[1], float) for r in xy.groupBy(slab.alias("_slab")).agg(cuts("_y", self.per)).collect()}

    def _widest(self, entries: DataFrame) -> tuple[int, int]:
        """The two coordinates of the largest variance, from sums of each task."""
        width = self.width
        ddl = "_at int, _n bigint, _mean double, _m2 double"
        out = arrow(ddl)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, mean, m2 = 0, np.zeros(width), np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    x = np.clip(matrix(batch.column(0).to_pylist(), width), -1e100, 1e100)  # only where to cut depends on it
                    m, gap = x.mean(0), x.mean(0) - mean
                    total = n + len(x)
                    m2 += ((x - m) ** 2).sum(0) + gap**2 * (n * len(x) / total)
                    mean += gap * (len(x) / total)
                    n = total
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(mean), pa.array(m2)], schema=out)

        parts = entries.select("_v").mapInArrow(sums, ddl)
        # The spread of the means around their mean, plus the spreads within.
        by_axis = parts.groupBy("_at").agg(
            F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_mean")).alias("s"), F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")).alias("ss"), F.sum("_m2").alias("m2"))
        spread = F.col("m2") + F.col("ss") - F.col("s") * F.col("s") / F.col("n")
        two = [r["_at"] for r in by_axis.orderBy(F.desc(spread), "_at").limit(2).collect()]
        return two[0], two[-1]

    def of(self, x: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.first, x[:, self.axes[0]], "right")
        inner = np.zeros(len(x), np.int64)
        for s in np.unique(slab):
            mine = slab == s
            inner[mine] = np.searchsorted(self.second.get(int(s), np.empty(0)), x[mine, self.axes[1]], "right")
        return slab * self.per + inner

    def measure(self, tiled: DataFrame, shard: int) -> None:
        """Boxes, label ranges and counts: one row a tile and coordinate."""
        width = self.width
        ddl = "_tile int, _n bigint, _first bigint, _last bigint, _box array<struct<lo: double, hi: double>>"
        out = arrow(ddl)

        def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, list] = {}
            for batch in batches:
                tile, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                x = matrix(batch.column(2).to_pylist(), width)
                for t in np.unique(tile).tolist():
                    mine = tile == t
                    new = [int(mine.sum()), int(labels[mine].min()), int(labels[mine].max()), x[mine].min(0), x[mine].max(0)]
                    old = met.get(t)
                    met[t] = new if old is None else [
                        old[0] + new[0], min(old[1], new[1]), max(old[2], new[2]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
            if met:
                rows = [(t, n, a, b, [{"lo": p, "hi": q} for p, q in zip(lo.tolist(), hi.tolist())]) for t, (n, a, b, lo, hi) in met.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        parts = tiled.select("_tile", "label", "_v").mapInArrow(boxes, ddl)
        whole = parts.groupBy("_tile").agg(F.sum("_n"), F.min("_first"), F.max("_last")).collect()
        sides = parts.select("_tile", F.posexplode("_box").alias("_at", "_side")).groupBy("_tile", "_at").agg(F.min("_side.lo"), F.max("_side.hi")).collect()
        self.names = np.array(sorted(r[0] for r in whole))
        row = {int(t): i for i, t in enumerate(self.names)}
        m = len(row)
        self.count, self.lo_label, self.hi_label = (np.zeros(m, np.int64) for _ in range(3))
        self.lo, self.hi = np.zeros((m, width)), np.zeros((m, width))
        for t, n, a, b in whole:
            self.count[row[t]], self.lo_label[row[t]], self.hi_label[row[t]] = n, a, b
        for t, at, lo, hi in sides:
            self.lo[row[t], at], self.hi[row[t], at] = lo, hi
        self.shards = -(-self.count // shard)
        self.base = np.cumsum(self.shards) - self.shards

    def choose(self, name: list[bytes], label: np.ndarray, same: bool, floor: np.ndarray, top: np.ndarray, first: bool) -> list[np.ndarray]:
        """Which tiles each query asks: the one with the highest bound, or in the second round the others that may hold better."""
        q = matrix(name, self.width)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least, most = intervals(up, down, self.lo, self.hi)
        with np.errstate(over="ignore"):
            reach = max(np.abs(self.lo).max(initial=0), np.abs(self.hi).max(initial=0)) * np.abs(q).sum(1)
        slack = (1e-9 * reach + 1e-3)[:, None]
        lo, hi = self.lo_label[None, :], self.hi_label[None, :]
        right = (lo <= label[:, None]) & (label[:, None] <= hi) if same else (lo != label[:, None]) | (hi != label[:, None])
        right = right & (least - slack <= top[:, None])
        ranked = np.where(right, most, -np.inf)
        lead = ranked.argmax(1)
        out = []
        for i in range(len(name)):
            if first:
                out.append(np.array([lead[i]])[right[i, lead[i]][None]])
            else:
                keep = right[i] & (most[i] + slack[i] >= floor[i])
                keep[lead[i]] = False
                out.append(np.flatnonzero(keep))
        return out


# -- searches over all shards -------------------------------------------------------------


def _ask_shards(asks: DataFrame, tiled: DataFrame, tiles: Tiles, same: bool, k: int, first: bool, block: int, store: Stored) -> DataFrame:
    """Hits of the queries in the tiles of one round."""
    spark = asks.sparkSession
    sent_ddl = ASK_DDL + ", _tile int"
    sent_out = arrow(sent_ddl)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                floor = np.array([-np.inf if min(x) <= LOW else min(x) for x in part.column(4).to_pylist()], float)
                top = np.array([reached(max(x)) for x in part.column(3).to_pylist()], float)
                chosen = tiles.choose(part.column(1).to_pylist(), part.column(0).to_numpy(zero_copy_only=False), same, floor, top, first)
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(c) for c in chosen]))
                if len(at):
                    where = tiles.names[np.concatenate(chosen)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns], pa.array(where)], schema=sent_out)

    sent = store.keep(asks.mapInArrow(choose, sent_ddl))
    asked = {r[0]: r[1] for r in sent.groupBy("_tile").count().collect()}
    rows = [(int(t), int(tiles.base[i]), int(tiles.shards[i]), -(-asked[int(t)] // block)) for i, t in enumerate(tiles.names) if int(t) in asked]
    dealt = F.broadcast(spark.createDataFrame(rows, "_tile int, _base int, _shards int, _copies int"))  # TILES rows at most
    none = F.lit(None).cast("array<bigint>")
    data = tiled.join(dealt, "_tile").select(
        (F.col("_base") + F.pmod(F.xxhash64("_v"), F.col("_shards")).cast("int")).alias("_shard"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), F.lit(0).alias("_kind"),
        "label", "_v", "_ids", none.alias("_lo"), none.alias("_hi"), none.alias("_floor"))
    queries = sent.join(dealt, "_tile").select(
        F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_shards") - 1)).alias("_shard"), F.pmod(F.xxhash64("label", "_v"), F.col("_copies")).cast("int").alias("_copy"), F.lit(1).alias("_kind"),
        "label", "_v", none.alias("_ids"), "_lo", "_hi", "_floor")
    both = data.unionByName(queries).repartition(max(partitions(spark), 1), "_shard", "_copy").sortWithinPartitions("_shard", "_copy", "_kind")
    hit_out = arrow(HIT_DDL)
    width = tiles.width

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree, found = None, [], None, []
        for batch in batches:
            for shard, copy, kind, label, v, ids, low, high, floor in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, copy) != place:
                    place, held, tree = (shard, copy), [], None
                if not kind:
                    held.append((label, v, ids))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = Tree(np.array([h[0] for h in held]), matrix([h[1] for h in held], width), [h[2] for h in held])
                    held = [()]
                for top, best in zip(high, tree.search(v, label, same, low, high, floor, k)):
                    found += [(label, v, top, -s, i, own) for s, i, own in best]
                if len(found) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), hit_out)], schema=hit_out)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), hit_out)], schema=hit_out)

    return both.mapInArrow(solve, HIT_DDL)


def _best(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("label", "_v", "_hi").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("_nth", nth).where(F.col("_nth") <= k)


def search(asks: DataFrame, tiled: DataFrame, tiles: Tiles, same: bool, k: int, block: int, store: Stored) -> DataFrame:
    """label, _v, _hi, _nth, score, vec_id, _own: the k best rows of each query and window (label, _v, _lo, _hi)."""
    asks = store.keep(asks.withColumn("_floor", F.col("_lo")))
    near = store.keep(_best(_ask_shards(asks, tiled, tiles, same, k, True, block, store), k).drop("_nth"))
    known = near.groupBy("label", "_v", "_hi").agg(F.count("*").alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k)
    known = known.groupBy("label", "_v").agg(F.map_from_entries(F.collect_list(F.struct("_hi", "_kth"))).alias("_known"))
    raised = F.zip_with("_hi", "_lo", lambda h, low: F.coalesce(F.try_element_at("_known", h), low))
    again = asks.join(known, ["label", "_v"], "left").select("label", "_v", "_lo", "_hi", raised.alias("_floor"))
    far = _ask_shards(store.keep(again), tiled, tiles, same, k, False, block, store)
    return store.keep(_best(near.unionByName(far), k))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = SCALE, shard: int = SHARD, tiles: int = TILES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding. Negatives satisfy low * positive_score <= 100 * negative_score <= high * positive_score,
    with 0 <= low <= high <= 100; below a positive score of zero there are none.
    """
    spark = vectors.sparkSession
    store = Stored(spark)
    ddl = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = store.keep(quantized(vectors, scale))
    want = max(positives + 1, negatives)
    nth = F.dense_rank().over(Window.partitionBy("label", "_v").orderBy("vec_id"))
    entries = store.keep(rows.withColumn("_nth", nth).where(F.col("_nth") <= want).groupBy("label", "_v").agg(F.sort_array(F.collect_set("vec_id")).alias("_ids")))
    n, width = entries.count(), rows.agg(F.max("_width")).first()[0]
    anchors = store.keep(rows.where(is_anchor).select("vec_id", "label", "_v").distinct())
    if not n or anchors.isEmpty():
        return spark.createDataFrame([], ddl)
    top = Tiles(entries, max(width, 1), n, shard, tiles)
    tiled_out_ddl = ENTRY_DDL + ", _tile int"
    tiled_out = arrow(tiled_out_ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tile = top.of(matrix(batch.column(1).to_pylist(), top.width)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], schema=tiled_out)

    tiled = store.keep(entries.select("label", "_v", "_ids").mapInArrow(place, tiled_out_ddl))
    top.measure(tiled, shard)

    every = F.array(F.lit(LOW).cast("bigint")).alias("_lo"), F.array(F.lit(HIGH).cast("bigint")).alias("_hi")
    same = search(anchors.select("label", "_v").distinct().select("label", "_v", *every), tiled, top, True, positives + 1, block, store)
    others = anchors.withColumnRenamed("vec_id", "anchor_id").join(same, ["label", "_v"]).where(~(F.col("_own") & (F.col("vec_id") == F.col("anchor_id"))))
    by_anchor = F.row_number().over(Window.partitionBy("anchor_id", "label", "_v").orderBy("_nth"))
    chosen = others.withColumn("_at", by_anchor).where(F.col("_at") <= positives)
    pairs = store.keep(chosen.select("anchor_id", "label", "_v", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # The window of a positive score p = 100 * a + r, without leaving 64 bits.
    p = F.col("positive_score")
    a, r = F.expr("positive_score div 100"), F.pmod(p, F.lit(100))
    least, most = low * a + F.ceil(low * r / 100).cast("bigint"), high * a + F.floor(high * r / 100).cast("bigint")
    # Windows of one upper end are asked once, from the lowest of their lower ends; the rest is cut off below.
    windows = pairs.where(p >= 0).groupBy("label", "_v", most.alias("_hi")).agg(F.min(least).alias("_lo"))
    asks = windows.groupBy("label", "_v").agg(F.sort_array(F.collect_list(F.struct("_hi", "_lo"))).alias("_w"))
    found = search(asks.select("label", "_v", F.col("_w._lo").alias("_lo"), F.col("_w._hi").alias("_hi")), tiled, top, False, negatives, block, store)
    found = found.select("label", "_v", "_hi", F.col("_nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    answers = pairs.where(p >= 0).withColumn("_lo", least).withColumn("_hi", most).join(found, ["label", "_v", "_hi"])
    return answers.where(F.col("negative_score") >= F.col("_lo")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
