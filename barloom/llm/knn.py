"""Exact top-k search by inner product: a Voronoi join.

With one more component, sqrt(M - |x|^2) for data (M the largest squared norm)
and 0 for queries, the largest inner products are the smallest distances.
Data and queries are grouped by their nearest pivot. From a summary of each data
cell (its smallest distances to the pivot) every query gets a bound on the
distance of its k-th neighbour, and by the triangle inequality a range of
distances to each pivot outside which no neighbour can lie. A vector is sent to a
block of queries only if it is in the range of one of them. Blocks are compared
with shards of what they were sent, so no task grows with the data, and the
results of the shards are merged.

Equal vectors are one vector with its k + 1 smallest ids: more cannot be among the
results. Scores are integers and exact, beyond 64 bits they stop at the ends of the range. Distances
are taken of vectors scaled down by a power of two, so that no finite vector overflows.

Cases: vectors that are null, or hold a null or non-finite component, take no
part, nor do null ids; shorter vectors count as padded with zeros; rows equal in
id and vector count once; a query does not find rows of its own id; ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import Stored, arrow
from barloom.llm.negatives import EXACT, HIGH, matrix, packed

SCALE = 256
PIVOTS = 128
BLOCK = 1024  # query vectors in a block
SHARD = 16_384  # vectors in a shard, about
SLACK = 1e-6  # relative, for the rounding of distances

VECTOR_DDL = "vec_id bigint, _v binary, _norm double, _width int"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, floor(scale * x), its norm and number of components; only vectors that take part."""
    out = arrow(VECTOR_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = v.values
                if values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(values.to_numpy(zero_copy_only=False).astype(float) * scale)
                if not np.isfinite(x).all():
                    continue
                most = float(np.abs(x).max(initial=0))
                rows.append((i, packed(x), most * float(np.sqrt(((x / most) ** 2).sum())) if most else 0.0, len(x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    given = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return given.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, VECTOR_DDL)


def products(ask: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all pairs, within the range of 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = ask @ have.T
        exact = np.outer(np.sqrt((ask**2).sum(1)), np.sqrt((have**2).sum(1))) < EXACT
        scores = np.where(exact, rough, 0).astype(np.int64)
    for i in np.flatnonzero(~exact.all(1)).tolist():  # doubles may round here
        q = [int(a) for a in ask[i].tolist()]
        for j in np.flatnonzero(~exact[i]).tolist():
            scores[i, j] = min(max(sum(a * int(b) for a, b in zip(q, have[j].tolist()) if a), -HIGH), HIGH)
    return scores


class Pivots:
    """Distances to the pivots in the space with one more component, of vectors scaled so that the largest norm is about 1."""

    def __init__(self, points: list[bytes], width: int, norm: float):
        self.width = width
        self.down = 2.0 ** -np.ceil(np.log2(norm)) if norm else 1.0
        self.top = (norm * self.down) ** 2
        self.points = self.scaled(points)
        self.more = np.sqrt(np.maximum(self.top - (self.points**2).sum(1), 0))

    def scaled(self, values: list[bytes]) -> np.ndarray:
        return matrix(values, self.width) * self.down

    def of_data(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (x @ self.points.T + np.outer(more, self.more)), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.top - 2 * q @ self.points.T, 0))


def top_inner(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, pivots: int = PIVOTS,
              block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with rows of another id."""
    store = Stored(vectors.sparkSession)
    ddl = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = store.keep(quantized(vectors, scale))
    nth = F.dense_rank().over(Window.partitionBy("_v").orderBy("vec_id"))
    distinct = store.keep(rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy("_v").agg(
        F.sort_array(F.collect_set("vec_id")).alias("_ids"), F.max("_norm").alias("_norm"), F.max("_width").alias("_width")))
    n, top, longest = distinct.agg(F.count("*"), F.max("_norm"), F.max("_width")).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], ddl)
    points = [bytes(r["_v"]) for r in distinct.select("_v").orderBy(F.xxhash64("_v"), "_v").limit(pivots).collect()]
    space = Pivots(points, max(longest, 1), top)
    width, m, want = space.width, len(points), k + 1

    # Summaries of the cells: the smallest distances to the pivot.
    near_ddl = "_cell int, _d double"
    near_out = arrow(near_ddl)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.of_data(space.scaled(batch.column(0).to_pylist()))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], schema=near_out)

    placed = distinct.select("_v").mapInArrow(nearest, near_ddl)
    by_cell = F.row_number().over(Window.partitionBy("_cell").orderBy("_d"))
    small = placed.withColumn("_nth", by_cell).where(F.col("_nth") <= want).select("_cell", "_d").collect()  # pivots * (k + 1) rows
    cells = np.array([r["_cell"] for r in small])
    inner = np.array([r["_d"] for r in small])

    # Queries: their bound, and the block of their cell.
    asked = rows.where(is_query).select("vec_id", "_v").distinct()
    points_asked = asked.select("_v").distinct()
    bound_ddl = "_v binary, _near int, _theta double"
    bound_out = arrow(bound_ddl)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.of_queries(space.scaled(batch.column(0).to_pylist()))
                far = d[:, cells] + inner
                theta = np.partition(far, want - 1, 1)[:, want - 1] if len(cells) >= want else np.full(len(d), np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(1).astype(np.int32)), pa.array(theta)], schema=bound_out)

    bounded = store.keep(points_asked.mapInArrow(bounds, bound_ddl))
    counts = {r["_near"]: r["count"] for r in bounded.groupBy("_near").count().collect()}
    # Small cells share a block, large ones are dealt over several.
    first, parts, blocks, room = np.zeros(m, np.int64), np.ones(m, np.int64), 0, 0
    for cell in sorted(counts):
        if counts[cell] > block:
            first[cell], parts[cell] = blocks + (room > 0), -(-counts[cell] // block)
            blocks, room = int(first[cell] + parts[cell]), 0
        else:
            if room + counts[cell] > block:
                blocks, room = blocks + 1, 0
            first[cell], room = blocks, room + counts[cell]
    blocks += room > 0
    by_cell_ddl = "_near int, _first int, _parts int"
    dealt = vectors.sparkSession.createDataFrame([(c, int(first[c]), int(parts[c])) for c in sorted(counts)], by_cell_ddl)
    queries = bounded.join(F.broadcast(dealt), "_near").select(
        "_v", "_theta", (F.col("_first") + F.pmod(F.xxhash64("_v"), F.col("_parts"))).cast("int").alias("_block"))

    # The range of distances to each pivot that a block needs.
    range_ddl = "_block int, _cell int, _lo double, _hi double"
    range_out = arrow(range_ddl)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = space.of_queries(space.scaled(batch.column(0).to_pylist()))
            theta, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order = np.argsort(at, kind="stable")
            begins = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
            lo = np.minimum.reduceat((d - theta[:, None])[order], begins)
            hi = np.maximum.reduceat((d + theta[:, None])[order], begins)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(at[order][begins], m).astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(begins))),
                pa.array(lo.ravel()), pa.array(hi.ravel())], schema=range_out)

    limits = queries.mapInArrow(ranges, range_ddl).groupBy("_block", "_cell").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).collect()
    lo, hi = np.full((blocks, m), np.inf), np.full((blocks, m), -np.inf)
    for r in limits:
        lo[r["_block"], r["_cell"]], hi[r["_block"], r["_cell"]] = r["_lo"], r["_hi"]
    slack = SLACK * (1 + np.sqrt(space.top))
    shards = max(1, -(-n // shard))

    sent_ddl = "_block int, _shard int, _v binary, _ids array<bigint>"
    sent_out = arrow(sent_ddl)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = space.of_data(space.scaled(batch.column(0).to_pylist()))
            cell = d.argmin(1)
            own = d[np.arange(len(d)), cell]
            deal = batch.column(2)
            for b in range(blocks):
                mine = np.flatnonzero((own >= lo[b, cell] - slack) & (own <= hi[b, cell] + slack))
                if len(mine):
                    at = pa.array(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), b, np.int32)), deal.take(at), batch.column(0).take(at), batch.column(1).take(at)],
                        schema=sent_out)

    number = F.pmod(F.xxhash64("_v"), F.lit(shards)).cast("int").alias("_shard")
    sent = distinct.select("_v", "_ids", number).mapInArrow(send, sent_ddl)
    copies = queries.select("_block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), "_v")
    found_ddl = "_v binary, vec_id bigint, score bigint"
    found_out = arrow(found_ddl)

    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        names, data = ask.column("_v").to_pylist(), have.column("_v").to_pylist()
        if not names or not data:
            return found_out.empty_table()
        ids = have.column("_ids").to_pylist()
        scores = products(matrix(names, width), matrix(data, width))
        k_rows = min(want, len(data))
        least = np.partition(scores, -k_rows, 1)[:, -k_rows]
        rows = []
        for q, (name, row) in enumerate(zip(names, scores)):
            hits = sorted((-int(row[j]), i) for j in np.flatnonzero(row >= least[q]) for i in ids[j])
            rows += [(name, i, -s) for s, i in hits[:want]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), found_out)], schema=found_out)

    local = copies.groupBy("_block", "_shard").cogroup(sent.groupBy("_block", "_shard")).applyInArrow(solve, found_ddl)
    best = F.row_number().over(Window.partitionBy("_v").orderBy(F.desc("score"), "vec_id"))
    merged = local.withColumn("_nth", best).where(F.col("_nth") <= want).groupBy("_v").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("_best"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "_v").join(merged, "_v")
    others = F.slice(F.filter("_best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    each = answers.select("query_id", F.posexplode(others).alias("_at", "_hit"))
    return each.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"), (-F.col("_hit.less")).alias("score"))
