"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Each document is described by statistics of its whole text (lengths, character
classes, repetition of words and word sequences). Random Fourier features of
the standardised statistics approximate a Gaussian kernel; the normal equations
of a ridge regression on them are summed by partition and solved on the driver,
where only matrices of the model's size arrive. A part of the labelled rows that
the regression has not seen calibrates its output: counts by score bin, then
pooled neighbours, so the score never falls where the regression rises.

At most ``fit_rows`` labelled rows are used, chosen by a hash of the id; beyond
that the model does not get better. All documents are scored. The labels' rows
with ``crc32(doc_id) % 3 = 1`` are held out and never read.

Cases: null and empty texts get the score of their statistics (all 0); labels
that are null or have no document are ignored, several labels of one document
count by their mean; without labels of both classes every score is the mean
label, or 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import Stored, arrow, id_key, public_id, texts
from barloom.llm.near import word_hashes
from barloom.llm.rolling import U64, flat, groups, mix

FIT_ROWS = 60_000
FEATURES = 512
RIDGE = 1e-4  # per row
BINS = 2048
LOWEST, HIGHEST = -0.5, 1.5  # range of the regression's output that is told apart

# -- statistics -------------------------------------------------------------------------

_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "bar", "symbol", "high", "control"]


def _class_table() -> np.ndarray:
    of = np.full(256, _CLASSES.index("symbol"), np.uint8)
    of[:32] = of[127] = _CLASSES.index("control")
    of[128:] = _CLASSES.index("high")
    for name, members in (
        ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
        ("space", " \t"), ("newline", "\r\n"), ("stop", ".!?"), ("comma", ",;:'\"()-"), ("bar", "|"),
    ):
        of[[ord(m) for m in members]] = _CLASSES.index(name)
    return of


_CLASS_OF = _class_table()
NAMES = ["bytes", "words", "word_length", "line_words", *[f"share_{c}" for c in _CLASSES],
         "distinct", "top", "distinct_pairs", "distinct_triples", "same_as_last", "word_variance", "stop_words"]


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most frequent one occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])]))
    runs, owner = np.diff(np.append(new, len(v))), t[new]
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text of a group."""
    n, size = len(at) - 1, np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * len(_CLASSES) + _CLASS_OF[data], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    words, where = word_hashes(data, at)
    count = np.diff(where).astype(float)
    text = np.repeat(np.arange(n), np.diff(where))
    full, one = np.maximum(count, 1), np.maximum(size, 1)
    blank = kinds[:, _CLASSES.index("space")] + kinds[:, _CLASSES.index("newline")]
    distinct, most = _distinct(words, text, n)
    columns = [np.log1p(size), np.log1p(count), (size - blank) / full, np.log1p(count / (1 + kinds[:, _CLASSES.index("newline")]))]
    columns += list((kinds / one[:, None]).T)
    columns += [distinct / full, most / full]
    for k in (2, 3):
        inside = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1]) if len(text) >= k else np.empty(0, np.int64)
        joined = words[inside]
        for j in range(1, k):
            joined = mix(joined) + words[inside + j]
        seen = np.bincount(text[inside], minlength=n)
        columns.append(np.where(seen > 0, _distinct(joined, text[inside], n)[0] / np.maximum(seen, 1), 1.0))
    same = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) if len(words) > 1 else np.empty(0, np.int64)
    columns.append(np.bincount(text[same], minlength=n) / full)
    # Spread of the word hashes' repetition, and stops per word.
    columns.append(np.log1p(most) / np.log1p(full))
    columns.append(kinds[:, _CLASSES.index("stop")] / full)
    return np.nan_to_num(np.stack(columns, 1))


def _described(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, at = flat(batch.column(column))
    for lo, hi in groups(at):
        yield lo, hi, statistics(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


# -- the model --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]  # regression output, calibrated score

    def features(self, x: np.ndarray) -> np.ndarray:
        """Constant, linear and random Fourier features."""
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / max(1, len(self.phases)))
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the regression's own order stays within a step."""
        raw = np.clip(self.raw(x), LOWEST, HIGHEST)
        flat_part = np.interp(raw, *self.knots)
        return np.clip(0.999 * flat_part + 0.001 * (raw - LOWEST) / (HIGHEST - LOWEST), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def pool(count: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic fit of good / count in the order given: neighbours that fall are pooled."""
    blocks: list[list[float]] = []  # good, count, bins
    for g, c in zip(good.tolist(), count.tolist()):
        blocks.append([g, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, c, b = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += c
            blocks[-1][2] += b
    return np.concatenate([np.full(int(b), (g + 0.5 * (g > 0)) / (c + 0.5) if c else 0.5) for g, c, b in blocks]) if blocks else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Learn from the labels that are not held out."""
    spark, width = docs.sparkSession, len(NAMES)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.avg("quality").alias("_y"))
    rows = known.count()
    share = min(1.0, fit_rows / max(rows, 1))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's size is bounded by fit_rows, so it may be broadcast.
    chosen = texts(docs).join(F.broadcast(known), "_id").select("_id", "_y", "_text")
    ddl = "_id bigint, _y double, _x array<double>"
    out = arrow(ddl)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _described(batch, 2):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(x), out.field(2).type)], schema=out)

    table = Stored(spark).keep(chosen.mapInArrow(describe, ddl))
    moments = table.agg(
        F.count("*"), F.avg("_y"), *[f(F.col("_x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    n, rate = moments[0], moments[1]
    rng = np.random.default_rng(seed)
    mean = np.array([moments[2 + 2 * i] or 0.0 for i in range(width)])
    spread = np.array([moments[3 + 2 * i] or 0.0 for i in range(width)])
    spread[spread < 1e-9] = 1.0
    directions = rng.normal(size=(width, features)) / np.sqrt(width)
    phases = rng.uniform(0, 2 * np.pi, features)
    plain = Model(mean, spread, directions, phases, np.zeros(1 + width + features), (np.array([LOWEST, HIGHEST]), np.full(2, 0.5)))
    if not n or rate in (0.0, 1.0):
        constant = np.zeros(1 + width + features)
        constant[0] = 0.5
        return Model(mean, spread, directions, phases, constant, (np.array([LOWEST, HIGHEST]), np.full(2, 0.5 if not n else rate)))
    spare = F.pmod(F.xxhash64("_id", F.lit("spare")), F.lit(4)) == 0  # calibrates
    size = 1 + width + features
    sums_ddl = "_i int, _g array<double>"
    sums_out = arrow(sums_ddl)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = plain.features(x)
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), sums_out.field(1).type)], schema=sums_out)

    def add(part: pa.Table) -> pa.Table:
        g = np.stack([np.asarray(v) for v in part.column(1).combine_chunks().to_numpy(zero_copy_only=False)]).sum(0)
        return pa.Table.from_arrays([part.column(0)[:1], pa.array([g], sums_out.field(1).type)], schema=sums_out)

    parts = table.where(~spare).select("_y", "_x").coalesce(16).mapInArrow(equations, sums_ddl)
    rows = sorted(parts.groupBy("_i").applyInArrow(add, sums_ddl).collect())
    total = np.array([r["_g"] for r in rows])
    pull = np.eye(size) * ridge * max(total[0, 0], 1)
    pull[0, 0] = 0
    weights = np.linalg.solve(total[:, :-1] + pull + 1e-9 * np.eye(size), total[:, -1])
    ready = Model(mean, spread, directions, phases, weights, plain.knots)
    bins_ddl = "_bin int, _y double"
    bins_out = arrow(bins_ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            raw = np.clip(ready.raw(x), LOWEST, HIGHEST)
            at = np.minimum(((raw - LOWEST) / (HIGHEST - LOWEST) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], schema=bins_out)

    counted = table.where(spare).select("_y", "_x").mapInArrow(place, bins_ddl).groupBy("_bin").agg(F.count("*").alias("n"), F.sum("_y").alias("good"))
    bins = sorted(counted.collect())  # at most BINS rows
    if not bins:
        return Model(mean, spread, directions, phases, weights, (np.array([LOWEST, HIGHEST]), np.array([0.0, 1.0])))
    middle = LOWEST + (np.array([b["_bin"] for b in bins]) + 0.5) * (HIGHEST - LOWEST) / BINS
    level = pool(np.array([b["n"] for b in bins], float), np.array([b["good"] for b in bins], float))
    return Model(mean, spread, directions, phases, weights, (middle, level))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and the columns named in ``keep`` as they are."""
    keep = keep or []
    # The text goes to the tasks once, whether it is kept or not; a null one counts as empty there.
    fields = {c: "_text" if c == "text" else f"_keep{i}" for i, c in enumerate(keep)}
    rows = docs.select(
        id_key().alias("_id"), F.col("text").alias("_text"), held_out(F.col("doc_id")).alias("held_out"),
        *[F.col(f"`{c}`").alias(a) for c, a in fields.items() if c != "text"])
    kept = rows.select(*fields.values()).schema
    schema = kept.add("_id", "long").add("held_out", "boolean").add("score", "double")
    names = [*fields.values(), "_id", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            for lo, hi, x in _described(batch, where["_text"]):
                part = [batch.column(where[n]).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays([*part, pa.array(model.score(x))], names=[*names, "score"])

    done = rows.mapInArrow(run, schema)
    return done.select(
        public_id().alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *[F.col(a).alias(f"kept_{c}") for c, a in fields.items()])


def quality_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return score(docs, fit(docs, labels, **settings))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, **settings)
    columns = docs.columns
    done = score(docs, model, keep=columns).where("predicted = 1")
    return done.select(*[F.col(f"`kept_{c}`").alias(c) for c in columns])
