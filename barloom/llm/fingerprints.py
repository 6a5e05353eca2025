"""Document fingerprints: threshold-scaled sketches of byte shingles.

A fingerprint holds every distinct shingle hash below ``2^64 / scale``. The
threshold is the same for all texts, so fingerprints of parts merge by union,
and the overlap of two of them estimates the containment of a short text in a
very long one as well as the likeness of two equals.

Cases: a null text is empty; an empty text has the empty fingerprint; a text
shorter than a shingle is one shingle; a non-empty text none of whose hashes is
below the threshold keeps its smallest one, so that only the empty text has
none. Repeated rows get the same fingerprint each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow, partitions, public_id, texts
from barloom.llm.rolling import GROUP, U64, groups, shared

WIDTH = 16  # bytes in a shingle
SCALE = 16  # one in so many hashes is retained

_HASH = shared(6)


def sketches(values: list[bytes], width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted distinct retained hashes of each text."""
    limit = U64((1 << 64) // scale - 1)
    ends = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=ends[1:])
    out: list[np.ndarray] = []
    for lo, hi in groups(ends):
        at = ends[lo : hi + 1] - ends[lo]
        sums = _HASH.prefix(np.frombuffer(b"".join(values[lo:hi]), np.uint8))
        seen = _HASH.windows(sums, width)
        kept = np.flatnonzero(seen <= limit)
        cut = np.searchsorted(kept, at)
        last = np.searchsorted(kept, np.maximum(at[1:] - width + 1, at[:-1]))
        for j in range(hi - lo):
            mine = seen[kept[cut[j] : last[j]]]
            if not len(mine) and at[j + 1] > at[j]:
                if at[j + 1] - at[j] < width:
                    mine = _HASH.of(sums, at[j : j + 1], at[j + 1 : j + 2])
                else:
                    mine = seen[at[j] : at[j + 1] - width + 1].min(keepdims=True)
            out.append(np.unique(mine))
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(U64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of both; equal fingerprints give 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has, however long ``b`` is."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(*parts: np.ndarray) -> np.ndarray:
    """The fingerprint of the parts together."""
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, U64)


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document; no shuffle."""
    out = arrow("_id bigint, n_chars bigint, fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            made = sketches([t.encode() for t in found], width, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in found], pa.int64()), pa.array([to_text(s) for s in made])], schema=out
            )

    done = texts(docs).mapInArrow(run, "_id bigint, n_chars bigint, fingerprint string")
    return done.select(public_id().alias("doc_id"), "n_chars", "fingerprint")


# -- a document and the one after it -------------------------------------------------


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (_id, _text, _b, _x) such that the text after a document is the next row of its partition.

    Order is (id, text). The documents are dealt over ranges of ids; the first
    document of a range goes to the range before as well (_x = 1), that of the
    first range to the last. One shuffle of the texts; what is collected is one
    id for each range.
    """
    rows, n = texts(docs), partitions(docs.sparkSession)
    cuts = sorted({float(c) for c in rows.approxQuantile("_id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    if cuts:
        ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_d", outputCol="_r")
        rows = ranged.transform(rows.withColumn("_d", F.col("_id").cast("double"))).select("_id", "_text", F.col("_r").cast("int").alias("_b"))
    else:
        rows = rows.withColumn("_b", F.lit(0))
    heads = [(r["_b"], r["_head"]) for r in rows.groupBy("_b").agg(F.min("_id").alias("_head")).orderBy("_b").collect()]
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    moved = docs.sparkSession.createDataFrame(before, "_id bigint, _to int")
    extra = rows.join(F.broadcast(moved), "_id").select("_id", "_text", F.col("_to").alias("_b"), F.lit(1).alias("_x"))
    both = rows.withColumn("_x", F.lit(0)).unionByName(extra)
    return both.repartitionByRange(max(n, 1), "_b").sortWithinPartitions("_b", "_x", "_id", "_text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


NEXT_DDL = (
    "_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they and the next document are.

    A single document is its own next one.
    """
    out = arrow(NEXT_DDL)

    def results(pairs: list[tuple[int, str, str]], follow: str) -> pa.RecordBatch:
        """pairs: (id, text, next text), where each next text is that of the pair after it; the last is ``follow``."""
        changed = [edited(t, nxt).encode() for _, t, nxt in pairs]
        own = sketches([t.encode() for _, t, _ in pairs] + [follow.encode()], width, scale)
        new = sketches(changed, width, scale)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _, _ in pairs], pa.int64()),
            pa.array([len(t) for _, t, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array([to_text(s) for s in own[:-1]], pa.string()),
            pa.array([to_text(s) for s in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own[:-1], new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:])], pa.float64()),
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a document whose next one has not come yet
        closed = None  # a range whose first extra row has come
        pairs: list[tuple[int, str, str]] = []
        size = 0
        for batch in batches:
            for i, text, b, x in zip(*(c.to_pylist() for c in batch.columns)):
                if x and closed == b:
                    continue  # a tie of the extra row
                if held is not None:
                    pairs.append((*held, text))
                    size += len(held[1])
                if x:
                    closed, held = b, None
                    if pairs:
                        yield results(pairs, text)
                    pairs, size = [], 0
                    continue
                held = (i, text)
                if size >= GROUP:
                    yield results(pairs, text)
                    pairs, size = [], 0

    done = beside_next(docs).mapInArrow(run, NEXT_DDL)
    return done.select(public_id().alias("doc_id"), *done.columns[1:])
