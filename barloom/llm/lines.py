"""Near-equal lines across documents: a segment-partition edit join.

Lines are compared without surrounding white space, by edit distance over their
UTF-8 bytes: one edit per ``PER_EDIT`` bytes of the shorter line, ``EDITS`` at most,
so that shorter lines than that meet only their exact copies. A line of length l
that may have k edits is split into k + 1 segments; a line within k edits of it,
and not shorter, must contain one of the segments unchanged, nearly at its place. Each line is indexed by (l, segment number, segment) and probes the
indexes of its own and slightly smaller lengths with the few substrings whose
places are possible. What meets is verified by banded bit-parallel edit distance.

Segments and substrings are only their hashes, taken from one prefix sum per
batch. Lines that meet nothing leave after the one shuffle of the keys. Of those that
do, each is first compared with one line of its key; then, where a key still
holds several components, lines of different ones whose byte parities allow the
distance. So a key shared by very many alike lines costs one comparison each.

Equal lines are one line throughout. Every line that is not blank takes part
(``MIN_BYTES`` of 1).

Cases: null and empty texts have one blank line, which takes no part; the first
line of a class, by (doc_id, text hash, line number), is the one that stays; a
null id comes before all others; rows equal in id and text count as one document
and each gets its result; a text no line of which is removed stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import Stored, arrow, documents, for_each_row, public_id, rebuilt
from barloom.llm.components import components
from barloom.llm.rolling import U64, flat, groups, mix, shared

EDITS = 2
PER_EDIT = 10
MIN_BYTES = 1

_FIRST, _SECOND = shared(71), shared(72)
_BITS = U64(1) << (np.random.default_rng(73).permutation(256) % 64).astype(U64)
_PAIR_BITS = U64(1) << np.random.default_rng(74).integers(0, 64, 1 << 16).astype(U64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

# -- lines ------------------------------------------------------------------------------


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of a group of texts: its text, its number in it, and where it starts and ends without white space around it."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    last = np.append(text[1:] != text[:-1], True)
    ends = np.where(last, at[text + 1], np.append(starts[1:], 0) - 1)
    solid = np.flatnonzero(~_BLANK[data]) if len(data) else np.empty(0, np.int64)
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    first = np.where(full, solid[np.minimum(lo, max(len(solid) - 1, 0))] if len(solid) else 0, starts)
    end = np.where(full, (solid[np.maximum(hi - 1, 0)] if len(solid) else 0) + 1, starts)
    return text, number, first, end


LINE_DDL = "_id bigint, _h bigint, _no int, _line bigint, _line2 bigint, _parity bigint, _pairs bigint"


def lines(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Every line that takes part: 128 bits of hash, and which bytes and which pairs of bytes occur an odd number of times (in 64 classes)."""
    out = arrow(LINE_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, at = flat(batch.column(2))
            for lo, hi in groups(at):
                body, where = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                text, number, s, e = split(body, where)
                long = np.flatnonzero(e - s >= max(1, min_bytes))
                if not len(long):
                    continue
                text, number, s, e = (x[long] for x in (text, number, s, e))
                hashes = [h.of(h.prefix(body), s, e).view(np.int64) for h in (_FIRST, _SECOND)]
                parity = np.bitwise_xor.reduceat(np.append(_BITS[body], U64(0)), np.stack([s, e], 1).ravel())[::2]
                twos = _PAIR_BITS[body[:-1].astype(np.int64) * 256 + body[1:]]
                pairs = np.bitwise_xor.reduceat(np.append(twos, U64(0)), np.stack([s, e - 1], 1).ravel())[::2]
                pairs[e - s < 2] = 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi][text]), pa.array(tags[lo:hi][text]), pa.array(number.astype(np.int32)),
                    *map(pa.array, hashes), pa.array(parity.view(np.int64)), pa.array(pairs.view(np.int64)),
                ], schema=out)

    return rows.select("_id", "_h", "_text").mapInArrow(run, LINE_DDL)


# -- signatures -------------------------------------------------------------------------


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of the given lengths; the last ones are longer by one."""
    base, longer = length // parts, length % parts
    short = parts - longer
    return i * base + np.maximum(i - short, 0), base + (i >= short)


def allowed(length: np.ndarray, edits: int) -> np.ndarray:
    """Edits between a line of each length and one that is not shorter."""
    return np.minimum(length // PER_EDIT, edits)


def keys(sums: np.ndarray, s: np.ndarray, e: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(lines, keys, whether they are index entries), for lines [s, e) of a hashed group.

    An index entry is the line's own segment in its place, which is also one of its probes.
    """
    size = e - s
    for less in range(edits + 1):
        target = size - less  # length of the lines looked for
        most = allowed(target, edits)
        for i in range(edits + 1):
            place, width = segment(target, i, np.maximum(most, 0) + 1)
            low = np.maximum(place - i, place + less - (most - i))
            high = np.minimum(place + i, place + less + (most - i))
            fits = (most > 0) & (most >= max(less, i))
            for shift in range(-edits, 2 * edits + 1):
                at = place + shift
                ok = np.flatnonzero(fits & (at >= low) & (at <= high) & (at >= 0) & (at + width <= size) & (width > 0))
                if len(ok):
                    made = _FIRST.of(sums, s[ok] + at[ok], s[ok] + at[ok] + width[ok])
                    yield ok, mix(made + target[ok].astype(U64) * U64(edits + 1) + U64(i)), less == 0 and shift == 0


def signatures(rows: DataFrame, edits: int, min_bytes: int) -> DataFrame:
    """(_key, _line, _own): each line of a batch once."""
    ddl = "_key bigint, _line bigint, _own boolean"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(0))
            seen = np.empty(0, U64)  # lines of this batch
            for lo, hi in groups(at):
                body = data[at[lo] : at[hi]]
                _, _, s, e = split(body, at[lo : hi + 1] - at[lo])
                long = np.flatnonzero(e - s >= max(1, min_bytes))
                if not len(long):
                    continue
                s, e = s[long], e[long]
                sums = _FIRST.prefix(body)
                name, first = np.unique(_FIRST.of(sums, s, e), return_index=True)
                new = ~np.isin(name, seen)
                name, first = name[new], first[new]
                seen = np.concatenate([seen, name])
                s, e = s[first], e[first]
                for some, key, own in keys(sums, s, e, edits):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.view(np.int64)), pa.array(name[some].view(np.int64)), pa.array(np.full(len(some), own)),
                    ], schema=out)

    return rows.select("_text").mapInArrow(run, ddl)


def _meetings(signed: DataFrame) -> DataFrame:
    """The signatures of keys that some line indexes and another one has as well; each (key, line) once."""
    per_key = Window.partitionBy("_key")
    ordered = per_key.orderBy("_line", F.desc("_own"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = signed.select(
        "*", F.first("_line").over(whole).alias("_lo"), F.last("_line").over(whole).alias("_hi"),
        F.max("_own").over(whole).alias("_any"), F.lag("_line").over(ordered).alias("_before"))
    return seen.where("_lo <> _hi and _any and (_before is null or _before <> _line)").select("_key", "_line", "_own")


# -- verification -----------------------------------------------------------------------


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``, by a bit-parallel band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    lead = next((i for i in range(0, n, 64) if a[i : i + 64] != b[i : i + 64]), n)
    while lead < n and a[lead] == b[lead]:
        lead += 1
    a, b, n = a[lead:], b[lead:], n - lead
    tail = 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    m, width = len(a), 2 * edits + 1
    mask = (1 << width) - 1
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # Bit r of a vector is row j - edits + r of column j: the band moves down with the columns.
    plus, minus, score = mask & ~((1 << edits) - 1), 0, edits
    for j, c in enumerate(b):
        here = places.get(c, 0)
        here = (here >> j - edits if j >= edits else here << edits - j) & mask
        diagonal = (((here & plus) + plus) ^ plus) | here | minus
        right_up = minus | mask & ~(diagonal | plus)
        right_down = diagonal & plus
        if j + edits < m:  # along the lowest diagonal
            score += not diagonal >> width - 1 & 1
        else:  # along the last row
            row = m - 1 - j + edits
            score += (right_up >> row & 1) - (right_down >> row & 1)
        diagonal = (diagonal & mask) >> 1
        plus = right_down | mask & ~(diagonal | right_up)
        minus = diagonal & right_up
    if m <= edits:  # the band starts below the last row: its cells say nothing there
        return _plain(a, b) <= edits
    return score <= edits


def _plain(a: bytes, b: bytes) -> int:
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            last, row[i] = row[i], min(last + (c != d), row[i] + 1, row[i - 1] + 1)
    return row[-1]


def _verify(pairs: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    ddl = "_a bigint, _b bigint"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            hits = [(x, y) for x, y, s, t in zip(a, b, ta, tb) if within(s, t, min(edits, len(s) // PER_EDIT, len(t) // PER_EDIT))]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], schema=out)

    left = bodies.select(F.col("_line").alias("_a"), F.col("_body").alias("_ta"))
    right = bodies.select(F.col("_line").alias("_b"), F.col("_body").alias("_tb"))
    return pairs.join(left, "_a").join(right, "_b").select("_a", "_b", "_ta", "_tb").mapInArrow(run, ddl)


def _bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the lines ``wanted`` (_line, _first), cut from their first document."""
    lists = wanted.groupBy("_first._id", "_first._h").agg(F.collect_list(F.struct("_line", "_first._no")).alias("_wanted"))
    ddl = "_line bigint, _body binary"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, wants in zip(batch.column(0), batch.column(1)):
                found = text.as_py().encode().split(b"\n")
                got += [(w["_line"], found[w["_no"]].strip(b"\t\n\x0b\x0c\r ")) for w in wants.as_py()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), out)], schema=out)

    return rows.join(lists, ["_id", "_h"]).select("_text", "_wanted").mapInArrow(run, ddl)


# -- the operator -----------------------------------------------------------------------


def _classes(rows: DataFrame, edits: int, min_bytes: int, store: Stored) -> DataFrame:
    """Every line that takes part with the first line of its class: _id, _h, _no, _first (struct of the same)."""
    every = store.keep(lines(rows, min_bytes))
    place = F.struct("_id", "_h", "_no")
    distinct = store.keep(every.groupBy("_line").agg(F.min(place).alias("_first"), F.any_value("_parity").alias("_parity"), F.any_value("_pairs").alias("_pairs")))
    met = store.keep(_meetings(signatures(rows, edits, min_bytes)).join(distinct.select("_line", "_parity", "_pairs"), "_line"))
    bodies = store.keep(_bodies(rows, distinct.select("_line", "_first").join(met.select("_line").distinct(), "_line")))
    # An edit changes the parity of at most two bytes and of at most four pairs of bytes.
    near = (F.bit_count(F.col("_pa").bitwiseXOR(F.col("_pb"))) <= 2 * edits) & (F.bit_count(F.col("_qa").bitwiseXOR(F.col("_qb"))) <= 4 * edits)
    side = lambda x: [F.col("_line").alias(f"_{x}"), F.col("_parity").alias(f"_p{x}"), F.col("_pairs").alias(f"_q{x}")]
    left = met.where("_own").select("_key", *side("a"))
    right = met.select("_key", *side("b"))
    hubs = left.groupBy("_key").agg(F.min(F.struct("_a", "_pa", "_qa")).alias("_hub")).select("_key", "_hub.*")
    pair = [F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")]
    stars = store.keep(hubs.join(right, "_key").where((F.col("_a") != F.col("_b")) & near).select(*pair).distinct())
    links = store.keep(_verify(stars, bodies, edits))
    found = components(links, store)
    part = lambda line: F.coalesce("_component", line)
    named = met.join(found, F.col("_line") == F.col("_node"), "left").select("_key", "_line", "_own", "_parity", "_pairs", part("_line").alias("_c"))
    named = store.keep(named)
    mixed = named.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi").select("_key")
    left = named.where("_own").join(mixed, "_key").select("_key", *side("a"), F.col("_c").alias("_ca"))
    right = named.select("_key", *side("b"), F.col("_c").alias("_cb"))
    cross = left.join(right, "_key").where((F.col("_ca") != F.col("_cb")) & near).select(*pair).distinct()
    cross = store.keep(cross.join(stars, ["_a", "_b"], "left_anti"))
    more = store.keep(_verify(cross, bodies, edits))
    if not more.isEmpty():
        found = components(links.unionByName(more), store)
    classed = distinct.join(found, F.col("_line") == F.col("_node"), "left").select("_line", "_first", part("_line").alias("_c"))
    first = classed.groupBy("_c").agg(F.min("_first").alias("_class"))
    classed = classed.join(first, "_c").select("_line", "_class")
    return every.select("_id", "_h", "_no", "_line").join(classed, "_line").select("_id", "_h", "_no", F.col("_class").alias("_first"))


def _removals(rows: DataFrame, edits: int, min_bytes: int) -> DataFrame:
    """(_id, _h, _gone): the lines of a document whose class has an earlier line."""
    found = _classes(rows, edits, min_bytes, Stored(rows.sparkSession))
    later = found.where(F.struct("_id", "_h", "_no") != F.col("_first"))
    entry = F.struct(
        F.col("_no").cast("bigint").alias("line"), public_id("_first._id").alias("class_doc"), F.col("_first._no").cast("bigint").alias("class_line"))
    return later.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(entry)).alias("_gone"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed and, for each line to remove, its number and the first line of its class."""
    rows = documents(docs)
    counted = rows.select("_id", "_h", (F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"))
    gone = _removals(rows, edits, min_bytes)
    done = counted.join(gone, ["_id", "_h"], "left")
    empty = F.array().cast("array<struct<line:bigint,class_doc:bigint,class_line:bigint>>")
    done = done.select(public_id().alias("doc_id"), "_h", "n_lines", F.coalesce("_gone", empty).alias("removed"))
    return for_each_row(done.withColumn("n_removed", F.size("removed").cast("bigint")), docs).select("doc_id", "n_lines", "n_removed", "removed")


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents, all columns, without their repeated lines; equal (id, text) rows come once."""
    rows = documents(docs, keep=True)
    gone = _removals(rows, edits, min_bytes).select("_id", "_h", F.transform("_gone", lambda g: g["line"].cast("int")).alias("_gone"))
    kept = F.filter(F.transform(F.split("_text", "\n"), lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return rebuilt(rows.join(gone, ["_id", "_h"], "left").withColumn("_text", text), docs)
