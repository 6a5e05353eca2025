"""Removal of repeated byte strings by prefix-free parsing.

A document is parsed at triggers: positions whose rolling hash of ``TRIGGER``
bytes is the leftmost smallest among the triggers of some ``length``-byte string.
All strings with the same trigger start in one stretch, and the stretch together
with the last of these strings is a phrase. Phrases overlap by length - 1 bytes,
so every string of that length lies inside one phrase, and where it occurs again
its trigger is the same one: equal strings only meet in phrases of equal trigger.

* Parse: the phrase occurrences (document, start). The dictionary: the distinct
  phrases. A phrase that occurs again repeats all its strings there.
* Only the first occurrences of phrases whose trigger also has another phrase
  are left to compare. The suffixes of that part of the dictionary are put in
  order by prefix doubling, with numpy, in tasks that each hold whole triggers;
  suffixes equal in the first ``length`` bytes are neighbours in this order, and
  all but the one at the earliest place of the parse are repeats. Longer
  comparisons cannot change the result, so the order stops at that length.
* A trigger with very many phrases is dealt over several tasks. Each of them
  passes on one occurrence of each of its strings, and these are compared by
  their 128-bit hashes.

Copies are dropped from the parse before the shuffle, by batch. Phrases are
compared by 128 bits of hash (trigger and whole phrase).

Cases: a null text is empty; a text below ``length`` bytes loses nothing; rows
with the same id and text count as one document, and each of them gets its
result; rows with the same id and different texts are ordered by a text hash, a
null id is before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import Stored, arrow, documents, for_each_row, public_id, rebuilt, struct
from barloom.llm.rolling import U64, flat, groups, mix, shared, sliding_first_minimum

LENGTH = 100
TRIGGER = 20
MANY = 4096  # phrases of one trigger that one task compares
CHUNK = 1 << 20  # dictionary bytes put in order at a time

_TRIGGERS, _PHRASES = shared(51), shared(52)

# _key trigger hash, _phrase phrase hash, _start in the document, _lead bytes before the
# trigger, _n strings of the stretch. _done: a copy already known to be one.
PARSE_DDL = "_key bigint, _phrase bigint, _id bigint, _h bigint, _start int, _lead int, _n int, _done boolean"


def parse(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Phrase occurrences of documents (_id, _h, _text)."""
    out = arrow(PARSE_DDL)

    def rows(ids: np.ndarray, tags: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
        sums = _TRIGGERS.prefix(data)
        hashes = _TRIGGERS.windows(sums, TRIGGER)
        where = sliding_first_minimum(hashes, length - TRIGGER + 1)
        room = at[1:] - at[:-1] - length + 1  # strings of a document
        doc = np.repeat(np.arange(len(room)), np.maximum(room, 0))
        if not len(doc):
            return None
        first = np.cumsum(np.maximum(room, 0)) - np.maximum(room, 0)
        start = np.arange(len(doc)) - first[doc] + at[doc]
        trigger = where[start]
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(new, len(doc)))
        s, t, d = start[new], trigger[new], doc[new]
        sums2 = _PHRASES.prefix(data)
        phrase = mix(_PHRASES.of(sums2, s, s + n + length - 1) + (t - s).astype(U64))
        key = hashes[t]
        # The first occurrence within the batch stands for the others.
        order = np.lexsort((s - at[d], tags[d], ids[d], phrase, key))
        again = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])])
        done = np.empty(len(order), bool)
        done[order] = again
        # Neighbouring copies become one stretch, sent anywhere.
        joins = np.flatnonzero(np.concatenate([[True], ~(done[1:] & done[:-1] & (d[1:] == d[:-1]))]))
        n = np.add.reduceat(n, joins)
        s, t, d, key, phrase, done = (x[joins] for x in (s, t, d, key, phrase, done))
        key = np.where(done, mix(ids[d].astype(U64) + s.astype(U64)), key)
        return pa.RecordBatch.from_arrays([
            pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(ids[d]), pa.array(tags[d]),
            pa.array((s - at[d]).astype(np.int32)), pa.array((t - s).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(done),
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, at = flat(batch.column(2))
            for lo, hi in groups(at):
                made = rows(ids[lo:hi], tags[lo:hi], data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if made is not None:
                    yield made

    return docs.select("_id", "_h", "_text").mapInArrow(run, PARSE_DDL)


def _sorted_out(phrases: DataFrame) -> DataFrame:
    """Of all phrase occurrences: stretches known to be copies, and phrases to compare (_open)."""
    place = ["_id", "_h", "_start"]
    same_key = Window.partitionBy("_key")
    by_phrase = same_key.orderBy("_phrase", *place)
    whole = by_phrase.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = phrases.select(
        "*", F.count("*").over(whole).alias("_all"), F.first("_phrase").over(whole).alias("_p0"), F.last("_phrase").over(whole).alias("_p1"),
        F.lag("_phrase").over(by_phrase).alias("_before"),
    ).where(F.col("_done") | (F.col("_all") > 1))
    copy = F.col("_done") | F.coalesce(F.col("_before") == F.col("_phrase"), F.lit(False))
    seen = seen.withColumn("_open", ~copy).where(copy | (F.col("_p0") != F.col("_p1")))
    parts = F.ceil(F.col("_all") / MANY).cast("int")
    salt = F.when(parts > 1, F.pmod(F.xxhash64(*place), parts)).otherwise(0).cast("int")
    return seen.select("_key", *place, "_lead", "_n", "_open", salt.alias("_salt"), (parts > 1).alias("_many"))


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` among each other, by their first ``length`` bytes.

    Prefix doubling: ranks by 8 bytes, by pairs of those 16, and so on; the last
    step overlaps to end at the wanted length.
    """
    if length < 8:
        columns = [data[starts + i] for i in range(length)]
        return np.unique(np.stack(columns, 1), axis=0, return_inverse=True)[1].ravel()
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    rank = np.unique(np.ascontiguousarray(words).view(">u8").ravel(), return_inverse=True)[1].astype(U64)
    done = 8
    while done * 2 <= length:
        rank = _paired(rank, done)
        done *= 2
    if done < length:
        rank = _paired(rank, length - done)
    return rank[starts]


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    later = np.zeros_like(rank)
    if step < len(rank):
        later[:-step] = rank[step:]
    return np.unique(rank << U64(32) | later, return_inverse=True)[1].astype(U64)


# Stretches of strings to remove; a row with _w1 is a string still to be compared with other tasks.
FOUND_DDL = "_id bigint, _h bigint, _start int, _n int, _w1 bigint, _w2 bigint"


def _compare(slices: DataFrame, length: int) -> DataFrame:
    """Order the suffixes of phrases (sorted by _key, _salt) and find the repeated ones."""
    out = arrow(FOUND_DDL)

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        ids, tags, start, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        many = np.array([r[4] for r in rows], bool)
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        size = n + length - 1
        base = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = base[row] + inside
        rank = suffix_ranks(data, at, length)
        place = start[row] + inside
        order = np.lexsort((place, tags[row], ids[row], rank))
        again = np.zeros(len(order), bool)
        again[order[1:]] = rank[order][1:] == rank[order][:-1]
        # Repeated strings as stretches.
        r = np.flatnonzero(again)
        new = np.flatnonzero(np.concatenate([[True], (row[r][1:] != row[r][:-1]) | (r[1:] != r[:-1] + 1)])) if len(r) else r
        runs = np.diff(np.append(new, len(r)))
        r = r[new]
        open_ = np.flatnonzero(~again & many[row])
        w = [h.of(h.prefix(data), at[open_], at[open_] + length).view(np.int64) for h in (_TRIGGERS, _PHRASES)]
        both = np.concatenate([r, open_])
        none = np.concatenate([np.ones(len(r), bool), np.zeros(len(open_), bool)])
        if not len(both):
            return None
        zeros = np.zeros(len(r), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[row[both]]), pa.array(tags[row[both]]), pa.array(place[both].astype(np.int32)),
            pa.array(np.concatenate([runs, np.ones(len(open_), np.int64)]).astype(np.int32)),
            *[pa.array(np.concatenate([zeros, x]), mask=none) for x in w],
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for key, salt, many, i, h, start, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK and (key, salt) != last:
                    if (made := solve(rows)) is not None:
                        yield made
                    rows, size = [], 0
                rows.append((i, h, start, n, many, text))
                size, last = size + len(text), (key, salt)
        if rows and (made := solve(rows)) is not None:
            yield made

    return slices.mapInArrow(run, FOUND_DDL)


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of the phrases to compare."""
    lists = wanted.groupBy("_id", "_h").agg(F.collect_list(F.struct("_key", "_salt", "_many", "_start", "_n")).alias("_wanted"))
    ddl = "_key bigint, _salt int, _many boolean, _id bigint, _h bigint, _start int, _n int, _slice binary"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, at = flat(batch.column(2))
            kept: list[tuple] = []
            for j, wants in enumerate(batch.column(3)):
                body = data[at[j] : at[j + 1]].tobytes()
                for w in wants.as_py():
                    s, n = w["_start"], w["_n"]
                    kept.append((w["_key"], w["_salt"], w["_many"], ids[j], tags[j], s, n, body[s : s + n + length - 1]))
                if len(kept) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), out)], schema=out)
                    kept = []
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), out)], schema=out)

    return docs.join(lists, ["_id", "_h"]).select("_id", "_h", "_text", "_wanted").mapInArrow(run, ddl)


def repeats(docs: DataFrame, length: int = LENGTH, store: Stored | None = None) -> DataFrame:
    """Stretches (_id, _h, _start, _n) of starts of strings that also start earlier.

    ``docs`` has (_id, _h, _text) with no two equal (_id, _h).
    """
    store = store or Stored(docs.sparkSession)
    known = store.keep(_sorted_out(parse(docs, length)))
    wanted = known.where("_open")
    slices = _cut(docs, wanted, length).repartition("_key", "_salt").sortWithinPartitions("_key", "_salt")
    found = _compare(slices, length)
    # Strings of triggers dealt over several tasks: the earliest of each stays.
    first = Window.partitionBy("_w1", "_w2").orderBy("_id", "_h", "_start")
    across = found.where("_w1 is not null").withColumn("_rank", F.row_number().over(first)).where("_rank > 1")
    stretch = ["_id", "_h", "_start", "_n"]
    more = found.where("_w1 is null").select(*stretch)
    if known.where("_open and _many").limit(1).count():
        found = store.keep(found)
        across = found.where("_w1 is not null").withColumn("_rank", F.row_number().over(first)).where("_rank > 1")
        more = found.where("_w1 is null").select(*stretch).unionByName(across.select(*stretch))
    return known.where(~F.col("_open")).select(*stretch).unionByName(more)


def cover(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the stretches (start, n)."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(spans):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document with the bytes of repeated strings removed.

    doc_id, n_bytes, removed (array of byte ranges) and kept (binary: a cut may
    fall inside a character). Equal (id, text) rows come once.
    """
    return _removed(documents(docs), length).select(public_id().alias("doc_id"), "n_bytes", "removed", "kept")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, without repeated strings; parts of characters at a cut go as well."""
    done = _removed(documents(docs, keep=True), length, as_text=True)
    return rebuilt(done.withColumnRenamed("kept", "_text"), docs)


def _removed(rows: DataFrame, length: int, as_text: bool = False) -> DataFrame:
    """_id, _h, n_bytes, removed, kept, and _keep if the rows have it."""
    spans = repeats(rows, length).groupBy("_id", "_h").agg(F.collect_list(F.struct("_start", "_n")).alias("_spans"))
    extra = [c for c in rows.columns if c == "_keep"]
    schema = struct(f"_id bigint, _h bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}")
    ranges = to_arrow_schema(schema).field(3).type
    for c in extra:
        schema = schema.add(rows.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(2))
            removed, kept = [], []
            for j, found in enumerate(batch.column(3).to_pylist()):
                body = data[at[j] : at[j + 1]].tobytes()
                runs = cover([(f["_start"], f["_n"]) for f in found or []], length)
                ends = [0, *[x for run in runs for x in run], len(body)]
                removed.append([{"start": a, "end": b} for a, b in runs])
                rest = b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(removed, ranges),
                pa.array(kept, pa.string() if as_text else pa.binary()), *batch.columns[4:],
            ], names=schema.names)

    return rows.join(spans, ["_id", "_h"], "left").select("_id", "_h", "_text", "_spans", *extra).mapInArrow(run, schema)


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row."""
    taken = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    done = _removed(documents(docs), length).select(
        public_id().alias("doc_id"), "_h", "n_bytes", taken.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return for_each_row(done, docs)
