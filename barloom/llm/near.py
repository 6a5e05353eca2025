"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its words (split at ASCII white space); its k-mers
are ``K`` consecutive words, each labelled with how often it has occurred before,
so all k-mers of a document differ. For each of ``FUNCTIONS`` hash functions the
``PICK`` k-mers of smallest hash are taken and kept in the order of the text: two
documents share the tuple only if they share these k-mers in the same order, so
the chance follows edit similarity rather than set overlap.

Two documents are linked if an alignment of their k-mer sequences matches a
share of at least ``SIMILARITY`` of the k-mers of both together:
matched / (n_a + n_b - matched). The labels make k-mers unique, so the best
alignment is a longest increasing run of positions, taken within the band of
offsets that so similar sequences can have.

Equal word sequences are one text from the start. Every text in a bucket is first
compared with the bucket's most central text only; then, in buckets that still
hold several components, texts of different components whose parities allow the
similarity. A parity holds, for each of ``PARITY`` classes of k-mers, whether their
number is odd; where two parities differ, so do the k-mers, so no pair is lost by it,
and it rules out nearly all pairs of alike but unlinked texts of up to some 2,000 words.
Two texts with similarity 0.8 share a tuple in about half of the 16 functions: none
with probability 2e-5, for 4 against 5 k-mers 2.8e-4, which only matters if no chain
of links joins them.

Cases: null and empty texts, and texts of white space, are equal; a text of up to
K words is one k-mer; rows with the same id and different texts are documents of
their own; repeated rows are copies; a null id is before all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import Stored, arrow, documents, for_each_row, public_id, rebuilt
from barloom.llm.components import components, merged
from barloom.llm.rolling import TOP, U64, flat, groups, mix, shared

K = 5  # words
SIMILARITY = 0.8
FUNCTIONS = 16
PICK = 3
PARITY = 1024  # bits, a multiple of 64

_WORDS = shared(101)
_WEIGHTS = np.random.default_rng(102).integers(0, 1 << 64, 64, dtype=np.uint64) | U64(1)
_SEEDS = np.random.default_rng(103).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a group of texts, and the offsets of the texts in them."""
    if not len(data):
        return np.empty(0, U64), np.zeros(len(at), np.int64)
    blank = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a text ends here, and so does a word
    start = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1
    return _WORDS.of(_WORDS.prefix(data), start, end), np.searchsorted(start, at)


def kmers(words: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of each text, and offsets; a text of 1 to k words has one."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(out[-1]) - out[text] + at[text]
    made = np.zeros(out[-1], U64)
    for j in range(k):
        inside = first + j < at[text + 1]
        made[inside] += words[first[inside] + j] * _WEIGHTS[j]
    made = mix(made)
    order = np.lexsort((made, text))  # stable: equal k-mers stay in the order of the text
    new = np.concatenate([[True], (made[order][1:] != made[order][:-1]) | (text[order][1:] != text[order][:-1])])[: len(order)]
    begins = np.flatnonzero(new)
    times = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    label = np.empty(len(order), np.int64)
    label[order] = times
    return mix(made + label.astype(U64) * _WEIGHTS[k]), out


def order_minhash(found: np.ndarray, at: np.ndarray, functions: int = FUNCTIONS, pick: int = PICK) -> np.ndarray:
    """One key per text and function: the smallest ``pick`` k-mers in the order of the text. Texts without k-mers get none."""
    n = np.diff(at)
    texts = np.flatnonzero(n)
    keys = np.zeros((len(n), functions), U64)
    if not len(texts):
        return keys
    begins, sizes = at[texts], n[texts]
    text = np.repeat(np.arange(len(texts)), sizes)
    for f in range(functions):
        value = mix(found ^ _SEEDS[f])
        left, limit = value.copy(), np.zeros(len(texts), U64)
        for _ in range(pick):
            low = np.minimum.reduceat(left, begins)
            limit = np.where(low == TOP, limit, low)
            left[left == low[text]] = TOP
        taken = np.flatnonzero(value <= limit[text])
        owner = text[taken]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        rank = np.arange(len(taken)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(taken))))
        keys[texts, f] = mix(np.add.reduceat(found[taken] * _WEIGHTS[10 + rank], np.flatnonzero(first)) + _SEEDS[f])
    return keys


def parities(found: np.ndarray, at: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """One row per text: the bits of the classes that hold an odd number of its k-mers."""
    out = np.zeros((len(at) - 1, bits // 64), U64)
    place = mix(found ^ _SEEDS[253]) % U64(bits)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_xor.at(out, (text, (place >> U64(6)).astype(np.int64)), U64(1) << (place & U64(63)))
    return out


def may_align(a: str, b: str, na: str, nb: str, similarity: float) -> Column:
    """Whether two parities leave room for the similarity: m of n_a and n_b k-mers matched leave n_a + n_b - 2 m unmatched."""
    differ = reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY // 64)])
    return differ <= (F.col(na) + F.col(nb)) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def sketch(rows: DataFrame, functions: int = FUNCTIONS) -> DataFrame:
    """_t1, _t2 (128 bits of the word sequence), _n k-mers, _keys and _parity of each document (_id, _h, _text)."""
    ddl = "_id bigint, _h bigint, _t1 bigint, _t2 bigint, _n int, _keys array<bigint>, _parity array<bigint>"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(2))
            for lo, hi in groups(at):
                words, where = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                found, each = kmers(words, where)
                keys = order_minhash(found, each, functions).view(np.int64)
                place = np.arange(len(words), dtype=np.int64) - np.repeat(where[:-1], np.diff(where))
                sums = []
                for seed in (_SEEDS[254], _SEEDS[255]):
                    total = np.concatenate([[0], np.cumsum(mix(words ^ mix(place.astype(U64) + seed)))]).astype(U64)
                    sums.append(mix(total[where[1:]] - total[where[:-1]] + seed).view(np.int64))
                n = np.diff(each)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, functions, 0))]).astype(np.int32)), pa.array(keys[n > 0].ravel()))
                odd = pa.ListArray.from_arrays(
                    pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (PARITY // 64)), pa.array(parities(found, each).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array(n.astype(np.int32)), lists.cast(out.field(5).type), odd.cast(out.field(6).type),
                ], schema=out)

    return rows.select("_id", "_h", "_text").mapInArrow(run, ddl)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether an alignment of two sequences of distinct k-mers matches the wanted share of them."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    if need > min(len(a), len(b)):
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= total - 2 * need
    i, j = i[inside], j[inside]
    if len(i) < need:
        return False
    j = j[np.argsort(i)]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return True
    tops: list[int] = []
    for x in j.tolist():
        p = bisect_left(tops, x)
        if p == len(tops):
            tops.append(x)
        else:
            tops[p] = x
    return len(tops) >= need


def verify(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (_a, _b) of nodes whose texts align."""
    left = bodies.select(F.col("_node").alias("_a"), F.col("_text").alias("_ta"))
    right = bodies.select(F.col("_node").alias("_b"), F.col("_text").alias("_tb"))
    ddl = "_a bigint, _b bigint"
    out = arrow(ddl)

    def of(column: pa.Array) -> Iterator[np.ndarray]:
        """k-mers of each text, a group of texts at a time."""
        data, at = flat(column)
        for lo, hi in groups(at):
            found, each = kmers(*word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
            yield from (found[each[i] : each[i + 1]] for i in range(hi - lo))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.append(True, a[1:] != a[:-1])[: len(a)]  # a hub comes many times in a row
            hubs, now, hits = of(batch.column(3).filter(pa.array(new))), np.empty(0, U64), np.zeros(len(a), bool)
            for i, body in enumerate(of(batch.column(2))):
                if new[i]:
                    now = next(hubs)
                hits[i] = aligned(now, body, similarity)
            if hits.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(b[hits])], schema=out)

    both = pairs.join(right, "_b").join(left, "_a").select("_a", "_b", "_tb", "_ta")
    return both.mapInArrow(run, ddl)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), is_first: one row per input row."""
    found = _classes(documents(docs), similarity, functions)
    named = found.select(public_id().alias("doc_id"), "_h", public_id("_class").alias("class_id"), "is_first")
    return for_each_row(named, docs)


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """The first document of each class, with all columns."""
    rows = documents(docs, keep=True)
    first = _classes(rows, similarity, functions).where("is_first").select("_id", "_h")
    return rebuilt(rows.join(first, ["_id", "_h"], "left_semi"), docs)


def _classes(rows: DataFrame, similarity: float, functions: int) -> DataFrame:
    spark = rows.sparkSession
    store = Stored(spark)
    node = F.when(F.col("_h") == 0, F.col("_id")).otherwise(F.xxhash64("_id", "_h"))
    made = store.keep(sketch(rows, functions))
    # One row per text, named by its first document.
    distinct = store.keep(made.groupBy("_t1", "_t2").agg(
        F.min(F.struct("_id", "_h")).alias("_doc"), F.any_value("_n").alias("_n"), F.any_value("_keys").alias("_keys"),
        F.any_value("_parity").alias("_parity")
    ).select("_t1", "_t2", "_doc", F.when(F.col("_doc._h") == 0, F.col("_doc._id")).otherwise(F.xxhash64("_doc._id", "_doc._h")).alias("_node"), "_n", "_keys", "_parity"))
    # Buckets with several texts. A text's own functions can agree on a key: once is enough.
    shown = distinct.select(F.explode(F.array_distinct("_keys")).alias("_key"), "_node", "_n")
    sizes = shown.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1")
    shared = shown.join(sizes, "_key")
    members = store.keep(shared)
    weight = members.groupBy("_node").agg(F.sum("_size").alias("_weight"))
    weighted = members.join(weight, "_node")
    hubs = weighted.groupBy("_key").agg(F.max(F.struct("_weight", (-F.col("_node")).alias("_minus"), "_node", "_n")).alias("_hub"))
    pair_ok = F.least("_na", "_nb") >= F.lit(similarity) * F.greatest("_na", "_nb") - 1e-9
    stars = members.join(hubs.select("_key", F.col("_hub._node").alias("_a"), F.col("_hub._n").alias("_na")), "_key").select(
        "_a", F.col("_node").alias("_b"), "_na", F.col("_n").alias("_nb")).where(F.col("_a") != F.col("_b")).where(pair_ok)
    stars = store.keep(stars.select("_a", "_b").distinct())
    wanted = members.select("_node").distinct()
    bodies = store.keep(rows.select(node.alias("_node"), "_text").join(wanted, "_node", "left_semi"))
    links = store.keep(verify(stars, bodies, similarity))
    found = components(links, store)
    # Buckets that still hold several components: texts of different ones.
    named = members.join(found, "_node", "left").select("_key", "_node", "_n", F.coalesce("_component", "_node").alias("_component"))
    mixed = named.groupBy("_key").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).where("_lo <> _hi").select("_key")
    open_ = store.keep(named.join(mixed, "_key").join(distinct.select("_node", "_parity"), "_node"))
    sides = [open_.select("_key", F.col("_node").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_component").alias(f"_c{x}"), F.col("_parity").alias(f"_p{x}")) for x in "ab"]
    apart = (F.col("_ca") != F.col("_cb")) & (F.col("_a") < F.col("_b"))
    cross = sides[0].join(sides[1], "_key").where(apart & pair_ok & may_align("_pa", "_pb", "_na", "_nb", similarity)).select("_a", "_b").distinct()
    tried = stars.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    cross = store.keep(cross.join(tried, ["_a", "_b"], "left_anti"))
    more = store.keep(verify(cross, bodies, similarity))
    if not more.isEmpty():
        found = merged(found, more, store)
    # A text that is linked to no other is a class of its own.
    linked = distinct.select("_node", "_doc").join(found, "_node")
    first = linked.groupBy("_component").agg(F.min("_doc").alias("_first"))
    named = distinct.select("_t1", "_t2", "_node", "_doc").join(found.join(first, "_component").select("_node", "_first"), "_node", "left").select(
        "_t1", "_t2", F.coalesce("_first", "_doc").alias("_first"))
    same = (F.col("_id") == F.col("_first._id")) & (F.col("_h") == F.col("_first._h"))
    done = made.select("_id", "_h", "_t1", "_t2").join(named, ["_t1", "_t2"])
    return done.select("_id", "_h", F.col("_first._id").alias("_class"), same.alias("is_first"))
