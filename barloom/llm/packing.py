"""Packing of tokenised documents into sequences, by cutting-stock column generation.

Documents are cut into pieces of a sequence's length and a rest. How the rests
share sequences is a cutting-stock problem over the histogram of their lengths,
which has no more than ``LENGTH / STEP`` classes however many documents there
are: a linear program over patterns, whose columns are priced by a knapsack over
the duals. A second kind of column cuts a rest of more than half a sequence after
that half; it has a small price, so rests are only cut where that saves padding.
Whole multiples of the patterns are taken, what is left over is filled
greedily, and all that on the driver concerns classes and counts only.

Pieces are then ranked within their class (counted by salt first, so a class
that holds most of the pieces is ranked by many tasks), and the rank says which
sequence and slot a piece gets.

Cases: null and empty texts are documents of one token, the end token; repeated
rows are packed as often as they come; an empty table gives no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import Stored, arrow, public_id, texts

LENGTH = 2048
END = 1  # id that ends each document
STEP = 4  # tokens between two length classes
SALTS = 256
MEMO = 800_000  # words, and half the chunks of text, whose ids a worker remembers (up to some 500 MB)
ROUNDS = 4000  # columns the linear program may take in
NEAR = 1e-3  # the program ends this close to its optimum, relatively
CUT = 0.02  # price of a cut, in sequences

# -- tokens -----------------------------------------------------------------------------

_ODD = re.compile("[\x1c-\x1f]")  # white space for Python, not for the tokenizer
_BLANK = re.compile("[ \t\n\r\x0b\x0c]+")


# Chunks of these characters only are split and lowered here as the tokenizer would, without going through all its steps.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ.,]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[.,]+")


class Remembered(dict):
    """Results of ``make``; the older half is forgotten when there are too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids as little-endian 32-bit bytes.

    The tokenizer never joins what white space separates, and drops white space
    itself; so a text's ids are those of its chunks, and a chunk met before is
    looked up. The tokenizer itself gives the ids of every new chunk, its merge
    model those of a new word in a chunk of plain letters.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        encode, merge = whole.encode, whole.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the merge model
        rest = [b for b in range(256) if b not in set(plain)]
        signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

        spelt = [i.to_bytes(4, "little") for i in range(whole.get_vocab_size())]

        def of_word(word: str) -> bytes:
            # Letters of ASCII stand for themselves.
            return b"".join([spelt[t.id] for t in merge(word if word.isascii() else "".join([signs[b] for b in word.encode()]))])

        words = Remembered(of_word, memo)

        def of_chunk(chunk: str) -> bytes:
            if _SIMPLE.fullmatch(chunk):
                parts = _PARTS.findall(chunk.lower())
                return words[parts[0]] if len(parts) == 1 else b"".join([words[p] for p in parts])
            return b"".join([spelt[i] for i in encode(chunk, add_special_tokens=False).ids])

        self.known = Remembered(of_chunk, 2 * memo)

    def __call__(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[c] for c in (_BLANK.split(text) if _ODD.search(text) else text.split())])


_ENCODERS: dict[tuple[str, int], Encoder] = {}  # of this worker; it serves many tasks


def encoder(path: str, memo: int = MEMO) -> Encoder:
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = Encoder(path, memo)
    return _ENCODERS[path, memo]


# _crc_a, _crc_b: checksums of the two parts, should a rest be cut after half a sequence.
PIECE_DDL = "_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _crc_a bigint, _crc_b bigint"


def tokenize(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Pieces of each document: start, length, checksum and, if wanted, the ids themselves.

    ``memo``: what a worker remembers at most; less takes less memory and more time.
    """
    ddl = PIECE_DDL + (", ids array<int>" if with_ids else "")
    out = arrow(ddl)
    last = np.array([end], "<u4").tobytes()

    def halves(piece: bytes) -> tuple:
        half = 2 * length  # bytes
        return (zlib.crc32(piece[:half]), zlib.crc32(piece[half:])) if half < len(piece) < 2 * half else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, memo)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + last
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (i, start, len(piece) // 4, zlib.crc32(piece), n, *halves(piece))
                    rows.append((*row, np.frombuffer(piece, "<i4")) if with_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return texts(docs).mapInArrow(run, ddl)


# -- patterns ---------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """How often each class is taken in the most valuable pattern; dynamic programming over the room."""
    worth = np.full(room + 1, -1.0)  # of a piece of each size
    worth[sizes] = values
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        sums = best[c - 1 :: -1] + worth[1 : c + 1] if c < room else best[room - 1 :: -1] + worth[1:]
        j = int(sums.argmax()) + 1
        if sums[j - 1] > best[c - 1] + 1e-12:
            best[c], took[c] = sums[j - 1], j
        else:
            best[c] = best[c - 1]
    of = {int(size): j for j, size in enumerate(sizes)}
    pattern = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if took[c]:
            pattern[of[int(took[c])]] += 1
            c -= took[c]
        else:
            c -= 1
    return pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns (as rows), amounts and prices of the linear program: cheapest way to give the demand.

    A column with a -1 is a cut: it gives one piece and takes its two parts.
    """
    m, half = len(sizes), room // 2
    first = room // sizes
    columns, prices = np.diag(first).astype(float), np.ones(m)  # column p is columns[:, p]
    inverse = np.diag(1 / first)
    amount = inverse @ demand
    at = {int(size): j for j, size in enumerate(sizes)}
    cuts = np.array([(j, at[int(s) - half]) for j, s in enumerate(sizes) if s > half and int(s) - half in at and half in at], np.int64).reshape(-1, 2)
    for turn in range(rounds):
        duals = prices @ inverse
        column, price = None, 1.0
        if len(cuts):
            saves = duals[cuts[:, 0]] - duals[cuts[:, 1]] - duals[at[half]] - CUT
            if saves.max() > 1e-6:
                j, rest = cuts[int(saves.argmax())]
                column, price = np.zeros(m), CUT
                column[j] += 1
                column[rest] -= 1
                column[at[half]] -= 1
        if column is None:
            column = knapsack(sizes, duals, room).astype(float)
            if duals @ column <= 1 + NEAR:
                break
        step = inverse @ column
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], prices[out] = column, price
        if turn % 64 == 63:
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ demand, 0)
            continue
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
    return columns.T.astype(np.int64), amount, prices


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Patterns and how often each is used, and how many pieces of each class are cut.

    Together the patterns hold exactly the demand after the cuts.
    """
    if not len(sizes):
        return [], np.zeros(0, np.int64)
    half, at = room // 2, {int(s): j for j, s in enumerate(sizes)}
    columns, amount, _ = solve(sizes, demand, room)
    left, cut = demand.copy(), np.zeros(len(sizes), np.int64)
    for p, x in zip(columns, amount):
        if (p < 0).any():
            j = int(p.argmax())
            cut[j] = min(int(x + 0.5), demand[j])
            left[j] -= cut[j]
            left[at[int(sizes[j]) - half]] += cut[j]
            left[at[half]] += cut[j]
    used: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        if times > 0 and pattern.any():
            used.append((pattern, times))
            left[:] -= pattern * times

    whole = [(p, x) for p, x in zip(columns, amount) if p.any() and not (p < 0).any()]
    for p, x in whole:
        take(p, min(int(x + 1e-6), int((left[p > 0] // p[p > 0]).min())))
    for p, _ in sorted(whole, key=lambda c: -(c[1] % 1)):  # rounded up where the rest allows it
        if (p <= left).all():
            take(p, 1)
    while left.any():  # largest first
        pattern, free = np.zeros(len(sizes), np.int64), room
        for j in np.flatnonzero(left)[::-1]:
            pattern[j] = min(left[j], free // sizes[j])
            free -= pattern[j] * sizes[j]
            if not free:
                break
        some = pattern > 0
        take(pattern, int((left[some] // pattern[some]).min()))
    return used, cut


# -- assignment -------------------------------------------------------------------------


def _slots(used: list[tuple[np.ndarray, int]], classes: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of a class from ``rank`` on fill pattern sequences from ``seq`` on, ``per`` in each, at slot ``slot``."""
    next_rank = {int(c): 0 for c in classes}
    rows, seq = [], 0
    for pattern, times in used:
        slot = 0
        for j in np.flatnonzero(pattern):
            c, per = int(classes[j]), int(pattern[j])
            rows.append((c, next_rank[c], seq, per, slot))
            next_rank[c] += per * times
            slot += per
        seq += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("cls", "rank", "seq", "per", "slot"), table.T))


def pack(pieces: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces; some of them come back cut in two."""
    room, half, whole = length // step, length // 2, length // step + 1
    cls = F.when(F.col("length") == length, whole).otherwise(F.ceil(F.col("length") / step)).cast("int")
    tied = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
    salted = pieces.withColumn("_cls", cls).withColumn("_salt", F.pmod(F.xxhash64(*tied), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy("_cls", "_salt").count()  # at most (length / step + 1) * SALTS rows
    before = Window.partitionBy("_cls").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("_cls", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    total = np.zeros(whole + 1, np.int64)
    for r in counted.groupBy("_cls").agg(F.sum("count").alias("n")).collect():
        total[r["_cls"]] = r["n"]
    classes = np.arange(1, room + 1)
    classes = classes[(total[1 : room + 1] > 0) | (classes <= room // 2)] if total[1 : room + 1].any() else classes[:0]
    used, cut_of = plan(classes, total[classes], room)
    cuts = np.zeros(whole + 1, np.int64)
    cuts[classes] = cut_of
    classes = np.append(classes, whole)
    used = [(np.append(p, 0), n) for p, n in used]
    if total[whole]:
        used.append((np.append(np.zeros(len(classes) - 1, np.int64), 1), int(total[whole])))
    slots = _slots(used, classes)
    # Ranks of the parts of cut pieces come after those of the class's own pieces.
    own = total - cuts
    halves = np.cumsum(cuts) - cuts + own[room // 2]
    order = Window.partitionBy("_cls", "_salt").orderBy(*tied)
    ranked = salted.withColumn("_nth", F.row_number().over(order) - 1).join(F.broadcast(base), ["_cls", "_salt"])
    names = [c for c in pieces.columns if c not in ("_crc_a", "_crc_b")]
    ranked = ranked.select(*pieces.columns, F.col("_cls").cast("bigint").alias("_cls"), (F.col("_nth") + F.col("_base")).cast("bigint").alias("_rank"))
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("_slot", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots["cls"] << 44) + slots["rank"]

        def placed(columns: dict, c: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            at = np.searchsorted(keys, (c << 44) + r, "right") - 1
            inside = r - slots["rank"][at]
            seq = slots["seq"][at] + inside // slots["per"][at]
            slot = slots["slot"][at] + inside % slots["per"][at]
            return pa.RecordBatch.from_arrays([*[columns[n] for n in names], pa.array(seq), pa.array(slot)], names=[*names, "sequence_id", "_slot"])

        for batch in batches:
            c, r = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("_cls", "_rank"))
            torn = r < cuts[c]
            for part in (0, 1, 2):  # as they are, first halves, rests
                mine = np.flatnonzero(torn if part else ~torn)
                if not len(mine):
                    continue
                some = batch.take(pa.array(mine))
                columns = dict(zip(some.schema.names, some.columns))
                cc, rr = c[mine], r[mine] - cuts[c[mine]]
                if part:
                    n, start = (columns[k].to_numpy(zero_copy_only=False) for k in ("length", "start"))
                    columns["ids_crc32"] = columns["_crc_a" if part == 1 else "_crc_b"]
                    columns["length"] = pa.array(np.full(len(n), half) if part == 1 else n - half)
                    columns["start"] = pa.array(start + (half if part == 2 else 0))
                    if "ids" in columns:
                        cutting = slice(0, half) if part == 1 else slice(half, None)
                        columns["ids"] = pa.array([ids[cutting] for ids in columns["ids"].to_pylist()], columns["ids"].type)
                    rr = r[mine] + (halves[cc] if part == 1 else own[cc - room // 2])
                    cc = np.full(len(mine), room // 2) if part == 1 else cc - room // 2
                yield placed(columns, cc, rr)

    placed = ranked.mapInArrow(assign, schema)
    # A class is an upper bound: offsets follow from the true lengths. A sequence has few pieces.
    within = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).cast("bigint")
    return placed.withColumn("offset", offset).drop("_slot")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Tokenise and pack: one row per piece."""
    store = Stored(docs.sparkSession)
    pieces = store.keep(tokenize(docs, path, length, with_ids=with_ids, memo=memo))
    packed = pack(pieces, length)
    return packed.select(public_id().alias("doc_id"), *[c for c in packed.columns if c != "_id"])
