"""Alignment of the tokens of two tokenizers, by lockstep merging.

Both token lists of a text spell the same bytes, so each token has a byte range. All
documents of a batch are merged at once: one vector holds, for each document, the next A
token and the next B token. In each step every document advances the side whose token ends
first, or both where they end together; there a cut and a link are emitted. Documents that
are through leave the vector. A long document has several places in it, one for each
``LANE`` bytes: where a merge stands at a byte offset is known without merging what is before.

Two tokens that end together spell the same bytes up to there, so one is a suffix of the
other. The pairs that can ever be linked follow from the two vocabularies alone (a pair for
each suffix of a token that is a token of the other side). They are numbered; a document's
links are stored as numbers, counted by bincount in each task and summed up by Spark. The
table of counts has at most one row for each such pair however large the corpus is,
so it is sent to all tasks.

Texts are cut before each space that follows a character other than white space. The byte-level
tokenizer always splits there; the piece model does, too, if none of its pieces has a space after
another character, which is checked (if one has, texts stay whole). So a text's ids are those of its
parts, and the ids of short parts are remembered. Each new part goes to both tokenizers.

Cases: null and empty texts, and those whose tokens do not spell the text again, have no
tokens: zeros, and an empty string of groups. Every row is aligned and counted, repeated ones
as often as they come; ids may be null or repeated. An empty table gives no rows. Other
columns are ignored and may have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import Stored, arrow

GROUP = 1 << 18  # characters of the documents that are merged at once, about
MEMO = 200_000  # parts whose ids a worker remembers
LONG = 40  # characters; longer parts are not remembered
LANE = 512
GATHER = 1 << 19  # tokens whose bytes are compared at once

SPACE = "▁"
_CUT = re.compile(r" (?<=\S )")


class Vocabulary:
    """Bytes of the tokens, by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        parts = []
        for lo in range(0, len(ids), GATHER):
            some = ids[lo : lo + GATHER]
            size = self.length[some]
            ends = np.cumsum(size)
            where = np.repeat(self.begin[some] - ends + size, size) + np.arange(ends[-1])
            parts.append(self.flat[where].tobytes())
        return b"".join(parts)


class ByteTokenizer:
    """A byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are plain text
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        known = self.model.get_vocab(with_added_tokens=False)
        tokens = [b""] * (1 + max(known.values()))
        for token, i in known.items():
            tokens[i] = bytes([byte[c] for c in token]) if all(c in byte for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)
        self.cuttable = True

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of the parts with a space before each."""
        return [e.ids for e in self.model.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


class PieceTokenizer:
    """A piece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.vocabulary = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in names)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


class Pairs:
    """The token pairs that can end together, numbered in order of (a, b)."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        def by_bytes(tokens):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                if t:
                    ids.setdefault(t, []).append(i)
            return ids

        of_a, of_b = by_bytes(a.tokens), by_bytes(b.tokens)
        keys = {(i << 32) | j for t, ids in of_a.items() for n in range(len(t)) for j in of_b.get(t[n:], ()) for i in ids}
        keys |= {(i << 32) | j for t, ids in of_b.items() for n in range(len(t)) for i in of_a.get(t[n:], ()) for j in ids}
        self.keys = np.sort(np.fromiter(keys, np.int64, len(keys)))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (a.astype(np.int64) << 32) | b).astype(np.int32)


@lru_cache(maxsize=1)
def memory(a_path: str, b_path: str, most: int) -> Encoded:
    """What this worker remembers, over its tasks."""
    a, b, _ = sides(a_path, b_path)
    return Encoded(a, b, most)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteTokenizer, PieceTokenizer, Pairs]:
    """Both tokenizers and their pairs, once in a worker."""
    a, b = ByteTokenizer(a_path), PieceTokenizer(b_path)
    return a, b, Pairs(a.vocabulary, b.vocabulary)


def parts_of(text: str) -> list[str]:
    """The text cut at each space behind a character that is no white space; that space is left out.

    A space at the very end stays with what is before it.
    """
    parts = _CUT.split(text)
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
        parts[-1] += " "
    return parts


class Encoded:
    """Ids of parts on both sides; those of the first ``most`` short parts are remembered.

    Part i has the ids flat[s][at[s][i] : at[s][i + 1]] on side s.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer, most: int = MEMO):
        self.sides, self.most = (a, b), most
        self.cuttable = a.cuttable and b.cuttable
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.at = [np.zeros(1, np.int64) for _ in self.sides]
        self.flat = [np.empty(0, np.int32) for _ in self.sides]

    def look_up(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all parts in order, and how many each has, of both sides."""
        number, known = self.number, len(self.number)
        where = np.fromiter([number.get(p, -1) for p in parts], np.int64, len(parts))
        absent = np.flatnonzero(where < 0)
        if known >= self.most and 2 * len(absent) > len(parts) and known:
            self.forget()  # other words than before
            return self.look_up(parts)
        missing = [parts[i] for i in absent.tolist()]
        new = sorted(set(missing), key=len)  # short ones first: they are kept
        keep = min(len(new), max(0, self.most - known))
        while keep and len(new[keep - 1]) > LONG:
            keep -= 1
        extra = dict(zip(new, range(known, known + len(new))))
        where[absent] = [extra[p] for p in missing]
        at, flat = [], []
        for s, side in enumerate(self.sides):
            lists = [x for lo in range(0, len(new), 10_000) for x in side.encode(new[lo : lo + 10_000])]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            made = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
            at.append(np.concatenate([self.at[s], self.at[s][-1] + np.cumsum(sizes)]))
            flat.append(np.concatenate([self.flat[s], made]) if len(made) else self.flat[s])
        ids, counts = [], []
        for s in range(2):
            size = at[s][where + 1] - at[s][where]
            ends = np.cumsum(size)
            take = np.repeat(at[s][where] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            ids.append(flat[s][take].astype(np.int64))
            counts.append(size)
        number.update(zip(new[:keep], range(known, known + keep)))
        self.at = [x[: known + keep + 1].copy() for x in at]
        self.flat = [x[: self.at[s][-1]].copy() for s, x in enumerate(flat)] if keep < len(new) else flat
        return ids, counts


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each A token the B token that ends with it, or -1.

    ``ends_*``: byte ends of all tokens of a batch; ``bounds``: where its documents begin and end.
    """
    partner = np.full(len(ends_a), -1, np.int64)
    beyond = np.iinfo(np.int64).max
    a_end, b_end = np.append(ends_a, beyond), np.append(ends_b, beyond)
    count = -(-np.diff(bounds) // lane)  # places of each document
    first = np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(bounds[:-1], count) + (np.arange(len(first)) - first) * lane
    stop = np.minimum(begin + lane, np.repeat(bounds[1:], count))
    a, b = np.searchsorted(ends_a, begin, "right"), np.searchsorted(ends_b, begin, "right")
    while len(a):
        x, y = a_end[a], b_end[b]
        going = np.minimum(x, y) <= stop
        if not going.all():
            a, b, x, y, stop = a[going], b[going], x[going], y[going], stop[going]
        together = x == y
        partner[a[together]] = b[together]
        a = a + (x <= y)
        b = b + (y <= x)
    return partner


class Batch:
    """Tokens and links of some documents."""

    def __init__(self, texts: list[str], encoded: Encoded, lane: int = LANE):
        parts = [(parts_of(t) if encoded.cuttable else [t]) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
        n = len(texts)
        valid = np.ones(n, bool)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        self.ids, counts = encoded.look_up(list(chain.from_iterable(parts)))
        self.at = [np.concatenate([[0], np.cumsum(np.bincount(owner, c, n).astype(np.int64))]) for c in counts]
        for side, ids, at in zip(encoded.sides, self.ids, self.at):
            spelt, lengths = side.vocabulary.spell(ids), np.concatenate([[0], np.cumsum(side.vocabulary.length[ids])])[at]
            valid &= [spelt[lo:hi] == t for lo, hi, t in zip(lengths[:-1].tolist(), lengths[1:].tolist(), raw)]
        if not valid.all():
            for s in range(2):
                sizes = np.diff(self.at[s])
                self.ids[s] = self.ids[s][np.repeat(valid, sizes)]
                self.at[s] = np.concatenate([[0], np.cumsum(np.where(valid, sizes, 0))])
        ends = [np.cumsum(side.vocabulary.length[ids]) for side, ids in zip(encoded.sides, self.ids)]
        bounds = np.concatenate([[0], np.cumsum([len(t) if ok else 0 for t, ok in zip(raw, valid)])])
        partner = lockstep(*ends, bounds, lane)
        self.cut_a = np.flatnonzero(partner >= 0)  # last A and last B token of each group
        self.cut_b = partner[self.cut_a]
        self.link_at = np.searchsorted(self.cut_a, self.at[0])  # links of each document

    def groups(self, names: list[str], offset: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document; ``names``: ids with the signs behind them."""
        last = [np.zeros(len(ids), bool) for ids in self.ids]
        last[0][self.cut_a], last[1][self.cut_b] = True, True
        group = [np.cumsum(x) - x for x in last]  # of each token
        begin_b = np.concatenate([[0], self.cut_b + 1])
        order = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int32)
        order[np.arange(len(self.ids[0])) + begin_b[group[0]]] = 2 * self.ids[0] + last[0]
        order[np.arange(len(self.ids[1])) + self.cut_a[group[1]] + 1] = offset + 2 * self.ids[1] + last[1]
        ends = self.at[0] + self.at[1]
        return ["".join([names[i] for i in order[lo:hi].tolist()])[:-1] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _names(a: Vocabulary, b: Vocabulary) -> list[str]:
    return [f"{i}{sign}" for n, signs in ((len(a.tokens), ",|"), (len(b.tokens), ",;")) for i in range(n) for sign in signs]


ALIGNED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<int>"


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                    group: int = GROUP, lane: int = LANE, memo: int = MEMO) -> DataFrame:
    """Groups of tokens between common ends as text, and the numbers of the linked pairs (see ``Pairs``) in order."""
    out = arrow(ALIGNED_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, pairs = sides(a_path, b_path)
        names, offset = _names(a.vocabulary, b.vocabulary), 2 * len(a.vocabulary.tokens)
        encoded = memory(a_path, b_path, memo)

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            batch = Batch(texts, encoded, lane)
            links = pairs.numbers(batch.ids[0][batch.cut_a], batch.ids[1][batch.cut_b])
            count = np.diff(batch.link_at)
            arrays = [pa.array(ids, pa.int64()), pa.array(np.diff(batch.at[0])), pa.array(np.diff(batch.at[1])), pa.array(count), pa.array(count),
                      pa.array(batch.groups(names, offset), pa.string()),
                      pa.ListArray.from_arrays(pa.array(batch.link_at.astype(np.int32)), pa.array(links)).cast(out.field("links").type)]
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(i)
                texts.append(text)
                size += len(text) + 16
                if size >= group:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, ALIGNED_DDL)


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count of links, best: whether it is the highest count of the B id."""
    ddl = "a_id int, b_id int, count bigint"
    out = arrow(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sides(a_path, b_path)[2].keys
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(keys))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys[met] >> 32).astype(np.int32)), pa.array((keys[met] & 0xFFFFFFFF).astype(np.int32)), pa.array(total[met])], schema=out)

    summed = aligned.select("links").mapInArrow(count, ddl).groupBy("a_id", "b_id").agg(F.sum("count").alias("count"))
    return summed.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


SCORE_DDL = "n_best bigint, count_sum bigint"


def link_scores(docs: DataFrame, a_path: str, b_path: str, derive: dict | None = None, **options) -> DataFrame:
    """Per document: counts, links that are their B id's best, and the sum of the links' counts.

    ``derive``: columns to take from the aligned documents, by name; the group text itself by default.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    taken = {"groups": F.col("groups")} if derive is None else derive
    counts = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    aligned = align_documents(docs, a_path, b_path, **options)
    aligned = store.keep(aligned.select(*counts, "links", *[c.alias(n) for n, c in taken.items()]))
    # Bounded by the vocabularies: a row for each pair of which one token is a suffix of the other.
    table = pair_counts(aligned, a_path, b_path).toArrow()
    _, _, pairs = sides(a_path, b_path)
    number = pairs.numbers(table.column("a_id").to_numpy(), table.column("b_id").to_numpy())
    count, best = np.zeros(len(pairs.keys), np.int64), np.zeros(len(pairs.keys), bool)
    count[number], best[number] = table.column("count").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast((count, best))

    plain = [*counts, *taken]
    kinds = dict(aligned.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in plain) + ", " + SCORE_DDL
    out = arrow(ddl)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            links = batch.column(0)
            at = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            met = links.flatten().to_numpy(zero_copy_only=False)
            sums = [np.concatenate([[0], np.cumsum(x[met], dtype=np.int64)]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(s[at[1:]] - s[at[:-1]]) for s in sums]], schema=out)

    return aligned.select("links", *plain).mapInArrow(score, ddl)
