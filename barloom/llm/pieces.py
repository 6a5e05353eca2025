"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is cut into vocabulary pieces so that the sum of their scores is largest;
a character no piece covers is written as its UTF-8 bytes, by the byte pieces.
The search goes over a text in strides. Between two of them it keeps the scores of the last
``longest`` boundaries only, since no piece reaches farther back, and the backpointers that are
not committed yet: as soon as all open paths trace back through one boundary, the
ids before it cannot change any more and are committed. So memory does not grow with the text.

Many texts are searched at once, one lane each: the pieces that start anywhere in a stride
are found by walking down a trie for all places together, and one step of the
search relaxes the pieces that start at the same place of all lanes.

Where no piece of the vocabulary can span two neighbouring characters, every path
breaks there: all paths converge by themselves. If pieces have spaces in front only, texts are
cut into words there, and the ids of short words are remembered; each new word is a lane of
the search, as is any text or stretch without such a place, however long.

Scores are those of the model if they are log probabilities. A model of merges has
ranks instead; the score of rank r is then -log(r + 2), as word frequencies fall. Of equally good
paths, the one whose last piece starts first is taken.

Cases: null and empty texts have no ids; spaces are the piece character U+2581,
one is put in front of the text, and decoding takes it away; that character itself
is written as bytes, so every text comes back. Repeated rows are encoded each, an empty table
gives no rows, and other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow, public_id, texts

SPACE = "▁"
UNIT = 1 << 20  # scores are whole multiples of 1 / UNIT, so that sums are exact and ties always fall alike
MEMO = 200_000  # words whose ids a worker remembers
LONG = 40  # characters; longer words are not remembered
GROUP = 1 << 18  # characters of texts that are searched together, about
STRIDE = 256
CELLS = 1 << 19  # boundaries of lanes that are worked on at once
ESCAPED = "\udc81"  # stands for a U+2581 of the text while it is searched; no text holds it
NEVER = -(1 << 62)

_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Vocabulary:
    """Pieces with scores, and the byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, control: frozenset[int] = frozenset()):
        self.scores, self.ids, self.bytes = {}, {}, [unknown] * 256
        self.text: list[bytes] = []
        for i, (piece, score) in enumerate(pieces):
            m = _BYTE.match(piece)
            if m:
                self.bytes[int(m[1], 16)] = i
            elif i != unknown and i not in control and piece:
                self.scores[piece], self.ids[piece] = round(score * UNIT), i
            self.text.append(bytes([int(m[1], 16)]) if m else b"" if i == unknown or i in control else piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.scores), default=1)
        self.fallback = min(self.scores.values(), default=0) - 10 * UNIT
        self._build_trie()
        # Neighbours that some piece holds; all other places are boundaries of every path.
        self.joined = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        letters = {c for pair in self.joined for c in pair}
        self.wordlike = SPACE in letters and not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined)
        lengths = np.array([len(t) for t in self.text], np.int64)
        self.begin, self.length = np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.forget()

    def _build_trie(self) -> None:
        """Edges (node, character) -> node in sorted order; the piece that ends at a node, and its score."""
        edge: dict[tuple[int, int], int] = {}
        ends: dict[int, str] = {}
        for piece in self.scores:
            node = 0
            for c in map(ord, piece):
                node = edge.setdefault((node, c), len(edge) + 1)
            ends[node] = piece
        keys = np.array([(n << 21) | c for n, c in edge], np.int64)
        order = np.argsort(keys)
        self.edges, self.child = keys[order], np.array(list(edge.values()), np.int64)[order]
        self.piece, self.value = np.full(len(edge) + 1, -1, np.int32), np.zeros(len(edge) + 1, np.int64)
        for node, piece in ends.items():
            self.piece[node], self.value[node] = self.ids[piece], self.scores[piece]

    # -- search ---------------------------------------------------------------------------

    def _starting(self, points: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that start at each of the places ``at`` of a text and end by ``end``: (place's index, length, id, score).

        A place without a piece of one character gets that character with id -1.
        """
        found = []
        place, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for size in range(1, self.longest + 1):
            here = at[place] + size - 1
            inside = here < end[place]
            place, node, here = place[inside], node[inside], here[inside]
            key = (node << 21) | points[here]
            where = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            known = self.edges[where] == key if len(self.edges) else np.zeros(len(key), bool)
            if size == 1:
                piece = np.where(known, self.piece[self.child[where]] if len(self.edges) else -1, -1)
                bare = place[piece < 0]
                found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1, np.int32), np.full(len(bare), self.fallback)))
            place, node = place[known], self.child[where[known]] if len(self.edges) else node[known]
            if not len(place):
                break
            piece = self.piece[node]
            ends = piece >= 0
            found.append((place[ends], np.full(int(ends.sum()), size, np.int64), piece[ends], self.value[node[ends]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def search_all(self, words: list[str], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (of pieces and spaces as U+2581) in order, and how many each has."""
        points = _points("".join(words))
        sizes = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        lanes: list[list[tuple[np.ndarray, np.ndarray]]] = []  # committed (lane, id, place) in order of time
        order = np.argsort(np.minimum(sizes, stride), kind="stable")
        fresh, lo = [], 0
        while lo < len(order):  # lanes of similar length share a table
            width = lambda hi: (hi - lo) * (min(int(sizes[order[hi - 1]]), stride) + self.longest + 1)
            hi = lo + 1
            step = 1
            while step:
                step = min(step, len(order) - hi)
                if step and width(hi + step) <= CELLS:
                    hi, step = hi + step, step * 2
                else:
                    step //= 2
            fresh.append(order[lo:hi])
            lo = hi
        open_lanes: dict[int, _Open] = {}
        for some in fresh:
            self._stride(points, some, begin[some], end[some], stride, {}, lanes, open_lanes)
        while open_lanes:
            state, open_lanes = open_lanes, {}
            some = np.array(sorted(state), np.int64)
            self._stride(points, some, np.array([state[int(i)].at for i in some]), end[some], stride, state, lanes, open_lanes)
        if not lanes:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        lane, ids, place = (np.concatenate(x) for x in zip(*lanes))
        order = np.lexsort((place, lane))
        return self._with_bytes(points, lane[order], ids[order], place[order], len(words))

    def search(self, text: str, stride: int = STRIDE) -> Iterator[list[int]]:
        """Ids of one text, committed part by part; the state between the parts is that of one stride."""
        done, state = 0, {}
        while done < len(text):
            at = state[0].at if state else 0
            base = state[0].done if state else 0
            window = text[base : at + stride + self.longest]
            for s in state.values():
                s.at, s.done = at - base, 0
            points, out, after = _points(window), [], {}
            self._stride(points, np.zeros(1, np.int64), np.array([at - base]), np.array([len(text) - base]), stride, state, out, after, shown=len(window))
            for s in after.values():
                s.at, s.done = s.at + base, s.done + base
            if out:
                lane, ids, place = (np.concatenate(x) for x in zip(*out))
                order = np.argsort(place)
                yield self._with_bytes(points, lane[order], ids[order], place[order], 1)[0].tolist()
            state, done = after, after[0].done if after else len(text)

    def _stride(self, points, some, at, end, stride, state, lanes, open_lanes, shown: int | None = None) -> None:
        """Search on from ``at`` in the lanes ``some``; commit what is certain, and leave the state of lanes that are not through."""
        ahead = self.longest
        span = np.minimum(stride, end - at)
        if not len(some) or not span.max():
            return
        width = int(span.max()) + ahead + 1
        best = np.full((len(some), width), NEVER, np.int64)
        size, made = np.zeros((len(some), width), np.int16), np.full((len(some), width), -1, np.int32)
        best[:, 0] = 0
        for row, i in enumerate(some.tolist()):
            if i in state:
                s = state[i]
                best[row, : ahead + 1] = s.best
                size[row, 1 : ahead + 1], made[row, 1 : ahead + 1] = s.size[-ahead:], s.made[-ahead:]
        rows = np.repeat(np.arange(len(some)), span)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(span) - span, span)
        place, length, piece, score = self._starting(points, at[rows] + step, np.minimum(end[rows], len(points) if shown is None else shown))
        when = step[place]
        order = np.argsort(when.astype(np.uint16), kind="stable")
        row, when, length, piece, score = rows[place][order], when[order], length[order], piece[order], score[order]
        cuts = np.searchsorted(when, np.arange(int(span.max()) + 1))
        flat_best, flat_size, flat_made = best.ravel(), size.ravel(), made.ravel()
        source = row * width + when
        target = source + length
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # at most one piece of each length starts here in a lane
            reached = flat_best[source[lo:hi]] + score[lo:hi]
            better = reached > flat_best[target[lo:hi]]
            to = target[lo:hi][better]
            flat_best[to], flat_size[to], flat_made[to] = reached[better], length[lo:hi][better], piece[lo:hi][better]
        through = at + span == end
        for r in np.flatnonzero(~through).tolist():
            i = int(some[r])
            before = state.get(i)
            start = int(at[r])
            done = before.done if before else start
            sizes = np.concatenate([before.size[: start - done] if before else size[r, :0], size[r, 1 : int(span[r]) + ahead + 1]])
            ids = np.concatenate([before.made[: start - done] if before else made[r, :0], made[r, 1 : int(span[r]) + ahead + 1]])
            now = start + int(span[r])
            fronts = {now + k for k in range(ahead + 1) if best[r, int(span[r]) + k] > NEVER}
            while len(fronts) > 1:  # all open paths, the farthest going back, until they meet
                top = max(fronts)
                fronts.remove(top)
                fronts.add(max(top - int(sizes[top - done - 1]), done) if top > done else done)
            met = fronts.pop()
            self._commit(i, sizes, ids, done, met, lanes)
            open_lanes[i] = _Open(now, met, best[r, int(span[r]) : int(span[r]) + ahead + 1].copy(), sizes[met - done :], ids[met - done :])
        fresh = through & (span > 0)
        whole = np.flatnonzero(fresh & ~np.isin(some, list(state)) if state else fresh)
        spot, left = span[whole].copy(), whole
        while len(left):  # back from the ends of all lanes that are through
            taken = size[left, spot]
            lanes.append((some[left], made[left, spot], at[left] + spot))
            spot = spot - taken
            more = spot > 0
            left, spot = left[more], spot[more]
        for r in np.flatnonzero(through).tolist() if state else ():
            i = int(some[r])
            if i in state:
                s, start = state[i], int(at[r])
                sizes = np.concatenate([s.size[: start - s.done], size[r, 1 : int(span[r]) + 1]])
                ids = np.concatenate([s.made[: start - s.done], made[r, 1 : int(span[r]) + 1]])
                self._commit(i, sizes, ids, s.done, start + int(span[r]), lanes)

    @staticmethod
    def _commit(lane: int, sizes: np.ndarray, ids: np.ndarray, done: int, upto: int, lanes: list) -> None:
        places = []
        while upto > done:
            places.append(upto)
            upto -= int(sizes[upto - done - 1])
        if places:
            at = np.array(places, np.int64)
            lanes.append((np.full(len(at), lane, np.int64), ids[at - done - 1], at))

    def _with_bytes(self, points, lane, ids, place, n) -> tuple[np.ndarray, np.ndarray]:
        """The ids with bytes in place of characters that no piece covers, and how many each lane has."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids.astype(np.int32), np.bincount(lane, minlength=n)
        kinds, which = np.unique(points[place[bare] - 1], return_inverse=True)
        spelt = [[self.bytes[b] for b in {ESCAPED: SPACE, SPACE: " "}.get(chr(c), chr(c)).encode()] for c in kinds.tolist()]
        size = np.ones(len(ids), np.int64)
        size[bare] = np.array([len(s) for s in spelt], np.int64)[which]
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = np.fromiter(chain.from_iterable(spelt[k] for k in which.tolist()), np.int32)
        return out.astype(np.int32), np.bincount(lane, size, n).astype(np.int64)

    # -- texts ----------------------------------------------------------------------------

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.at, self.known = np.zeros(1, np.int64), np.empty(0, np.int32)

    def words(self, text: str) -> list[str]:
        """Parts of a text between boundaries that every path has; spaces as U+2581, one in front."""
        if not text:
            return []
        marked = SPACE + text.replace(SPACE, ESCAPED).replace(" ", SPACE)
        return _WORDS.findall(marked) if self.wordlike else [marked]

    def encode_batch(self, given: list[str], memo: int = MEMO, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        parts = [self.words(t) for t in given]
        words = list(chain.from_iterable(parts))
        where = np.fromiter([self.number.get(w, -1) for w in words], np.int64, len(words))
        absent = np.flatnonzero(where < 0)
        if len(self.number) >= memo and 2 * len(absent) > len(words) and self.number:
            self.forget()  # other words than before
            return self.encode_batch(given, memo, stride)
        missing = [words[i] for i in absent.tolist()]
        new = sorted(set(missing), key=len)  # short ones first: they are kept
        had = len(self.number)
        keep = min(len(new), max(0, memo - had))
        while keep and len(new[keep - 1]) > LONG:
            keep -= 1
        extra = dict(zip(new, range(had, had + len(new))))
        where[absent] = [extra[w] for w in missing]
        ids, sizes = self.search_all(new, stride)
        at, flat = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)]), np.concatenate([self.known, ids])
        size = at[where + 1] - at[where]
        ends = np.cumsum(size)
        taken = flat[np.repeat(at[where] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        owner = np.repeat(np.arange(len(given)), [len(p) for p in parts])
        self.number.update(zip(new[:keep], range(had, had + keep)))
        self.at = at[: had + keep + 1].copy()
        self.known = flat[: self.at[-1]].copy()
        return taken, np.bincount(owner, size, len(given)).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of many id lists (flat, with offsets); one leading space goes."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.flat[where].tobytes()
        out = []
        for lo, hi in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist()):
            text = data[lo:hi].decode()
            out.append(text[1:] if text.startswith(" ") else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


class _Open:
    """A lane between two strides: searched up to ``at``, committed up to ``done``.

    ``best``: scores of the boundaries from ``at`` on; ``size``, ``made``: the last piece of the best path to each boundary behind ``done``.
    """

    def __init__(self, at: int, done: int, best: np.ndarray, size: np.ndarray, made: np.ndarray):
        self.at, self.done, self.best, self.size, self.made = at, done, best, size, made


_LOADED: dict[str, Vocabulary] = {}  # of this worker


def load(path: str) -> Vocabulary:
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        control = frozenset(i for i in range(n) if model.is_control(i) or model.is_unused(i))
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
        normal = [s for i, (p, s) in enumerate(pieces) if i not in control and not model.is_unknown(i) and not model.is_byte(i)]
        if normal and all(float(s).is_integer() for s in normal):
            pieces = [(p, -math.log(max(0.0, -s) + 2)) for p, s in pieces]
        _LOADED[path] = Vocabulary(pieces, model.unk_id(), control)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, group: int = GROUP) -> DataFrame:
    """doc_id, n_ids, ids."""
    ddl = "_id bigint, n_ids bigint, ids array<int>"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)

        def made(keys: list, given: list[str]) -> pa.RecordBatch:
            ids, sizes = vocabulary.encode_batch(given)
            at = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)).cast(out.field(2).type)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), lists], schema=out)

        for batch in batches:
            keys, given, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(i)
                given.append(text.as_py())
                size += len(given[-1]) + 16
                if size >= group:
                    yield made(keys, given)
                    keys, given, size = [], [], 0
            if keys:
                yield made(keys, given)

    return texts(docs).mapInArrow(run, ddl).select(public_id().alias("doc_id"), "n_ids", "ids")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids and text, from ids."""
    ddl = "doc_id bigint, n_ids bigint, ids array<int>, text string"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(2)
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts_ = vocabulary.decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts_, pa.string())], schema=out)

    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(run, ddl)
