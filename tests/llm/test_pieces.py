"""The piece search against a plain dynamic program, and round trips through the model's own decoder."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from barloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def plain(v, text):
    """Best path by the whole table, the earliest last piece among equals."""
    best, back = [0] + [None] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            score = v.scores.get(text[i:j], v.fallback if j == i + 1 else None)
            if score is not None and (best[j] is None or best[i] + score > best[j]):
                best[j], back[j] = best[i] + score, i
    parts, j = [], len(text)
    while j:
        parts.append(text[back[j] : j])
        j = back[j]
    return [i for p in parts[::-1] for i in ([v.ids[p]] if p in v.ids else [v.bytes[b] for b in {pieces.ESCAPED: pieces.SPACE, pieces.SPACE: " "}.get(p, p).encode()])]


def noise(rng, n):
    return "".join(rng.choice("▁etaoinshrdlu é中x" + pieces.ESCAPED) for _ in range(n))


@pytest.mark.parametrize("stride", [1, 5, 16, 256])
def test_strides_commit_the_best_path(stride):
    v, rng = pieces.load(PATH), random.Random(stride)
    words = [noise(rng, rng.randint(1, 150)) for _ in range(40)] + ["▁the", "x" * 300, "ab" * 200, "", "▁"]
    ids, count = v.search_all(words, stride)
    at = np.concatenate([[0], np.cumsum(count)])
    for word, lo, hi in zip(words, at[:-1], at[1:]):
        assert ids[lo:hi].tolist() == plain(v, word)
        if word:
            parts = list(v.search(word, stride))
            assert [i for p in parts for i in p] == plain(v, word)
            # Paths of a repeated letter may run side by side to the end; others meet on the way.
            assert stride > 16 or len(word) < 100 or len(set(word)) < 3 or len(parts) > 1


def test_a_long_text_is_committed_as_it_goes():
    v, rng = pieces.load(PATH), random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))  # no word boundary
    states = []
    stride = pieces.Vocabulary._stride

    def watched(self, points, some, at, end, step, state, lanes, after, shown=None):
        stride(self, points, some, at, end, step, state, lanes, after, shown)
        states.extend((len(s.size), len(points)) for s in after.values())

    pieces.Vocabulary._stride = watched
    try:
        ids = [i for part in v.search(text) for i in part]
    finally:
        pieces.Vocabulary._stride = stride
    assert max(s for s, _ in states) < 200 and max(p for _, p in states) < 600  # what is kept does not grow with the text
    assert ids == plain(v, text)


def test_ties_fall_alike():
    v = pieces.Vocabulary([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]])
    for n in range(1, 30):
        for stride in (1, 2, 7):
            assert [i for p in v.search("a" * n, stride) for i in p] == plain(v, "a" * n)
    empty = pieces.Vocabulary([("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]])
    assert empty.decode(empty.encode("é x")) == "é x"


@pytest.mark.parametrize("memo", [0, 30, 200_000])
def test_the_memo_changes_nothing(memo):
    v, rng = pieces.load(PATH), random.Random(4)
    words = [noise(rng, rng.randint(1, 9)).replace("▁", "") for _ in range(60)]
    v.forget()
    for _ in range(6):
        given = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).replace(pieces.ESCAPED, "▁") for _ in range(8)]
        ids, count = v.encode_batch(given, memo)
        at = np.concatenate([[0], np.cumsum(count)])
        for text, lo, hi in zip(given, at[:-1], at[1:]):
            marked = pieces.SPACE + text.replace(pieces.SPACE, pieces.ESCAPED).replace(" ", pieces.SPACE)
            assert ids[lo:hi].tolist() == (plain(v, marked) if text else [])
    assert len(v.number) <= max(memo, 0)
    v.forget()


def test_the_models_decoder_gives_the_text_back(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    texts = [None, "", " ", "  a  b ", "Hello world", "x" * 5000, "tab\tand\nlines\r\n", "é 日本 𝄞 ​", "▁ itself ▁▁", "same", "same", " private"]
    texts += ["".join(rng.choice("ab cé日\n") for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, _id int").repartition(3)
    back = pieces.decode_documents(pieces.encode_documents(docs, PATH, group=50), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    for r in back:
        assert r["n_ids"] == len(r["ids"])
        if "▁" not in r["text"]:
            assert own.decode(r["ids"]) == r["text"]
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_query_on_the_smallest_table(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    v = pieces.load(PATH)
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pieces(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        assert own.decode(r["ids"]) == text[r["doc_id"]]
    for r in rows[:25]:
        assert r["ids"] == plain(v, "▁" + text[r["doc_id"]].replace(" ", "▁"))
