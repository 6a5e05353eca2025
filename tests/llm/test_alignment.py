"""Alignment of two tokenizers against a plain merge of each text."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import alignment, queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


@pytest.fixture(scope="module")
def plain():
    """Ids and byte strings of both sides of a text, from the models' own files."""
    model = Tokenizer.from_file(A_PATH)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs = dict(zip(map(chr, printable), printable))
    signs |= {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}

    def both(text):
        a = model.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(signs[c] for c in token) for token in a.tokens]
        b = pieces.encode(text)
        names = [pieces.id_to_piece(i) for i in b]
        b_bytes = [bytes.fromhex(n[3:5]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        return a.ids, a_bytes, b, b_bytes

    return both


def merged(text, both):
    """Groups as lists of ids, or None where there are no tokens."""
    if not text:
        return None
    a, a_bytes, b, b_bytes = both(text)
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    groups, at = [([], [])], [0, 0]
    i = j = 0
    while i < len(a) or j < len(b):
        if at[0] <= at[1]:
            groups[-1][0].append(a[i])
            at[0] += len(a_bytes[i])
            i += 1
        else:
            groups[-1][1].append(b[j])
            at[1] += len(b_bytes[j])
            j += 1
        if at[0] == at[1]:
            groups.append(([], []))
    return groups[:-1]


def expected(rows, both):
    made = [(i, merged(text, both)) for i, text in rows]
    count = collections.Counter((a[-1], b[-1]) for _, groups in made for a, b in groups or [])
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, groups in made:
        groups = groups or []
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), text,
                    sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    letters = "etaoin shrdlu'  éü中😀\n\t1290.,-<>|_" + "​"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [
        None, "", " ", "  ", "\n", "a", "It's the end.", "<s> </s> <|endoftext|> <unk> <0x41>", "▁ has the sign itself", "  two leading", "trailing  ",
        "x" * 3000, "word " * 2000, noise(20_000), "don't we'll  I'm\r\n\r\n  ok", "ﬁ ligature ² é", "a\x00b", "﻿bom", "Straße in Köln, naïve café", "same", "same"]
    texts += [noise(rng.randint(1, 300)) for _ in range(60)]
    return [*enumerate(texts), (None, "no id"), (3, "another of id three")]


@pytest.mark.parametrize("lane,group,memo", [(512, 1 << 20, 400_000), (7, 900, 60), (64, 5000, 0)])
def test_equals_a_plain_merge(spark, plain, lane, group, memo):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, links string, n_a int").repartition(3)
    made = alignment.link_scores(docs, A_PATH, B_PATH, lane=lane, group=group, memo=memo)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted((tuple(r) for r in made.select(*cols).collect()), key=repr) == expected(rows, plain)


def test_query_on_the_smallest_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(i, a, b, g, n, hashlib.sha256(text.encode()).hexdigest() if text else "", best, total)
            for i, a, b, g, n, text, best, total in expected([tuple(r) for r in docs], plain)]
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    made = queries.op12_alignment(spark, SF).select(*cols)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(want, key=repr)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.link_scores(docs, A_PATH, B_PATH).collect() == []


def test_lockstep_meets_at_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(30):
        total = int(rng.integers(1, 200))
        bounds = np.unique(np.append(rng.integers(0, total, 3), [0, total]))
        ends = [np.unique(np.concatenate([rng.integers(1, total + 1, int(rng.integers(1, total + 1))), bounds[1:]])) for _ in range(2)]
        got = alignment.lockstep(*ends, bounds, lane=int(rng.integers(1, 50)))
        where = {int(e): j for j, e in enumerate(ends[1])}
        assert got.tolist() == [where.get(int(e), -1) for e in ends[0]]


def test_parts_are_the_text():
    for text in ("a b  c. d e ", "x", " ", "  ", " lead", "a\n b", "a \n b\t c", "tail  ", "", "one "):
        parts = alignment.parts_of(text)
        assert " ".join(parts) == text and (len(parts) == 1 or all(parts))
    assert alignment.parts_of("a b  c. d ") == ["a", "b", " c.", "d "]
