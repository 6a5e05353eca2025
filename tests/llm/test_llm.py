"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import chat, components, fingerprints, knn, lines, near, packing, phrases, pieces, quality, queries, warc
from barloom.llm.common import Stored
from barloom.llm.rolling import shared, sliding_first_minimum

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def corpus(spark):
    """Null and empty texts, ties, copies, near copies, a long text, a null id, clashing columns."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    base = prose(120)
    near_copy = base.split()
    near_copy[60] = "other"
    rows = [
        (1, base), (2, base), (3, " ".join(near_copy)), (4, None), (5, ""), (6, "  \n "), (7, "ab"), (8, prose(3)),
        (9, prose(40) + "\n" + passage + "\n" + prose(30)), (10, prose(20) + "\n" + passage), (11, "xy " * 300), (12, prose(6000)),
        (13, "one line of forty characters, more or less\nshort"), (14, "one line of forty characterz, more or les\nshort"),
        (15, "one line of forty characters, more or less"), (None, prose(25)), (20, prose(15)),
    ]
    return spark.createDataFrame(
        [(i, t, "en", 7, 1, 2, "k") for i, t in rows], "doc_id bigint, text string, lang string, n_chars bigint, _id int, _h int, _key string")


EMPTY = "doc_id bigint, text string, lang string, n_chars bigint"


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts_of(docs):
    """(order key, id, text) in document order."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


# -- hashes -------------------------------------------------------------------------------


def test_equal_substrings_have_equal_hashes():
    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    h = shared(5)
    sums = h.prefix(data)
    assert h.of(sums, np.array([0]), np.array([3]))[0] == h.of(sums, np.array([9]), np.array([12]))[0]
    assert h.of(sums, np.array([0]), np.array([3]))[0] != h.of(sums, np.array([6]), np.array([9]))[0]
    seen = h.windows(sums, 4)
    assert len(set(seen.tolist())) == len({bytes(data[i : i + 4]) for i in range(len(data) - 3)})
    first = sliding_first_minimum(seen, 7)
    low = seen & ~np.uint64((1 << 24) - 1)
    assert first.tolist() == [i + int(low[i : i + 7].argmin()) for i in range(len(seen) - 6)]


# -- 1 ------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_edges(spark):
    docs = corpus(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {(round(r["score"], 9), r["predicted"]) for r in quality.quality_scores(docs, none).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(1, 1), (3, None), (None, 0), (99, 0)], "doc_id bigint, quality int")
    rows = quality.quality_scores(docs, one).collect()
    assert len(rows) == 17 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_scores(spark.createDataFrame([], EMPTY), one).count() == 0
    level = quality.pool(np.array([5.0, 5, 5, 5]), np.array([0.0, 3, 2, 5]))
    assert (np.diff(level) >= 0).all() and level[1] == level[2]


# -- 2 ------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=6)
    rows = [(i, [float(x) for x in (hot if i % 3 == 0 else rng.normal(size=6))]) for i in range(700)]
    rows += [(700, None), (701, [1.0, None, 2.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (705, [3.0, 1.0]), rows[5], (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = knn.top_inner(df, F.col("vec_id") % 50 == 0, pivots=8, block=4, shard=100).collect()
    data = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = np.zeros(6)
            x[: len(v)] = np.floor(np.array(v, np.float32).astype(float) * 256)
            data[i] = x
    want = []
    for q in sorted(data):
        if q % 50 == 0:
            best = sorted((-int(data[q] @ x), i) for i, x in data.items() if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == want
    assert knn.top_inner(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


# -- 3 ------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "[", "a", "\n", "é"]
    turns = [(1, i, rng.choice(["user", "assistant", "system", "tool]x", ""]), "".join(rng.choice(bits) for _ in range(8))) for i in range(60)]
    turns += [(2, 0, None, None), (2, 0, "user", "tie"), (3, None, "assistant", ""), (None, 0, "user", "no conversation")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = collections.defaultdict(list)
    for r in chat.format_turns(df).collect():
        rows[r["conv_id"]].append(r)
    for conv, found in rows.items():
        text = "".join(r["added"] for r in found)
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert text == chat.instruct([(r, t) for _, _, r, t in mine])
        assert list(chat.read_turns(text)) == [(r, t) for _, _, r, t in mine]
        assert [chat.unescape(text[r["text_start"] : r["text_end"]]) for r in found] == [t for *_, t in mine]
    assert chat.format_turns(df.where("false")).count() == 0


def test_rewriting_templates_are_found(spark):
    late = chat.Template(lambda ts: "".join(f"{r}:{t};" for r, t in ts[:-1][-1:] and ts[-1:] or ts))
    df = spark.createDataFrame([(1, i, "user", str(i)) for i in range(4)], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.format_turns(df, late).collect()
    out = ""
    for r in rows:
        out = out[: r["keep"]] + r["added"]
    assert any(r["rewrites"] for r in rows) and out == late.render([("user", str(i)) for i in range(4)])
    broken = chat.Template(lambda ts: f"{len(ts)}" + "".join(t for _, t in ts), context=1)
    with pytest.raises(Exception, match="depends on more"):
        chat.format_turns(df, broken).collect()


# -- 4 ------------------------------------------------------------------------------------


def test_packing_covers_every_token_once(spark):
    docs = corpus(spark).unionByName(corpus(spark).where("doc_id = 7"))
    rows = packing.pack_documents(docs, WORD_BPE, length=64, with_ids=True).collect()
    encode = Tokenizer.from_file(WORD_BPE).encode
    want = collections.Counter((r["doc_id"], tuple(encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    sequences = collections.defaultdict(list)
    per_doc = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for spans in sequences.values():
        ends = 0
        for offset, n in sorted(spans):
            assert offset == ends
            ends += n
        assert ends <= 64
    for (i, ids), times in want.items():
        if times == 1:
            parts = sorted(per_doc[i], key=lambda r: r["start"])
            assert sum((r["ids"] for r in parts), []) == list(ids) and {r["doc_tokens"] for r in parts} == {len(ids)}
        else:
            assert sorted(tuple(r["ids"]) for r in per_doc[i]) == [ids] * times
    assert packing.pack_documents(spark.createDataFrame([], EMPTY), WORD_BPE).count() == 0


def test_plan_holds_the_demand_and_pads_little():
    rng = np.random.default_rng(3)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 200, 64)
    used, cut = packing.plan(sizes, demand, 64)
    held = sum(p * n for p, n in used)
    want = demand - cut
    for j in np.flatnonzero(cut):
        want[sizes[j] - 32 - 1] += cut[j]
        want[32 - 1] += cut[j]
    assert (held == want).all() and all(p @ sizes <= 64 for p, _ in used)
    assert (demand @ sizes) / (64 * sum(n for _, n in used)) > 0.97


def test_encoder_equals_the_tokenizer():
    encode, ours = Tokenizer.from_file(WORD_BPE).encode, packing.Encoder(WORD_BPE, memo=8)
    for text in ["a\x1cb c", "<|endoftext|> x", "Don't I'm 12.5% ß É ÿŸ", "x y　z\x85w", "é é.", "a,.b ., ..", "", "µº ª", "Ab cd. " * 40]:
        assert ours(text) == np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# -- 5 ------------------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, text in rows:
        body = text.encode()
        gone = bytearray(len(body))
        for j in range(len(body) - length + 1):
            w = body[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [phrases.MANY, 2])
def test_repeats_equal_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(phrases, "MANY", many)
    docs = corpus(spark)
    got = sorted((tuple(r) for r in phrases.repeat_digest(docs).collect()), key=str)
    assert got == sorted(brute_repeats(texts_of(docs)), key=str)


def test_repeats_on_a_given_table_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(tuple(r) for r in queries.op5_phrase_dedup(spark, "/root/testdata/sf0.001").collect()) == sorted(brute_repeats(texts_of(docs)))
    twice = spark.createDataFrame([(1, "a" * 150), (1, "a" * 150), (1, "b" * 20)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in phrases.repeat_digest(twice).collect()) == [0, 149, 149]
    assert phrases.repeat_digest(twice).count() == 3
    assert phrases.repeat_digest(spark.createDataFrame([], EMPTY)).count() == 0
    data = np.frombuffer(b"abracadabra" * 30, np.uint8)
    starts = np.arange(len(data) - 20)
    ranks = phrases.suffix_ranks(data, starts, 20)
    assert (np.argsort(ranks, kind="stable") == sorted(starts, key=lambda s: (bytes(data[s : s + 20]), s))).all()


# -- 6 ------------------------------------------------------------------------------------


def test_fingerprints(spark):
    docs = corpus(spark)
    rows = as_dict(fingerprints.compare_with_next(docs))
    order = texts_of(docs)
    for (i, text), (_, follow) in zip(order, order[1:] + order[:1]):
        r = rows[i]
        new = fingerprints.edited(text, follow).encode()
        own, other, nxt = fingerprints.sketches([text.encode(), new, follow.encode()])
        assert r["edited_sha256"] == hashlib.sha256(new).hexdigest() and r["n_chars"] == len(text)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.to_text(own), fingerprints.to_text(other))
        assert r["near_edited"] == fingerprints.likeness(own, other) and r["near_next"] == fingerprints.likeness(own, nxt)
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[4]["fingerprint"] == ""
    a, b = fingerprints.sketches([b"abcdefghij" * 3 + bytes(range(200)), bytes(range(200)) + b"zz" * 40])
    assert set(fingerprints.merge(a, b)) == set(a) | set(b)
    assert fingerprints.compare_with_next(spark.createDataFrame([], EMPTY)).count() == 0
    long = spark.createDataFrame([(1, "x y z w v " * 50_000), (2, "q")], "doc_id bigint, text string")
    assert fingerprints.compare_with_next(long).count() == 2


# -- 7 ------------------------------------------------------------------------------------


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            if rng.random() < 0.4:
                b.insert(p, rng.choice(b"abc"))
            elif p < len(b):
                del b[p]
        for k in range(4):
            assert lines.within(a, bytes(b), k) == (lines._plain(a, bytes(b)) <= k)


def test_lines_equal_brute_force(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.repeated_lines(docs).collect()}
    found = []
    for i, text in texts_of(docs):
        for n, line in enumerate(text.encode().split(b"\n")):
            if len(line.strip()) >= lines.MIN_BYTES:
                found.append((i, n, line.strip()))
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][2], found[b][2]
            edits = min(2, min(len(x), len(y)) // 10)  # one for each ten bytes of the shorter line, two at most
            if x == y or edits and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = collections.defaultdict(list)
    for a, (i, n, _) in enumerate(found):
        if root(a) != a:
            want[i].append((n, *found[root(a)][:2]))
    assert got == {i: want.get(i, []) for i in got}
    assert got[14] == [(0, 13, 0), (1, 13, 1)] and got[15] == [(0, 13, 0)]
    kept = as_dict(lines.drop_repeated_lines(docs))
    assert kept[14]["text"] == "" and kept[14]["n_chars"] == 0 and kept[13]["text"].startswith("one") and set(kept) == set(got)
    assert lines.repeated_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_short_lines_are_classed(spark):
    rng = random.Random(9)
    made = ["}", "{", "ab", "é", "12 pages", "13 pages", "a heading", "a headinG", "one more heading", "one more heading.", "twenty bytes of text", "twenty byte of texts"]
    for n in (9, 10, 11, 19, 20, 21, 29, 30, 31, 32, 33):
        base = [rng.choice("abcd ") for _ in range(n - 2)]
        for edits in range(4):
            one = list(base)
            for _ in range(edits):
                p = rng.randrange(len(one))
                one[p : p + 1] = rng.choice([[], [rng.choice("xyz")], [one[p], rng.choice("xyz")]])
            made.append("q" + "".join(one) + "q")
    rows = [(i, "\n".join(rng.choice(made) for _ in range(rng.randint(1, 6)))) for i in range(90)] + [(90, " }\t\n\n}"), (91, "}"), (92, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(i, n, line.strip()) for i, text in rows for n, line in enumerate(text.encode().split(b"\n")) if line.strip()]
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, _, s) in enumerate(found):
        for b, (_, _, t) in enumerate(found[:a]):
            if s == t or lines._plain(s, t) <= min(2, len(s) // 10, len(t) // 10):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = collections.defaultdict(list)
    for a, (i, n, _) in enumerate(found):
        if root(a) != a:
            want[i].append((n, *found[root(a)][:2]))
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.repeated_lines(docs).collect()}
    assert got == {i: want.get(i, []) for i, _ in rows}
    assert len(got[90]) == 2 and len(got[91]) == 1 and got[92] == []


# -- 8 ------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i % 7}", ("p" * 120 if i % 3 == 0 else "é\r\n\r\n" * i)) for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (2, "u2", "other page, same id"), rows[4], (None, "n", "p" * 120)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages, archive_bytes=1500).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert len(got) == len(rows)
    assert [(g[0], g[1], g[2]) for g in got] == sorted(
        ((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows), key=str)
    assert all(g[3] == "response" for g in got if g[1] < 100)
    assert sum(g[3] == "response" for g in got if g[1] == 120 and g[2] == hashlib.sha256(b"p" * 120).hexdigest()) == 1
    assert warc.archive_round_trip(pages.where("false")).count() == 0


# -- 9 ------------------------------------------------------------------------------------


def test_pieces_round_trip_and_best_score(spark):
    v = pieces.load(PIECES)
    for text in ["Hello world", " a  b\n\tc", "▁x ▁", " z", "é日本 𝄞", "", " ", "ab" * 500]:
        assert v.decode(v.encode(text)) == text

    def best(text):
        b = [0] + [None] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + v.longest) + 1):
                s = v.scores.get(text[i:j], v.fallback if j == i + 1 else None)
                if s is not None and (b[j] is None or b[i] + s > b[j]):
                    b[j] = b[i] + s
        return b[-1]

    names = {i: p for p, i in v.ids.items()}
    for text in ["the quick brown fox", "unbelievable   spaces", "x" * 300, "ciónmente adoado"]:
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert sum(v.scores[names[i]] for i in v.encode(text)) == best(marked)
        assert [i for part in v.search(marked) for i in part] == v.encode(text)
    docs = corpus(spark)
    back = pieces.decode_documents(pieces.encode_documents(docs, PIECES), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())


# -- 10 -----------------------------------------------------------------------------------


def labelled(text):
    words, seen, out = text.split(), collections.Counter(), []
    for i in range(max(1, len(words) - 4) if words else 0):
        k = tuple(words[i : i + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = texts_of(docs)
    sets = {i: set(labelled(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if not either or both >= 0.8 * either:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in sets}


def test_near_duplicate_edges(spark):
    rows = as_dict(near.near_duplicates(corpus(spark)))
    assert {i: r["class_id"] for i, r in rows.items() if i in (1, 2, 3, 4, 5, 6)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert rows[None]["is_first"] and sum(r["is_first"] for r in rows.values()) == len(rows) - 5
    assert near.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    a, b = np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64)
    assert near.aligned(a, b, 0.8) and not near.aligned(a, b[::-1].copy(), 0.8) and near.aligned(a, b[3:], 0.8) and not near.aligned(a, b[12:], 0.8)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (200, 200)]
    found = dict(components.components(spark.createDataFrame(edges, "_a bigint, _b bigint"), Stored(spark)).collect())
    assert {found[i] for i in range(41)} == {0} and found[100] == found[70] == 50 and 200 not in found


# -- pipeline -----------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store, inputs = Stored(spark), [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(store.keep(stage(spark, inputs[-1], sf)))
        if name != "packing":
            assert inputs[-1].columns == docs.columns
    good = {r["doc_id"] for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in inputs[1].collect()} == good
    gone = {r["doc_id"]: {x["line"] for x in r["removed"]} for r in lines.repeated_lines(inputs[1]).collect()}
    after = {r["doc_id"]: r["text"] for r in inputs[2].collect()}
    for i, text in texts_of(inputs[1]):
        assert after[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i])
    first = {r["doc_id"] for r in near.near_duplicates(inputs[2]).where("is_first").collect()}
    assert {r["doc_id"] for r in inputs[3].collect()} == first
    want = {i: n - m for i, n, m, *_ in brute_repeats(texts_of(inputs[3]))}
    assert all(0 <= want[r["doc_id"]] - len((r["text"] or "").encode()) <= 8 for r in inputs[4].collect())
    ids = collections.Counter()
    for r in inputs[5].collect():
        ids[r["doc_id"]] += r["length"]
    encode = Tokenizer.from_file(WORD_BPE).encode
    assert ids == {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in texts_of(inputs[4])}
    assert corpus_pipeline.run(spark, sf).count() == inputs[5].count()


def test_each_stage_keeps_python_small_by_itself(spark, tmp_path, monkeypatch):
    """Stages are also run one by one, without ``run``."""
    setting, seen = corpus_pipeline.BATCH_SETTING, []
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for module, name in ((quality, "keep_good"), (lines, "drop_repeated_lines"), (near, "keep_first"), (phrases, "without_repeats"), (packing, "pack_documents")):
        monkeypatch.setattr(module, name, lambda *a, **settings: seen.append((int(spark.conf.get(setting)), settings.get("memo"))))
    usual = spark.conf.get(setting)
    try:
        for given, want in (("10000", 1000), ("0", 1000), ("70", 70)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(setting, given)
                stage(spark, docs, str(tmp_path))
            assert [x[0] for x in seen[-5:]] == [want] * 5 and seen[-1][1] < packing.MEMO
    finally:
        spark.conf.set(setting, usual)
    small = packing.encoder(WORD_BPE, 8)
    assert small is not packing.encoder(WORD_BPE) and small.known.most == 8


def test_parities_never_rule_out_an_alignment():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    seqs = [base[:0]]
    for edits in range(80):
        one = base.copy()
        one[rng.choice(300, edits, replace=False)] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
        seqs.append(one[rng.integers(0, 20):])
    odd = near.parities(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
    ruled_out = 0
    for a, p in zip(seqs, odd):
        for b, q in zip(seqs, odd):
            fits = int(np.bitwise_count(p ^ q).sum()) <= (len(a) + len(b)) * (0.2 / 1.8) + 1e-6
            assert fits or not near.aligned(a, b, 0.8)
            ruled_out += not fits
    assert ruled_out > 1000 and not odd[0].any()
