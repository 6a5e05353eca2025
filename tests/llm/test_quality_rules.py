"""Cross-document line frequency against plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import line_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DDL = "doc_id bigint, text string, source string, _id int, _h string, _line int, _words int, kept int"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def of_one_text(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def plain(line):
    return re.sub("[\x20\x09-\x0d]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def brute_force(rows, min_docs, share, left):
    docs, holders = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, host in rows:
        docs[host or ""].add(i)
        for line in (text or "").split("\n"):
            if plain(line):
                holders[host or "", plain(line)].add(i)
    out = []
    for i, text, host in rows:
        text, host = text or "", host or ""
        counts = of_one_text(text)
        hit = [n for n, line in enumerate(text.split("\n")) if plain(line)
               and len(holders[host, plain(line)]) > max(min_docs, share * len(docs[host]))]
        gone = sum(len(WORD.findall(text.split("\n")[n])) for n in hit)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        rest = counts[0] - gone
        out.append((i, *counts, failed, tuple(hit), gone, not failed and rest >= 50 and rest >= left * counts[0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "h", 2, 3, 4) for i, t, s in rows], DDL)


def results(docs, **options):
    made = line_rules.verdicts(docs, **options).collect()
    return [(r["doc_id"], *[r[c] for c in COUNTS], r["base_failed"], tuple(r["removed"]), r["removed_words"], r["kept"]) for r in made]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß中#$") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    menu, footer = line(30), line(9)
    rows = []
    for i in range(60):
        text = "\n".join([line(rng.randint(1, 25)) for _ in range(rng.randint(1, 9))])
        if i % 2:
            text = menu.upper() + "\n" + text + "\n  " + footer.replace(" ", " \t") + "  "
        rows.append((i, text, "hot" if i % 3 else f"h{i % 4}"))
    return rows + [
        (100, None, "hot"), (101, "", "hot"), (102, " \n\t\n", None), (103, "a b c a b c a b\nc", None), (None, menu + "\n" + line(60), "hot"),
        (None, footer, "hot"), (105, line(70), "hot"), (105, line(70), "hot"), (106, menu, "hot"), (106, menu, "hot"), (107, "x " * 3000, "h1"),
        (108, line(4000) + "\n" + "one\x1cword\x85here\xa0too", "h1"), (109, "\n".join([line(8)] * 12), "h2"), (110, "a b", "h2"), (111, "a b c", "h2")]


def test_equals_brute_force(spark):
    rows = corpus()
    for options in (dict(min_docs=5, share=0.1, left=0.5), dict(min_docs=2, share=0.4, left=0.9)):
        got = results(frame(spark, rows).repartition(5), **options)
        assert sorted(got, key=key) == sorted(brute_force(rows, **options), key=key)
        assert any(r[7] for r in got) and any(r[-1] for r in got) and any(r[7] and not r[6] and not r[-1] for r in got)


def test_keys_taken_apart_by_weight_give_the_same_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 30)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("w"))
    whole = sorted(tuple(r) for r in left.join(right, ["k"]).collect())
    for parts in (1, 3, 10_000):
        assert sorted(tuple(r) for r in line_rules.join_by_weight(left, right, ["k"], "w", 78, parts).collect()) == whole


def test_cleaned_documents_keep_their_columns_and_lose_frequent_lines(spark):
    rows = corpus()
    options = dict(min_docs=5, share=0.1, left=0.5)
    want = sorted(
        (i, "\n".join(line for n, line in enumerate(text.split("\n")) if n not in r[7]), host)
        for (i, text, host), r in zip(rows, brute_force(rows, **options)) if r[-1] and i is not None)
    docs = frame(spark, rows)
    made = line_rules.clean_documents(docs, **options)
    assert made.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in made.collect() if r["doc_id"] is not None) == want


def test_no_documents(spark):
    assert results(frame(spark, [])) == []
    assert line_rules.clean_documents(frame(spark, [])).collect() == []


def test_main_path_has_no_python(spark):
    text = line_rules.verdicts(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in text and "Python" not in text
