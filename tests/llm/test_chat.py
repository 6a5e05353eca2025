"""Templates that break their promise late, long conversations, clashing columns."""

from __future__ import annotations

import pytest

from barloom.llm import chat

DDL = "conv_id bigint, turn bigint, role string, text string, added string, start int, n int"


def conversation(spark, turns, conv=1):
    return spark.createDataFrame([(conv, i, "user" if i % 2 == 0 else "assistant", f"text {i}", "x", 1, 2) for i in range(turns)], DDL)


def last_turns(k):
    return chat.Template(lambda turns: chat.instruct(turns[-k:]), chat.escape, context=1)


@pytest.mark.parametrize("k,turns", [(20, 40), (20, 21), (13, 14), (60, 100), (15, 16)])
def test_history_that_is_cut_late_is_found(spark, k, turns):
    with pytest.raises(Exception, match="depends on more than 1 earlier turns"):
        chat.format_turns(conversation(spark, turns), last_turns(k)).collect()


def test_history_that_is_not_cut_yet_is_fine(spark):
    rows = chat.format_turns(conversation(spark, 40), last_turns(40)).collect()
    assert len(rows) == 40 and not any(r["rewrites"] for r in rows)


def test_rewriting_without_a_promise_is_flagged(spark):
    cut = chat.Template(lambda turns: chat.instruct(turns[-20:]), chat.escape)
    rows = chat.format_turns(conversation(spark, 40), cut).collect()
    assert sum(r["rewrites"] for r in rows) == 20
    out = ""
    for r in rows:
        out = out[: r["keep"]] + r["added"]
    assert out == cut.render([("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(20, 40)])


def test_long_conversations_and_texts(spark, monkeypatch):
    monkeypatch.setattr(chat, "KEPT", 64)
    turns = [(1, i, "user", "x" * 200_000 if i == 3 else f"t {i}", None, None, None) for i in range(700)]
    many = spark.createDataFrame(turns, DDL).unionByName(conversation(spark, 300, conv=2)).unionByName(conversation(spark, 2, conv=None))
    rows = chat.format_turns(many).collect()
    assert len(rows) == 1002
    text = "".join(r["added"] for r in rows if r["conv_id"] == 1)
    assert [t for _, t in chat.read_turns(text)] == [t[3] for t in turns]
    assert chat.format_turns(many.limit(0)).collect() == []
