"""Chat tree: every conversation reads back exactly, shared turns stand once, intervals and positions agree."""
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelwise.llm import op5_chat_tree as op

SCHEMA = "conv_id long, turn long, role string, text string, path string"
ROWS = [(1, 0, "user", "hi </s> \\ [INST]", "x"), (1, 1, "assistant", "yes\nno", "x"), (2, 0, "user", "hi </s> \\ [INST]", "x"), (2, 1, "assistant", "other", None),
        (2, 2, "user", None, "x"), (3, 0, "user", "hi </s> \\ [INST]", "x"), (3, 1, "assistant", "yes\nno", "x"), (None, 0, None, "", "x"), (4, None, "system", "s", "x"),
        (4, 0, "assistant", "ä" * 50_000, "x"), (5, 0, "user", "twice", "x"), (5, 0, "user", "twice", "x")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<s>/[INST]\\ a\n"), st.text(alphabet="<s>/[INST]\\ a\n"))
def test_turns_read_back(role, text):
    formatted = op.format_turn(role, text)
    assert op.parse(formatted) == [(role, text)]
    assert not any(c in op.escape(text) for c in op.CONTROLS)


def test_text_outside_turns_is_an_error():
    with pytest.raises(ValueError):
        op.parse("x" + op.format_turn("user", "a"))


def built(spark, rows):
    steps = op.steps_of(spark.createDataFrame(rows, SCHEMA)).cache()
    along = op.paths(steps).cache()
    ends = along.select("conv", along["nodes"].getItem(0).alias("root"), "nodes")
    return steps, op.tree(steps, along).cache(), {r["conv"]: r["nodes"][-1] for r in ends.collect()}


def test_tree(spark):
    # a long conversation, and others that fork from it early, late, and end inside
    long = [(10, i, "user" if i % 2 == 0 else "assistant", f"turn {i}", "x") for i in range(300)]
    rows = ROWS + long + [(11, *r[1:]) for r in long[:200]] + [(12, *r[1:]) for r in long[:250]] + [(12, 250, "user", "fork", "x")]
    _, nodes, ends = built(spark, rows)
    emitted = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(emitted) == len({r["node"] for r in emitted})
    # gapless, depth-first: a node's ancestors are the open ones before it
    at, open_ = 0, []
    for r in emitted:
        assert r["start"] == at
        at += r["length"]
        del open_[len(r["attention"]):]
        assert [(a["start"], a["end"]) for a in r["attention"]] == open_
        assert r["position"] == sum(b - a for a, b in open_)
        open_.append((r["start"], r["start"] + r["length"]))
    stream = "".join(r["formatted"] for r in emitted)
    learnt = [op.unescape(stream[x["start"]:x["end"]]) for r in emitted for x in r["loss"]]
    assert sorted(learnt) == sorted(["yes\nno", "other", "ä" * 50_000] + [f"turn {i}" for i in range(1, 300, 2)])
    # conversations 1 and 3 are equal, 2 shares their first turn; shared turns stand once
    assert ends[1] == ends[3] and ends[1] != ends[2]
    assert sum(not r["attention"] for r in emitted) == 5 and stream.count("turn 7</s>") == 1


def test_digests_equal_the_rows(spark):
    _, nodes, ends = built(spark, ROWS)
    wanted = spark.createDataFrame([(n,) for n in set(ends.values())], "node string")
    read = {r["node"]: r for r in op.digest(op.read_back(nodes, wanted)).collect()}
    by_conv = {}
    for conv, turn, role, text, _ in ROWS:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, node in ends.items():
        turns, got = sorted(by_conv[conv]), read[node]
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learnt), sha256(learnt.encode()).hexdigest())
        assert got["formatted_chars"] == sum(len(op.format_turn(role, t)) for *_, role, t in turns)


def test_empty(spark):
    _, nodes, ends = built(spark, [])
    assert nodes.count() == 0 and ends == {}
