import json

import pytest

from tests.llm.helpers import result
from tracework.llm import chat

TURNS = [("system", "Be brief."), ("user", "Hello?"), ("assistant", "Hi.")]
LAYOUTS = {
    "messages": {"messages": [{"role": r, "content": t, "weight": 1} for r, t in TURNS], "id": 7},
    "from and value": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in TURNS]},
    "conversation": {"conversation": [{"role": r.upper(), "content": f" {t}\n"} for r, t in TURNS]},
    "dialog": {"dialog": [{"speaker": r, "text": t} for r, t in TURNS]},
    "prompt and completion": {"system": "Be brief.", "prompt": "Hello?", "completion": "Hi."},
    "prompt and response": {"system": "Be brief.", "prompt": "Hello?", "response": "Hi."},
    "question and answer": {"system": "Be brief.", "question": "Hello?", "answer": "Hi.", "source": {"url": "x"}},
    "instruction": {"system": "Be brief.", "instruction": "Hello?", "input": None, "output": "Hi."},
}


def test_layouts_give_the_same_turns(spark):
    rows = [(i, json.dumps(r), 1, "x") for i, r in enumerate(LAYOUTS.values())]
    out = result(chat.format_records(spark.createDataFrame(rows, "k long, body string, turn int, role string"), "k", "body"), "id", "turn")
    for i, name in enumerate(LAYOUTS):
        assert [(layout, r, t) for k, layout, _, _, r, t in out if k == i] == [(name, r, t) for r, t in TURNS]


def test_fingerprints():
    prints = {chat.fingerprint(chat.value_paths(r)) for r in LAYOUTS.values()}
    assert len(prints) == len(LAYOUTS) and prints <= set(chat.BY_FINGERPRINT)
    assert chat.fingerprint({"b", "messages[].role", "messages[].content"}) == chat.fingerprint({"messages[].content", "messages[].role"})
    instruction = {"instruction": "Add.", "input": "1 and 2", "output": "3"}
    assert chat.record_turns(instruction)[2] == [("user", "Add.\n1 and 2"), ("assistant", "3")]


def test_awkward_records(spark):
    rows = [(1, None), (2, ""), (3, "no json"), (4, "[1, 2]"), (5, "{}"), (6, '{"messages": []}'), (7, '{"prompt": "", "completion": " "}'), (None, '{"prompt": "a", "completion": "b"}'), (8, json.dumps({"prompt": "x" * 300_000, "completion": "y"})), (9, '{"messages": [{"role": null, "content": "t"}, {"role": "user", "content": 5}]}')]
    rows += [rows[-1]]
    out = result(chat.format_records(spark.createDataFrame(rows, "id long, body string"), "id", "body"))
    assert sorted(r[0] for r in out if r[1] is None) == [1, 2, 3, 4, 5, 6]
    assert not [r for r in out if r[0] == 7] and len([r for r in out if r[0] is None]) == 2
    assert [r[5] for r in out if r[0] == 9] == ["t\n5", "t\n5"] and max(len(r[5] or "") for r in out) == 300_000
    assert chat.format_records(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


def rows_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, at int, content int")


def test_rows(spark):
    rows = [(1, 2, "gpt", " b "), (1, 1, "Human", "a"), (1, 3, "assistant", "c"), (1, 4, None, "d"), (1, 5, "robot", "e"), (2, 1, "user", None), (2, 2, "user", ""), (2, 3, "tool", "é" * 100_000), (None, 1, "user", "x"), (3, None, "user", "first"), (3, 0, "user", "then"), (3, 0, "user", "then")]
    out = sorted(result(chat.format_rows(rows_table(spark, rows))), key=str)
    assert out == sorted([(1, 0, "user", "a"), (1, 1, "assistant", "b\nc"), (1, 2, "user", "d\ne"), (2, 0, "tool", "é" * 100_000), (None, 0, "user", "x"), (3, 0, "user", "first\nthen\nthen")], key=str)
    assert chat.format_rows(rows_table(spark, [])).count() == 0


def test_rows_match_a_plain_loop(spark):
    rows = [(c, t, "user" if (c * t) % 3 else "assistant", f"{c}-{t}") for c in range(30) for t in range(c % 7)]
    want = []
    for c in range(30):
        turns = chat.canonical((r, t) for k, _, r, t in rows if k == c)
        want += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    assert sorted(result(chat.format_rows(rows_table(spark, rows)))) == sorted(want)


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        chat.format_rows(spark.createDataFrame([], "a long, b string"))
