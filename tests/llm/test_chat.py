"""Layouts found by their paths, and turns that come back whole from the formatted text."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rideledger.llm import chat

CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\|im_end|>", "<\\\\|im_sep|>", "[\\INST]", "\\", "<", "é🙂", "\n", "$1", "{\"a\": [1]}", '"']
PIECES = st.lists(st.sampled_from([*CONTROL, "user", "text ", ""]), max_size=6).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "human", "gpt"]), PIECES, st.none()), st.one_of(PIECES, st.none())), max_size=4), min_size=1, max_size=40))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = chat.canonical_json(chat.as_json(chat.records(df)), "record", ("conv_id",))
    out = chat.format_turns(found).select("conv_id", "layout", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.read], r.loss) for r in out.collect()}
    want = {c: [(role or "", text or "") for role, text in turns] for c, turns in enumerate(conversations) if turns}
    assert got == {c: (turns, "".join(text for role, text in turns if role == "assistant")) for c, turns in want.items()}


def test_layouts(spark):
    user, assistant = ("user", "u"), ("assistant", "a")
    cases = [
        ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, "messages", [user, assistant]),
        ({"messages": [{"role": "user", "text": "u", "name": "n"}], "id": 7, "meta": {"x": [1]}}, "messages_text", [user]),
        ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}, {"from": "x", "value": None}]}, "conversations", [user, assistant, ("x", "")]),
        ({"prompt": "u", "response": "a"}, "prompt_response", [user, assistant]),
        ({"completion": "a", "prompt": "u"}, "prompt_completion", [user, assistant]),
        ({"system": "s", "prompt": "u", "response": "a"}, "system_prompt_response", [("system", "s"), user, assistant]),
        ({"instruction": "u", "output": "a"}, "instruction_output", [user, assistant]),
        ({"instruction": "u", "input": "[1]", "output": None}, "instruction_input_output", [user, ("user", "[1]"), ("assistant", "")]),
        ({"question": "u", "answer": "[{\"role\": 1}]", "prompts": 1}, "question_answer", [user, ("assistant", "[{\"role\": 1}]")]),
        ({"messages": []}, "no_messages", []),
        ({"prompt": "u", "output": "a"}, None, None),
        ({}, None, None),
        ({"messages": "u"}, None, None),
    ]
    rows = [(i, json.dumps(record), "kept") for i, (record, _, _) in enumerate(cases)] + [(90, "oops", "kept"), (91, None, "kept"), (92, "[1]", "kept")]
    df = spark.createDataFrame(rows, "n long, record string, layout string")
    got = {r.n: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns], r.fingerprint) for r in chat.canonical_json(df, "record", ("n", "layout")).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i][:2] == (layout, turns), cases[i]
        assert got[i][2] is not None
    assert [got[i] for i in (90, 91, 92)] == [(None, None, None)] * 3
    assert got[0][2] == hashlib.sha256(b"messages[].content\nmessages[].role").hexdigest()


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", None, 5)], "id long, prompt string, response string, turns long")
    row = chat.canonical_table(df, ("id", "turns")).first()
    assert row.layout == "prompt_response" and [tuple(t) for t in row.turns] == [("user", "u"), ("assistant", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_table(df.select("id", "prompt"), ("id",))


def test_query_uses_many_layouts(spark, tmp_path):
    rows = [(c, t, role, f"{role} {c}") for c in range(60) for t, role in enumerate(["system", "user", "assistant"][c % 2 : 3])]
    df = spark.createDataFrame([*rows, (None, 1, None, None)], "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    layouts = chat.canonical_json(chat.as_json(chat.records(df)), "record").select("layout").distinct().collect()
    assert len(layouts) >= 6 and None not in {r.layout for r in layouts}
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert len(got) == 62 and got[None].n_turns == 1
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(chat.PLANTED.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nuser 1\nassistant\nassistant 1\n").hexdigest()
    assert chat.query(spark, str(tmp_path)).count() == 62
