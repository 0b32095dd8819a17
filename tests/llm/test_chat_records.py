"""Records with metadata, optional fields and incomplete messages keep all their turns."""

import json

import pytest

from lodestone.llm import chat_format as T

CASES = [
    ({"id": 1, "source": "s", "metadata": {"a": [1, {"b": 2}]}, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant"}, {"content": "c"}, {}]}, [("user", "a"), ("assistant", ""), ("", "c"), ("", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b", {"type": "image", "url": "u"}]}]}, [("user", 'a\n\nb\n\n{"type": "image", "url": "u"}')]),
    ({"messages": []}, []),
    ({"prompt": "a", "system": "s", "messages": [{"role": "user", "content": "a"}]}, [("system", "s"), ("user", "a")]),
    ({"id": 3, "conversations": [{"from": "human", "value": "v", "weight": 0}, {"from": "gpt"}]}, [("user", "v"), ("assistant", "")]),
    ({"system": "s", "prompt": "p", "completion": "c", "id": 2}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None, "system": None}, [("system", ""), ("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "", "output": "o", "tags": []}, [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c", "response": "r"}, None),
    ({"messages": ["a"]}, None), ({"messages": "a"}, None), ({"messages": [{"from": "human", "value": "v"}, {}]}, None),
]


@pytest.mark.parametrize("record, turns", CASES)
def test_turns(record, turns):
    got = T.turns_of(record)[1]
    assert (got if got is None else [tuple(t.values()) for t in got]) == turns


def test_column_and_rows_use_the_same_selection(spark):
    df = spark.createDataFrame([(json.dumps(r),) for r, _ in CASES], "record string")
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in T.canonical(df).collect()] == [t for _, t in CASES]
    rows = T.LAYOUTS[0]
    assert T.layout_of({"conv_id", "turn", "role", "text", "more"}, by_rows=True) == (T.fingerprint(rows["paths"]), rows)
    with pytest.raises(ValueError, match="no mapping"):
        T.format_rows(spark.createDataFrame([(1, "x")], "conv_id long, text string"))
