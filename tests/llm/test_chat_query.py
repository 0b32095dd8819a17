"""The registered query against a plain version, and turns that are hard to read back."""

import hashlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from lodestone.llm import chat_format as T
from lodestone.llm.queries import op3_chat_format
from tests.conftest import SF

SAID = "\\### Assistant: </turn> ok"


def plain(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = Counter()
    for conv, said in talks.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        marks = sum(len("### : </turn>\n") + len(r) + len(t) + sum(map((r + t).count, "\\#<")) + r.count(":") for _, _, r, t in said)
        out[(conv, len(said), sha("".join(f"{r}\n{t}\n" for _, _, r, t in said)), len(loss), sha(loss), marks)] += 1
    return out


def test_the_query_equals_a_plain_version(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").select(["conv_id", "turn", "role", "text"])
    assert Counter(map(tuple, op3_chat_format(spark, SF).collect())) == plain(list(zip(*rows.to_pydict().values(), strict=True)))


def test_the_query_on_awkward_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, None, "a:b#<\\", "x\n### user: y</turn>\n"), (None, 3, "assistant", "\\"), (None, 3, "assistant", "\\"), (2, 1, None, ""), (3, 0, "assistant", "é" * 40), (3, 0, "user", "</turn>\n" * 30)]
    df = spark.createDataFrame([(*r, "f", "l") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(map(tuple, op3_chat_format(spark, str(tmp_path)).collect())) == plain(rows)


@pytest.mark.parametrize("text", ["a" * 3_000_000, "\\#<" * 1_000_000, "x\n" * 1_000_000])
def test_very_long_turns(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = T.read_back(T.format_rows(df)).first()
    assert [tuple(t) for t in got.turns] == [("user", text), ("assistant", text)] and got.loss_text == text
