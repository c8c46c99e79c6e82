"""Long conversations as trees of segments."""

from __future__ import annotations

import random

import pytest

from arboris.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, no string"


@pytest.mark.parametrize("fan", [256, 2, 3])
def test_sparse_turn_numbers_make_full_segments(spark, fan):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", None, "human"]
    turns = {c: [rng.choice(roles) for _ in range(n)] for c, n in ((1, 900), (None, 70), (2, 1))}
    rows = [(c, 10**9 * i + rng.randrange(1000), r, f"t{i}", "own") for c, own in turns.items() for i, r in enumerate(own)]
    rng.shuffle(rows)
    got = sorted((r for r in chat.repaired(spark.createDataFrame(rows, SCHEMA), 32, fan).collect()), key=lambda r: (str(r["conv_id"]), r["part"]))
    for c, own in turns.items():
        mine = [r for r in got if r["conv_id"] == c]
        assert [r["n_turns"] for r in mine] == [32] * (len(own) // 32) + ([len(own) % 32] if len(own) % 32 else [])
        best, _ = chat.trace([chat._STEP[chat.role_number(r or "")] for r in own], chat.START)
        end = chat.trace([chat._STEP[chat.role_number(r or "")] for r in own], chat.START)[1][-1]
        assert sum(r["cost"] for r in mine) == best + int(chat._CLOSE[end])
        text = "".join(r["rendered"] for r in mine)
        at = [text.index(f"t{i}\n") if f"t{i}\n" in text else text.index(f"t{i}<") for i in range(len(own))]
        assert at == sorted(at)


def test_query(spark):
    from arboris.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op1_chat_repair"](spark, folder)
    assert got.columns == ["conv_id", "part", "n_turns", "n_repaired", "cost", "rendered"]
    assert got.agg({"n_turns": "sum"}).first()[0] == spark.read.parquet(f"{folder}/conversations.parquet").count()
