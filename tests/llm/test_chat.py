import random

import pytest

from checks import compare
from ledgerloom.llm import chat, queries

FOLDER = "/root/testdata/sf0.001"


def by_hand(rows):
    talks = {}
    last = (1 << 63) - 1
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((last if turn is None else turn, role or "unknown", text or ""))
    talks = {c: [t[1:] for t in sorted(turns)] for c, turns in talks.items()}
    out = {}
    order = sorted(talks, key=lambda c: (c is None, c or 0))
    for c in order:
        mine = talks[c]
        if any(len(t) > len(mine) and t[:len(mine)] == mine for t in talks.values()) or any(talks[o] == mine for o in order[:order.index(c)]):
            continue
        copies = sum(t == mine for t in talks.values())
        for p in range(0, len(mine), chat.PART):
            out[c, p // chat.PART] = (len(mine), copies, "".join(f"<|{r.replace('<|', '< |')}|>\n{t.replace('<|', '< |')}\n" for r, t in mine[p:p + chat.PART]))
    return out


def found(frame):
    return {(r["conv_id"], r["part"]): (r["n_turns"], r["copies"], r["rendered"]) for r in frame.collect()}


def test_query_matches_sql(spark):
    assert compare.compare(queries.queries()["op9_chat"](spark, FOLDER), compare.connect(FOLDER), queries.oracle_sql()["op9_chat"]) is None


@pytest.mark.parametrize("size", [4096, 2])
def test_snapshots_collapse(spark, monkeypatch, size):
    """Also where conversations are cut into slices and parts of two turns."""
    monkeypatch.setattr(chat, "SLICE", size)
    monkeypatch.setattr(chat, "PART", min(size, 256))
    rnd = random.Random(size)
    rows, conv = [], 0
    for base in range(12):
        talk = [(rnd.choice(["user", "assistant"]), f"{rnd.randint(0, 2)}") for _ in range(rnd.randint(1, 9))]
        for _ in range(rnd.randint(1, 5)):
            part = talk[:rnd.randint(1, len(talk))]
            if rnd.random() < 0.3:
                part = [*part, ("user", "other")]
            rows += [(conv, 3 * i, r, t) for i, (r, t) in enumerate(part)]
            conv += 1
    rows += [(None, 0, "user", "1"), (None, None, None, None), (900, 0, "user", "<|user|> x"), (900, 0, "user", "<|user|> x"), (901, 1, None, "y")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, conv int, h1 string")
    assert found(chat.rendered(frame)) == by_hand(rows)
    assert chat.rendered(frame.limit(0)).collect() == []


def test_main_path_is_native(spark):
    plan = queries.queries()["op9_chat"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    turns = chat.placed(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    assert "Python" not in chat.maximal(turns)._jdf.queryExecution().toString()
