import itertools

import numpy as np
import pytest

from sparkloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def cheapest(given):
    """By trying every sequence of actions."""
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(given)):
        cost, at = 0, 0
        for g, s in zip(given, states):
            off = 0 if s == g else chat.UNKNOWN if g == 0 else chat.RELABEL
            options = []
            if s in chat.LEGAL[at]:
                options.append(off)
            if s == at:
                options.append(chat.MERGE + off)
            for n in (1, 2):
                for between in itertools.product((1, 2, 3), repeat=n):
                    way = (at, *between, s)
                    if all(b in chat.LEGAL[a] for a, b in zip(way, way[1:])):
                        options.append(chat.INSERT * n + off)
            if not options:
                break
            cost, at = cost + min(options), s
        else:
            ends = [0] if at == 3 else [chat.INSERT * (2 if at == 1 else 1)]
            total = cost + ends[0]
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repair_has_least_cost(n):
    for given in itertools.product(range(4), repeat=n):
        out = chat.pieces(np.array(given), ["x"] * n, chat._BEGIN, None, True)
        assert sum(o[3] for o in out) == cheapest(given), given
        text = "".join(o[4] for o in out)
        roles = [line.removeprefix("<|im_start|>") for line in text.split("\n") if line.startswith("<|im_start|>")]
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and text.count("<|im_start|>") == text.count("<|im_end|>")


def test_chunks_do_not_change_the_result(spark):
    rng = np.random.default_rng(3)
    roles = ["user", "assistant", "system", "Human", "gpt", "tool", None, ""]
    rows = [(int(c), int(t), roles[rng.integers(8)], f"t{t}", "clash") for c in (1, 2) for t in range(40)] + [(None, 1, "user", None, "x"), (3, None, None, "", "x"), (3, None, None, "", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in chat.formatted(df).collect()}
    assert len(whole) == len(rows) and {tuple(r) for r in chat.formatted(df, chunk=3).collect()} == whole
    for c in (1, 2):
        given = [r for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        symbols = [{"user": 2, "human": 2, "assistant": 3, "gpt": 3, "system": 1}.get((r[2] or "").lower(), 0) for r in given]
        out = chat.pieces(np.array(symbols), [r[3] for r in given], chat._BEGIN, None, True)
        assert sum(o[3] for o in out) == sum(r[6] for r in whole if r[0] == c)
        assert "".join(o[4] for o in out) == "".join(r[7] for r in sorted((r for r in whole if r[0] == c), key=lambda r: r[2]))


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts_and_conversations_side_by_side(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long, "x"), (1, 1, "assistant", "y", "x")] + [(2, t, ("user", "assistant")[t % 2], f"t{t}", "x") for t in range(10_000)] + [(3, 0, "tool", None, "x")]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = {c: "".join(r.rendered for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)) for c in (1, 2, 3)}
    assert text[1] == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"
    assert text[2].count("<|im_start|>") == text[2].count("<|im_end|>") == 10_000 and sum(r.cost for r in got if r.conv_id == 2) == 0
    assert [r.position for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.turn)] == list(range(10_000))
