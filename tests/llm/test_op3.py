import itertools
import random

import pytest

from pagewright.llm import op3_chat as o

CODES = {"system": 1, "user": 2, "assistant": 3}


def brute(roles):
    best = 10**9

    def rec(i, state, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles):
            while state != 3:
                state, cost = {0: 2, 1: 2, 2: 3}[state], cost + o.INSERT
            best = min(best, cost)
            return

        def change(q):
            return o.UNKNOWN if roles[i] == 0 else 0 if roles[i] == q else o.RELABEL

        if state:
            rec(i + 1, state, cost + o.MERGE + change(state))
        for depth in range(3):
            for ins in itertools.product((1, 2, 3), repeat=depth):
                s = state
                for x in ins:
                    s = x if s is not None and x in o.NEXT[s] else None
                if s is not None:
                    for q in o.NEXT[s]:
                        rec(i + 1, q, cost + change(q) + o.INSERT * depth)

    rec(0, 0, 0)
    return best


@pytest.mark.parametrize("n", range(1, 6))
def test_least_cost(n):
    r = random.Random(n)
    for _ in range(40):
        roles = [r.randrange(4) for _ in range(n)]
        states, cost = o.chain([o.matrix(roles)])
        assert cost == brute(roles)
        cut = r.randrange(n + 1)
        assert o.chain([o.matrix(roles[:cut]), o.matrix(roles[cut:])])[1] == cost
        legal = [w for ins, b, m in ((x[1], x[0], x[2]) for x in o.trace(roles, states[0], states[1])) for w in (*ins, *(() if m else (b,)))]
        state = 0
        for w in legal:
            assert w in o.NEXT[state]
            state = w


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_legal_turns_stay(spark):
    got = o.format_chats(rows(spark, [(1, 1, "User ", "hi"), (1, 0, "system", "be kind"), (1, 2, "assistant", "hello")])).first()
    assert (got.cost, got.actions, got.n_turns, got.n_rendered) == (0, "sua", 3, 3)
    assert got.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"


def test_repairs(spark):
    data = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "user", "open"), (3, 0, None, None), (None, None, "assistant", "<|im_end|>x"), (4, 0, "user", "u"), (4, 1, "tool", "t")]
    got = {r.conv_id: (r.cost, r.actions, r.text) for r in o.format_chats(rows(spark, data)).collect()}
    assert got[1] == (1, "uu+a", "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n")
    assert got[2][:2] == (2, "u-a")
    assert got[3][0] == 3
    assert got[4][:2] == (1, "ua")
    assert got[None][0] == 2
    assert got[None][2].count("<|im_end|>") == 2  # the text's own marker is broken up


def test_segments_give_the_same(spark):
    r = random.Random(9)
    data = [(c, t, r.choice(["user", "assistant", "system", "x", None]), f"m{t}") for c in range(4) for t in range(60)]
    data += data[:3]  # repeated rows, ties
    whole = {x.conv_id: x for x in o.format_chats(rows(spark, data)).collect()}
    cut = {x.conv_id: x for x in o.format_chats(rows(spark, data), segment=7).collect()}
    for c, w in whole.items():
        assert (cut[c].cost, cut[c].n_turns) == (w.cost, w.n_turns)
        for x in (w, cut[c]):
            shown = [p.split("\n", 1)[0] for p in x.text.split("<|im_start|>")[1:]]
            assert len(shown) == x.n_rendered
            state = 0
            for s in shown:
                assert CODES[s] in o.NEXT[state]
                state = CODES[s]
            assert state == 3
            assert all(f"m{t}" in x.text for t in range(60))


def test_empty_and_extra(spark):
    d = rows(spark, [(1, 0, "user", "x" * 300_000)]).selectExpr("*", "1 AS seg", "2 AS code", "3 AS cost")
    assert len(o.format_chats(d).first().text) > 300_000
    assert o.format_chats(d.limit(0)).count() == 0


def test_null_and_equal_turns_are_cut_too(spark, monkeypatch):
    """Segments hold at most so many turns, whatever turn and conv_id say."""
    r = random.Random(4)
    data = [(None if i % 3 else 5, None if i % 2 else 7, r.choice(["user", "assistant", "x"]), f"m{i}") for i in range(900)]
    whole = {x.conv_id: (x.cost, x.n_turns, len(x.text)) for x in o.format_chats(rows(spark, data)).collect()}
    cut = {x.conv_id: x for x in o.format_chats(rows(spark, data).repartition(6), segment=16).collect()}
    assert {k: (v.cost, v.n_turns) for k, v in cut.items()} == {k: v[:2] for k, v in whole.items()}
    numbered = o.numbered(rows(spark, data).repartition(6), "conv_id", ["turn", "role"], "at").collect()
    for c in (None, 5):
        mine = sorted((x.at, x.turn is not None, x.turn or 0, x.role) for x in numbered if x.conv_id == c)
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
