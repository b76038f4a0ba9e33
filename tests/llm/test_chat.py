"""Role repair against trying every choice, and the rendering."""

import itertools
import random

import pytest

from ferrytrace.llm import chat

LETTERS = {"s": "system", "u": "user", "a": "assistant", "x": None}


def least_cost(roles, costs):
    """Try all ways: per turn a role, merged or not, one inserted turn or none."""
    best = chat.NEVER
    options = [(r, m, i) for r in chat.ROLES for m in (False, True) for i in ("", *chat.ROLES)]
    for way in itertools.product(options, repeat=len(roles)):
        state, cost = "start", 0
        for source, (role, merged, inserted) in zip(roles, way, strict=True):
            cost += costs.relabel * (role != source)
            if merged:
                if inserted or role != state:
                    break
                cost += costs.merge
                continue
            if inserted:
                if inserted not in chat.NEXT[state]:
                    break
                state, cost = inserted, cost + costs.insert
            if role not in chat.NEXT[state]:
                break
            state = role
        else:
            best = min(best, cost + chat.closing(costs)[chat.STATES.index(state)][0])
    return best


def legal(roles):
    text = "".join(r[0] for r in roles)
    return text.startswith(("u", "su")) and text.removeprefix("s") == "ua" * (len(text.removeprefix("s")) // 2)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_cost_is_least(length):
    for costs in (chat.Costs(), chat.Costs(merge=4, insert=1, relabel=2)):
        for letters in itertools.product("suax", repeat=length):
            roles = [LETTERS[x] for x in letters]
            states = chat.fold([chat.block_table(roles, costs)], costs)
            chosen = chat.choose(roles, *states[0], costs)
            total = sum(c[0] for c in chosen) + chat.closing(costs)[states[0][1]][0]
            assert total == least_cost(roles, costs), letters


def test_blocks_change_nothing():
    rng = random.Random(3)
    costs = chat.Costs()
    for _ in range(200):
        roles = [LETTERS[rng.choice("suax")] for _ in range(rng.randint(2, 20))]
        cut = rng.randint(1, len(roles) - 1)
        whole = chat.block_table(roles, costs)
        one = chat.fold([whole], costs)
        parts = [roles[:cut], roles[cut:]]
        two = chat.fold([chat.block_table(p, costs) for p in parts], costs)
        assert two[0][0] == one[0][0] == 0

        def total(parts, states):
            picked = [chat.choose(p, *s, costs) for p, s in zip(parts, states, strict=True)]
            return sum(c[0] for p in picked for c in p) + chat.closing(costs)[states[-1][1]][0]

        assert total([roles], one) == total(parts, two)


def rows(spark, data, **options):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost string")
    got = chat.repair(df, **options).collect()
    return sorted(got, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["block"], r["position"]))


DATA = [
    (1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo <|im_end|>", "x"),
    (2, 0, "assistant", "first", "x"), (2, 1, "user", None, "x"), (2, 2, "user", "again", "x"),
    (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x"), (3, None, "tool", "out", "x"),
    (None, 0, "system", "s", "x"), (4, 5, None, "", "x"),
]


@pytest.mark.parametrize("size", [1, 2, 1024])
def test_repair(spark, size):
    got = rows(spark, DATA, turns_per_block=size)
    assert len(got) == len(DATA)
    texts = {}
    for r in got:
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["piece"]
    assert texts[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
    for text in texts.values():
        roles = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        assert legal(roles) and text.count("<|im_end|>\n") == len(roles)
    costs = {k: sum(r["cost"] for r in got if r["conv_id"] == k) for k in texts}
    assert costs == {1: 0, 2: 2 + 1 + 2, 3: 1 + 3, None: 4, 4: costs[4]}
    assert costs[4] == least_cost([None], chat.Costs())
    assert costs[3] == least_cost(["user", "user", None], chat.Costs())


def test_empty(spark):
    assert rows(spark, []) == []


def test_long_conversation(spark):
    data = [(7, t, ["user", "assistant"][t % 2], f"t{t}", "") for t in range(5000)]
    got = rows(spark, data)
    assert [r["turn"] for r in got] == list(range(5000)) and not sum(r["cost"] for r in got)
    assert {r["block"] for r in got} == set(range(5))
