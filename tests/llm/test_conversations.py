import random

import pytest

from tidewatch.llm.conversations import format_chats


def brute(rows, part):
    of = {}
    for conv, turn, role, text in set(rows):
        of.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(turns)] for c, turns in of.items()}
    out = []
    for conv, turns in talks.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in talks.values())
        equal = [c for c, o in talks.items() if o == turns]
        if not longer and conv == min(equal, key=lambda c: (c is None, c)):
            for start in range(0, len(turns), part):
                said = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns[start : start + part])
                out.append((conv, start // part, len(turns), len(equal), said))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [1024, 3])
def test_against_brute_force(make, part):
    draw = random.Random(11)
    rows = []
    for conv in range(120):
        if conv and draw.random() < 0.6:  # a snapshot of an earlier conversation, or one that goes on
            base = [r for r in rows if r[0] == draw.randrange(conv)]
            turns = [(r[2], r[3]) for r in sorted(base, key=lambda r: r[1])][: draw.randint(1, 6)]
            turns += [("user", f"x{draw.randrange(3)}") for _ in range(draw.choice((0, 0, 1)))]
        else:
            turns = [(draw.choice(("user", "assistant")), draw.choice(("hi", "hello", f"t{draw.randrange(9)}"))) for _ in range(draw.randint(1, 7))]
        step = draw.choice((1, 5))
        rows += [(conv, i * step, role, text) for i, (role, text) in enumerate(turns)]
    rows += rows[:15] + [(500, None, None, None), (500, 1, "user", ""), (None, 0, "user", "no id"), (None, 1, "user", "more"), (501, 0, "user", "long " * 50_000)]
    got = format_chats(make(rows, "conv_id long, turn long, role string, text string"), part=part)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, part)


def test_ties_are_ordered_alike_in_every_conversation(make):
    rows = [(c, 0, "user", t) for c in (1, 2, 3) for t in ("a", "b", "c")] + [(3, 1, "assistant", "d")]
    got = format_chats(make(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(3, 4)]


def test_long_conversation_and_empty_table(make):
    rows = [(1, i, "user", f"t{i % 7}") for i in range(5000)] + [(c, i, "user", f"t{i % 7}") for c in (2, 3) for i in range(4999)]
    got = sorted(format_chats(make(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [(r["conv_id"], r["part"], r["n_turns"], r["n_copies"]) for r in got] == [(1, p, 5000, 1) for p in range(5)]
    assert "".join(r["text"] for r in got) == "".join(f"<|im_start|>user\nt{i % 7}<|im_end|>\n" for i in range(5000))
    assert format_chats(make([], "conv_id long, turn long, role string, text string")).count() == 0
