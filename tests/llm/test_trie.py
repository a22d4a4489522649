import zlib
from hashlib import sha256

import pytest

from tidewatch.llm.trie import listed_digest, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    return row[1] is not None, row[1] or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute_force(rows):
    """The trie by nested dictionaries."""
    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        words = len([w for w in node[-1][1].replace("\x0b", " ").replace("\x0c", " ").split() if w]) if node else 0
        leaves, saved = (0 if node in children else 1), (len(members[node]) - 1) * words
        for child in children.get(node, ()):
            a, b = totals(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, some in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in some if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(some), len(node), parent, len(some), len(children.get(node, ())), *totals(node), sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(make, rows, block=1024):
    got = [tuple(r) for r in prefix_trie(make(rows, SCHEMA), block).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == brute_force(rows)


def talk(n, shape):
    """Conversations in which many begin alike."""
    return [(c, t, "user" if t % 2 else "bot", f"turn {t} of {c % max(1, t)} says a b") for c in range(n) for t in range(shape(c))]


def test_small_families(make):
    check(make, talk(90, lambda c: c % 9))


@pytest.mark.parametrize("block", [1, 4])
def test_long_conversations_over_blocks(make, block):
    long = [(c, t, "user", "x y" if c < 4 or t < 30 else f"{t}") for c in (0, 1, 2, 3, 20, 25) for t in range(37 + c % 3)]
    check(make, long, block)


def test_hot_first_turn_and_equal_conversations(make):
    rows = [(c, 0, "user", "the same opening words") for c in range(400)] + [(c, 1, "bot", f"{c % 3}") for c in range(0, 400, 2)]
    check(make, rows)


def test_nulls_ties_repeats_and_turnless(make):
    rows = [(None, 1, "user", "nobody"), (5, None, None, None), (5, 2, "user", ""), (5, 2, "bot", "tie"), (5, 2, "bot", "tie"), (5, None, "", "")]
    rows += [(c, 1, "user", "only one") for c in range(21, 60)] + [(7, 3, "user", "word " * 50_000), (40, -2, "é", "漢 字"), (-3, 1, "user", "below zero")]
    check(make, rows)


def test_all_turnless(make):
    some = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20][:9]
    check(make, [(c, 1, "user", "gone") for c in some])


def test_empty_table(make):
    assert prefix_trie(make([], SCHEMA)).collect() == []


def test_long_lists_of_ends(spark):
    ids = [7 * i - 3000 for i in range(5000)]
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5), (0, 2, -1)], "conv_id long, depth long, member long")
    got = {(r[0], r[1]): r[2] for r in listed_digest(ends).collect()}
    assert got[1, 2] == sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got[1, 3] == sha256(b"5").hexdigest() and got[0, 2] == sha256(b"-1").hexdigest() and len(got) == 3
