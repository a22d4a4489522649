import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import by_id
from tidewatch.llm.decontamination import decontaminate, leaked_windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(10, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add(item_id)
        out.append((doc_id, len(own), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_against_brute_force(make, broadcast_bytes):
    draw = random.Random(3)
    pool = [f"w{i}" for i in range(25)] + ["Été", "Σ", "x9"]

    def some(n):
        return [draw.choice(pool) for _ in range(n)]

    items = [some(draw.choice((1, 3, 4, 5, 9, 10, 11, 14, 30, 60))) for _ in range(24)]
    docs = []
    for i in range(60):
        text = some(draw.randint(0, 40))
        for _ in range(draw.randint(0, 3)):
            item = draw.choice(items)
            cut = draw.randint(0, len(item) - 1)
            text += item[cut : cut + draw.choice((8, 10, 12, 40))] + some(draw.randint(0, 5))
        docs.append((i, draw.choice((" ", ", ", "\n-")).join(w.upper() if draw.random() < 0.3 else w for w in text)))
    docs += [(100, None), (101, ""), (102, "!!!"), (103, docs[5][1]), (103, docs[5][1]), (None, docs[5][1]), (104, "a " * 5000), (105, "a " * 30)]
    items = [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, "?"), (52, "a " * 12), (52, items[3] and " ".join(items[3])), (None, "W1 w2")]
    got = decontaminate(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes)
    rows = sorted(((r[0], r[1], r[2], r[3]) for r in got.select("doc_id", "n_words", "n_hit", "item_ids").collect()), key=str)
    assert rows == brute(docs, items)
    assert all(r[0] == (r[1] > 0) for r in got.select("contaminated", "n_hit").collect())


def test_empty_tables(make):
    docs, items = make([(1, "a b")], "doc_id long, text string"), make([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate(docs, items).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]
    assert decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_every_shared_run_is_found(make):
    draw = random.Random(9)
    item = [f"i{draw.getrandbits(20)}" for _ in range(40)]
    docs = []
    for n, start in enumerate(range(0, 31)):
        docs.append((n, " ".join([f"d{draw.getrandbits(20)}" for _ in range(7)] + item[start : start + 10] + ["end"])))
    got = decontaminate(make(docs, "doc_id long, text string"), make([(1, " ".join(item))], "item_id long, text string"))
    assert all(r[0] == 10 for r in got.select("n_hit").collect())
    assert by_id(got, "doc_id", "contaminated")[0] == [True]


def test_rows_that_differ_only_in_what_is_null(make):
    item = "one two three four five six seven eight nine ten eleven twelve"
    for rows in ([(None, item), (item, None)], [(item, None), (None, item)]):
        found = by_id(decontaminate(make(rows, "doc_id string, text string"), make([(1, item)], "item_id long, text string")), "doc_id", "n_words", "n_hit", "contaminated")
        assert found == {None: [(12, 12, True)], item: [(0, 0, False)]}


def test_repeated_words_give_no_more_rows_than_windows(spark, make):
    docs = make([(1, "tide " * 4000), (2, "ebb flow " * 2000), (3, "tide " * 9), (4, "clean text")], "doc_id long, text string")
    items = make([(i, "tide " * (60 + i)) for i in range(200)] + [(500 + i, "flow ebb " * (30 + i)) for i in range(50)], "item_id long, text string")
    windows = leaked_windows(docs.withColumn("key", F.col("doc_id")).select("key", "text"), items)
    assert windows.count() == 200 * (4000 - 9) + 50 * (4000 - 9)
    found = by_id(decontaminate(docs, items), "doc_id", "n_words", "n_hit", "n_items")
    assert found == {1: [(4000, 4000, 200)], 2: [(4000, 4000, 50)], 3: [(9, 0, 0)], 4: [(2, 0, 0)]}
