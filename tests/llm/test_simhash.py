import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import by_id
from tidewatch.llm import simhash
from tidewatch.llm.graph import components
from tidewatch.llm.simhash import POSTINGS, fingerprint, linked_pairs, near_duplicates


def roots(nodes, links):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_postings_meet_every_three_places():
    from itertools import combinations

    assert len(POSTINGS) == 14
    for differing in combinations(range(8), 3):
        assert any(not set(differing) & set(kept) for kept in POSTINGS)


def test_fingerprint_bit_by_bit():
    for text in ("One two\x0bthree FOUR É five", "one two", "One", "a b a b a b a b"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").split(" ")
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text) % (1 << 64) == wanted
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), 42)


@pytest.mark.parametrize("part", [2048, 8])
def test_links_connect_what_is_near(spark, part):
    draw = random.Random(5)
    prints = {0, 1, 3, 2**63, 2**64 - 1}
    for centre in (draw.getrandbits(64) for _ in range(12)):
        for _ in range(60):  # a dense group around each centre
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.choice((0, 1, 2, 3, 5, 9)))))
    values = np.array(sorted(prints), dtype=np.uint64)
    near = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ a) <= 3]]
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    links = [tuple(x % (1 << 64) for x in r) for r in linked_pairs(frame, part=part).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    nodes = [int(v) for v in values]
    assert roots(nodes, links) == roots(nodes, near)
    assert len(links) <= 16 * len(nodes)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (-5, 100)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links for n in link}
    wanted = {n: r for n, r in roots(nodes, links).items() if n != r}
    assert got == wanted


def test_documents(spark, make):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = "word " * 5 + " ".join(f"w{i}" for i in range(30_000))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, long), (1004, long + " more"), (1005, rows[0][1]), (1005, rows[0][1]), (None, rows[0][1])]
    found = near_duplicates(make(rows, "doc_id long, text string"))
    got = {}
    for doc_id, text_print, component in found.select("doc_id", "fingerprint", "component_id").collect():
        got.setdefault(doc_id, []).append((text_print % (1 << 64), component))
    prints = {i: fingerprint(t) % (1 << 64) for i, t in rows}
    ids = sorted(i for i in prints if i is not None)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3) if i < j]
    wanted = roots(ids, near)
    assert {i: got[i][0] for i in ids} == {i: (prints[i], wanted[i]) for i in ids}
    assert len(got[1005]) == 2 and got[None] == [(prints[rows[0][0]], wanted[rows[0][0]])]
    assert got[1000][0] == got[1002][0] and got[1000][0][0] == 0


def test_empty_table(make):
    assert near_duplicates(make([], "doc_id long, text string")).count() == 0
    assert simhash.DISTANCE == 3
