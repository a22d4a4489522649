import zlib

import numpy as np

from tests.llm.conftest import by_id
from tidewatch.llm.quality_model import _Hashes, features, fit, score, train

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    got = by_id(score(documents, train(documents, labels)), "doc_id", "held_out", "score", "predicted")
    assert len(got) == documents.count()
    hits = []
    for doc_id, (label,) in by_id(labels, "doc_id", "quality").items():
        out, value, predicted = got[doc_id][0]
        assert out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and predicted == (value >= 0.5) and 0 <= value <= 1
        if out:
            hits.append(predicted == label)
    assert np.mean(hits) >= 0.93


def test_labels_of_held_out_rows_are_not_used(make):
    texts = [(i, ("good fine words " if i % 2 else "### $$$ ") * 9) for i in range(90)]
    right = [(i, i % 2) for i, _ in texts]
    false = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in right] + [(None, 1), (5, 0), (200, None)]
    docs = make(texts, "doc_id long, text string")
    a, b = (train(docs, make([r for r in rows if r[0] != 5], "doc_id long, quality int")) for rows in (right, false))
    assert np.array_equal(a, b) and a.any()


def test_edge_rows(make):
    docs = make([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b " * 100_000)], "doc_id long, text string")
    weights = fit([("good words here", 1), ("### ###", 0)] * 20, buckets=1 << 12)
    got = by_id(score(docs, weights), "doc_id", "held_out", "score", "predicted")
    assert got[1] == got[2] or got[1][0][1] == got[2][0][1]
    assert len(got[3]) == 2 and got[None][0][0] is False
    assert score(docs.limit(0), weights).count() == 0
    assert not train(docs, make([], "doc_id long, quality int")).any()


def test_score_is_a_sparse_dot_product(make):
    weights = np.random.default_rng(1).normal(size=1 << 12)
    text = "some words, and some more words!!"
    at, value = features(text, _Hashes(), 1 << 12)
    dense = np.zeros(1 << 12)
    np.add.at(dense, at, value)
    got = score(make([(1, text)], "doc_id long, text string"), weights).first()["score"]
    assert abs(got - 1 / (1 + np.exp(-dense @ weights))) < 1e-12


def test_follow_the_leader_separates():
    examples = [("a b c d", 1), ("a b c x", 0), ("q d", 1), ("r x", 0)] * 30
    weights = fit(examples, buckets=1 << 12, l1=0.0)

    def sign(text):
        at, value = features(text, _Hashes(), 1 << 12)
        return weights[at] @ value > 0

    assert sign("c d") and not sign("c x")
