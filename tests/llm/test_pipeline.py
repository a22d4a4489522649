"""The pipeline over a small folder, each stage against a brute-force version on its own input."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_simhash import roots
from tidewatch.llm import toxicity
from tidewatch.llm.passages import words_of
from tidewatch.llm.simhash import fingerprint
from tidewatch.session import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, stage_key string, n_left string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(21)
    pool = [f"w{i}" for i in range(3000)]

    def some(n):
        return [draw.choice(pool) for _ in range(n)]

    items = [some(25) for _ in range(6)] + [some(4)]
    shared = [some(60) for _ in range(3)]
    texts = []
    for i in range(150):
        text = some(draw.randint(0, 160))
        if i % 9 == 0:
            text += draw.choice(shared) + some(30)
        if i % 11 == 0:
            text += draw.choice(items)
        if i % 13 == 0:
            text += ["you", "idiot", "scum", "moron"]
        texts.append(" ".join(text))
    texts += [texts[3], texts[3] + " extra", None, "", texts[8].upper()]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[20], (None, texts[5], None, None, None, None, None, None), (900, " ".join(some(40_000)), "en", "src0", 0, "", "", "")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 13 == 0)) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "passages", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = written(stage(spark, docs, folder), name)
        rows = after.collect()
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "toxicity":
            automaton = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            wanted = [r for r in before if toxicity.rate(r["text"] or "", automaton)[0] < 0.7]
            assert sorted(map(str, rows)) == sorted(map(str, wanted))
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} == set(range(0, 150, 13))
        if name == "simhash":
            prints = np.array([fingerprint(r["text"]) for r in before]).view(np.uint64)
            links = [(i, int(j)) for i in range(len(before)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3) if i < j]
            groups = {}
            for i, root in roots(range(len(before)), links).items():
                groups.setdefault(root, []).append(before[i])
            wanted = {min((r["doc_id"] is None, r["doc_id"] or 0) for r in g) for g in groups.values()}
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(wanted)
        if name == "passages":
            texts = {r["doc_id"]: r["text"] for r in rows}
            seen = set()
            for row in sorted(before, key=lambda r: r["doc_id"]):
                left = words_of(texts.get(row["doc_id"], ""))
                windows = {tuple(left[i : i + 50]) for i in range(len(left) - 49)}
                assert not windows & seen  # no earlier document has a passage of 50 words that is left
                words = words_of(row["text"])
                own = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
                if not any(w in seen for w in own):
                    assert texts[row["doc_id"]] == row["text"]
                else:
                    assert len(left) < len(words) and row["n_chars"] is not None
                seen.update(own)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None and r["doc_id"] not in (None, 900))
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = {r[0] for r in brute_leaks([(r["doc_id"], r["text"]) for r in before], items) if r[2] == 0}
            assert {r["doc_id"] for r in rows} == clean and len(rows) < len(before)
        if name == "bpe":
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(rows) == len(before)
            for row in rows:
                ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
                assert np.frombuffer(bytes(row["ids"]), dtype="<u4").tolist() == ids and row["n_tokens"] == len(ids)
                assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        docs = after


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 50
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
