import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewatch.llm.packing import END_ID, WordCoder, cut_pieces, fit_counts, pack, pack_residual, patterns, plan, round_counts, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def reference_pieces(tokenizer, text, size):
    """Pieces of one text by the plain library: (start, length, crc)."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
    cut = [ids[i : i + size] for i in range(0, len(ids), size)]
    return [(i * size, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i, p in enumerate(cut)]


ODD = [
    "Harbour's pilots don't, won't... 'twas", "ẞtraße İstanbul ΣΑΣ ﬁn", "a\x1cb\x85c d​e", "x<|endoftext|>y <|ENDOFTEXT|>", "µª º ÷× ÿŸ",
    "été café.", "12.5% (524) #tag $$$ &&& \"quoted\" -dash-", "日本語テキスト mixed ÀÉÎ,", "\x00nul\x00", "tide" * 100, "..." * 90, "q̇. ä,", "İ", "word. word.́",
]


@pytest.mark.parametrize("remembered", [2, 10_000])
def test_coder_equals_the_library(tokenizer, remembered):
    coder = WordCoder(PATH, remembered)
    got = [np.frombuffer(x, dtype="<u4").tolist() for text in ODD for x in coder.ids([text, "Harbour, tide."])][::2]
    assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="aàBÉß.,'<|# \ń\x1f", max_size=30))
def test_any_text(text):
    coder, full = test_any_text.coder, test_any_text.coder.full
    assert np.frombuffer(next(coder.ids([text])), dtype="<u4").tolist() == full.encode(text, add_special_tokens=False).ids


test_any_text.coder = WordCoder(PATH)


def places(histogram, size):
    """Every document's place by a plain walk over the plan."""
    slots = plan(histogram, size)
    by_length = {}
    for row in zip(*(slots[k].tolist() for k in ("length", "first", "base", "times", "offset"))):
        by_length.setdefault(row[0], []).append(row[1:])
    out = []
    for length, n in histogram.items():
        here = sorted(by_length[length])
        for rank in range(n):
            first, base, times, offset = [x for x in here if x[0] <= rank][-1]
            out.append((base + (rank - first) // times, offset + (rank - first) % times * length, length))
    return out


def assert_packed(found, size):
    rows = {}
    for sequence, offset, length in found:
        rows.setdefault(sequence, []).append((offset, length))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(rows)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=32))
def test_plan_places_every_document_once(histogram):
    found = places(histogram, 32)
    n = assert_packed(found, 32)
    assert Counter(x[2] for x in found) == Counter(histogram)
    best_fit = np.zeros(33, dtype=np.int64)
    for length, count in histogram.items():
        best_fit[length] = count
    # Never much worse than best fit on its own, and never below what the ids need.
    assert -(-sum(a * b for a, b in histogram.items()) // 32) <= n <= 1.1 * sum(g[0] for g in pack_residual(best_fit, 32)) + 2


def test_few_sequences():
    rng = np.random.default_rng(5)
    lengths = np.minimum(np.exp(rng.normal(6.5, 1.2, 40_000)).astype(int) + 1, 4096)
    histogram = Counter(lengths.tolist())
    slots = plan(histogram)
    last = {}
    for length, first, base, times in zip(*(slots[k].tolist() for k in ("length", "first", "base", "times"))):
        last.setdefault(length, []).append((first, base, times))
    n = 0
    for length, some in last.items():
        ends = [x[0] for x in some[1:]] + [histogram[length]]
        n = max(n, *(base + (end - first - 1) // times + 1 for (first, base, times), end in zip(some, ends)))
    assert n <= 1 + -(-int(lengths.sum()) // 4096)


def test_fit_finds_exact_counts():
    histogram = np.zeros(11, dtype=np.int64)
    for length, n in ((7, 30), (3, 30), (6, 20), (4, 20)):
        histogram[length] = n
    rows = patterns(np.flatnonzero(histogram[:10]), 10)
    assert all(r.sum() == 10 for r in rows)
    counts = fit_counts(rows, histogram, 2000)
    assert (counts >= 0).all()
    whole, left = round_counts(rows, counts + 1e-6, histogram)
    used = np.bincount(rows.ravel(), weights=np.repeat(whole, 3), minlength=11).astype(int)
    used[0] = 0
    assert (used + left == histogram).all() and left.sum() <= 4


def test_nothing_to_pack():
    assert all(len(x) == 0 for x in plan({}).values())
    assert places({4096: 3}, 4096) == [(0, 0, 4096), (1, 0, 4096), (2, 0, 4096)]


def check_whole(make, tokenizer, rows, size, kind="bigint"):
    table = make(rows, f"doc_id {kind}, text string")
    got = pack(table, PATH, size=size, with_ids=True).collect()
    expected = Counter()
    for doc_id, text in rows:
        for at, piece in enumerate(reference_pieces(tokenizer, text, size)):
            expected[(doc_id, at, *piece)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    return assert_packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], size), got


def test_pack_against_the_library(make, tokenizer):
    rng = np.random.default_rng(3)
    words = ["tide", "Harbour", "été.", "don't", "pilot,", "zz%%%", "12"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(300)]
    rows += [(1000 + i, text) for i, text in enumerate(ODD)]
    n, got = check_whole(make, tokenizer, rows, 24)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // 24) + 2


def test_nulls_repeats_hot_lengths_and_long_texts(make, tokenizer):
    rows = [(None, None), (1, None), (1, ""), (2, " \n "), (None, "tide"), (3, "tide " * 50_000)]
    rows += [(7, "the same row")] * 200 + [(i, "hot length") for i in range(300)]
    check_whole(make, tokenizer, rows, 4096)
    check_whole(make, tokenizer, [(str(a), b) for a, b in rows], 64, "string")


def test_empty_table(make):
    assert pack(make([], "doc_id bigint, text string"), PATH).collect() == []


def test_sequences(make, tokenizer):
    rows = [(i, "tide pilot " * (i % 9)) for i in range(60)]
    packed = pack(make(rows, "doc_id bigint, text string"), PATH, size=32, with_ids=True)
    whole = sequences(packed).collect()
    pieces = {(r["doc_id"], r["piece"]): r["ids"] for r in cut_pieces(make(rows, "doc_id bigint, text string"), PATH, size=32, with_ids=True).collect()}
    for row in whole:
        assert row["ids"] == b"".join(pieces[m["doc_id"], m["piece"]] for m in row["members"])
        assert row["length"] == len(row["ids"]) // 4 <= 32
    assert sum(len(r["members"]) for r in whole) == len(pieces)
