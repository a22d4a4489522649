import collections
import random
import re

from tests.llm.conftest import by_id
from tidewatch.llm.quality_rules import RULES, STATISTICS, Rule, judge, rule_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_statistics_against_brute_force(make):
    draw = random.Random(7)
    texts = [None, "", " \n\n", "a", "é\xa0ü\x1cx \x85", "#" * 9, "one line\none line\n one line\n\n\n", "a " * 9, "a b c d e f g h " * 2, "x" * 100_000, "w " * 30_000]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 300))) + draw.choice(("\n", " ", "|")) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[8])]
    got = by_id(judge(make(rows, "doc_id long, text string")), "doc_id", *STATISTICS, "kept", "rejected_by", "n_tested")
    for i, text in enumerate(texts):
        n, _, _, _, repeated = brute(text)
        assert got[i][0][:5] == brute(text), (i, got[i], brute(text))
        if n < 20 or 100 * repeated > 30 * n:
            assert not got[i][0][5]
        assert got[i][0][5] == (got[i][0][6] is None)
    assert len(got[5]) == 2 and got[None][0][:5] == brute(texts[8])


def test_verdict_is_that_of_all_rules(spark):
    from tidewatch.llm.quality_rules import Text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(judge(docs), "doc_id", "kept", "rejected_by", "n_tested")
    for doc_id, text in docs.select("doc_id", "text").collect():
        kept, by, tested = got[doc_id][0]
        assert kept == (not any(r.rejects(Text(text)) for r in RULES))
        assert kept == (tested == len(RULES)) or tested == len(RULES)
        assert by is None or next(r for r in RULES if r.name == by).rejects(Text(text))


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = by_id(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "quality")
    got = by_id(judge(spark.read.parquet(f"{folder}/documents.parquet")), "doc_id", "n_words", "n_repeat_words", "kept")
    wrong = [i for i, (q,) in labels.items() if q == 1 and not got[i][0][2] and got[i][0][0] >= 20 and 100 * got[i][0][1] <= 30 * got[i][0][0]]
    missed = [i for i, (q,) in labels.items() if q == 0 and got[i][0][2]]
    assert len(wrong) == 0 and len(missed) <= 2


def test_order_by_rejection_per_cost(make):
    def slow(_):
        return sum(range(20_000)) < 0

    rules = [Rule("never", lambda t: False), Rule("slow_half", lambda t: slow(t) or t.n_words % 2 == 0), Rule("quick_half", lambda t: t.n_words % 2 == 1)]
    docs = make([(i, "w " * i) for i in range(200)], "doc_id long, text string")
    assert rule_order(docs, rules) == ["quick_half", "slow_half", "never"]
    assert rule_order(docs.limit(0), rules)[0] in {r.name for r in rules}
    assert judge(docs.limit(0)).count() == 0
