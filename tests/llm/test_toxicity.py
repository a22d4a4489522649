import random
import zlib

from tests.llm.conftest import by_id
from tidewatch.llm.toxicity import Automaton, Term, allowed_edits, learn, rate, score, scorer


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_automaton_against_edit_distances():
    draw = random.Random(3)
    terms = [Term("".join(draw.choice("abc") for _ in range(draw.randint(3, 12))), 1.0, False) for _ in range(25)] + [Term("abcab", 0.8, True)]
    terms = list({t.text: t for t in terms}.values())
    automaton = Automaton(terms)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    for term in terms:
        words += [term.text, term.text[1:], term.text + "d", term.text[:2] + "d" + term.text[3:], term.text + "dddd"]
    for word in words:
        near = [distance(word, t.text) for t in terms if not t.stem and distance(word, t.text) <= allowed_edits(t)]
        stem = any(t.stem and word.startswith(t.text) for t in terms)
        found = automaton.match(word)
        assert (found is not None) == bool(near or stem), word
        if near:
            assert found.edits == min(near)


def test_context():
    automaton = Automaton([Term("moron", 1.0, False), Term("vequ", 1.0, True)], frozenset({"maron"}))
    plain, quoted = rate("what a moron there", automaton)[0], rate('the sign "what a moron" hung there', automaton)[0]
    said, aimed = rate("he wrote moron there", automaton)[0], rate("you are a moron", automaton)[0]
    assert quoted < said < plain < aimed and quoted < 0.7 <= plain
    assert rate("a morron", automaton)[1][0][2] == 1 and rate("a maron moran vequille", automaton)[0] > 0.7
    assert rate("maron\n“moron” x", automaton)[1] == [("moron", 7, 0, 0.2)]
    assert rate("", automaton) == (0.0, [])


def test_learned_terms_and_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    documents = documents.join(labels.select("doc_id"), "doc_id")
    got = by_id(score(documents, learn(documents, labels)), "doc_id", "held_out", "score", "predicted")
    right = total = 0
    for doc_id, (label,) in by_id(labels, "doc_id", "toxic").items():
        out, value, predicted = got[doc_id][0]
        assert out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and predicted == (value >= 0.7)
        if out:
            total, right = total + 1, right + (predicted == label)
    assert right / total > 0.96


def test_texts_under_one_header_are_all_learned_from(make):
    draw = random.Random(3)
    some = lambda n: " ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(n))
    header, footer = "the header of a forum that stands above all of its posts", "and the footer that stands below all of the posts of the forum"
    texts = [(i, f"{header} {some(9)} grumpfel {some(9)} {footer}", 1) for i in range(400)]
    texts += [(1000 + i, f"{some(30)}", 0) for i in range(400)]
    docs, labels = make([t[:2] for t in texts], "doc_id long, text string"), make([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    found = learn(docs, labels)
    assert found.match("grumpfel").term == "grumpfel"
    assert not found.match("header") and not found.match("forum") and not found.match("below")


def test_edge_rows(make):
    docs = make([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "filler " * 100_000 + "scum")], "doc_id long, text string")
    labels = make([(None, 1), (1, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    automaton = learn(docs, labels)
    got = by_id(score(docs, automaton), "doc_id", "held_out", "score", "predicted")
    assert got[1] == got[2] or (got[1][0][1], got[2][0][1]) == (0.0, 0.0)
    assert len(got[3]) == 2 and got[3][0][2] == 1 and got[None][0][0] is False and got[None][0][2] == 1
    column = by_id(docs.select("doc_id", scorer(automaton)("text").alias("value")), "doc_id", "value")
    assert column[3] == [got[3][0][1]] * 2 and column[1] == [0.0]
    assert score(docs.limit(0), automaton).count() == 0
    assert learn(docs.limit(0), labels.limit(0)).match("idiot") is not None
