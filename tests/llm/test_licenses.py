import re

from tests.llm.conftest import by_id
from tidewatch.llm.licenses import CHARS_PER_EDIT, NOTICES, PHRASES, _search, find_notices, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


TEXTS = [
    None, "", "!!", "CC-BY 4.0", "cc by cc by\ncc, by", "The MIT License (MIT license)", "gnu general public licenses", "É Apache_License é",
    "Licensed under the Apache License, Version 2.0.", "Licenced undr the Apache Licence, Version 2.0.", "word " * 60_000 + "apache license",
    "mit license " * 5000, "Released under the MITT licence!", "GNU General Public License, version 3; licensed under the gnu general public license version 3",
]


def test_texts(make):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[5])]
    got = by_id(scan(make(rows, "doc_id long, text string")), "doc_id", *FIELDS, "places")
    for i, text in enumerate(TEXTS):
        assert got[i][0][:5] == brute(text), i
        assert set(got[i][0][4]) <= set(got[i][0][5]) and 0 <= got[i][0][6] <= 1
    assert len(got[3]) == 2 and got[None][0][1] == 2
    assert got[9][0][5] == ["apache-2.0"] and 0.9 < got[9][0][6] < 1 and got[9][0][7][0]["first_word"] == 0 and got[9][0][7][0]["n_words"] == 8
    assert got[12][0][5] == ["mit-notice"] and got[6][0][5] == [] and got[0][0][6] == 0
    assert scan(make([], "doc_id long, text string")).count() == 0


def test_every_notice_with_edits():
    """One wrong character in each stretch that allows one, at every place."""
    search = _search(tuple(NOTICES.items()), CHARS_PER_EDIT)
    for notice, label in NOTICES.items():
        most = len(notice) // CHARS_PER_EDIT
        for shift in range(0, CHARS_PER_EDIT):
            letters = list(notice)
            for k in range(most):
                at = min(len(notice) - 1, shift + k * CHARS_PER_EDIT)
                letters[at] = "q" if letters[at] != " " else "q"
            found = find_notices("before it " + "".join(letters) + " and after", search)
            assert any(p.label == label for p in found), (notice, "".join(letters), found)


def test_notices_stay_apart():
    search = _search(tuple(NOTICES.items()), CHARS_PER_EDIT)
    three = "licensed under the gnu general public license version 3"
    assert [p.label for p in find_notices(three, search)] == ["gpl-3.0"]
    assert len(find_notices(" x ".join([three] * 300), search)) == 300
