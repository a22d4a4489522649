"""License notices: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, as words, that are also found with a few wrong characters, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
    "mozilla public license version 2 0": "mpl-2.0",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
}
#: Of so many characters of a notice one may be inserted, deleted or replaced.
CHARS_PER_EDIT = 12
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


class Place(NamedTuple):
    label: str
    first_word: int
    n_words: int
    edits: int


class _Search(NamedTuple):
    seeds: ahocorasick.Automaton
    patterns: list[tuple[str, str, int, regex.Pattern]]


@lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str], ...], chars_per_edit: int) -> _Search:
    """Seeds of all notices in one automaton, and a bounded-error pattern for each."""
    seeds, patterns = ahocorasick.Automaton(), []
    places: dict[str, list[tuple[int, int]]] = {}
    for at, (notice, label) in enumerate(notices):
        most = len(notice) // chars_per_edit
        # With at most so many edits, one of most + 1 pieces is unchanged.
        cuts = [len(notice) * i // (most + 1) for i in range(most + 2)]
        for start, end in zip(cuts, cuts[1:]):
            places.setdefault(notice[start:end], []).append((at, start))
        pattern = regex.compile(rf"(?<![^ ])(?:{regex.escape(notice)}){{e<={most}}}(?![^ ])", regex.BESTMATCH)
        patterns.append((notice, label, most, pattern))
    for seed, found in places.items():
        seeds.add_word(seed, (len(seed), found))
    seeds.make_automaton()
    return _Search(seeds, patterns)


def find_notices(joined: str, search: _Search) -> list[Place]:
    """Notices in words joined by single spaces: seeds give windows, the pattern verifies each window."""
    windows: dict[int, list[list[int]]] = {}
    for end, (length, found) in search.seeds.iter(joined):
        for at, start in found:
            notice, _, most, _ = search.patterns[at]
            begin = end + 1 - length - start - most
            stretch = windows.setdefault(at, [])
            low, high = max(0, begin - 1), begin + len(notice) + 2 * most + 1
            if stretch and low <= stretch[-1][1]:
                stretch[-1] = [min(stretch[-1][0], low), max(stretch[-1][1], high)]
            else:
                stretch.append([low, high])
    found = []
    for at, stretches in windows.items():
        _, label, _, pattern = search.patterns[at]
        for low, high in stretches:
            for match in pattern.finditer(joined, low, min(high, len(joined))):
                if match.group().strip():
                    found.append((match.start(), len(match.group().split()), sum(match.fuzzy_counts), label))
    places, before, last = [], 0, 0
    for start, n_words, edits, label in sorted(found):
        before, last = before + joined.count(" ", last, start), start
        places.append(Place(label, before, n_words, edits))
    # Of notices that overlap, such as two versions of one license, the closest stays.
    kept: list[Place] = []
    for place in sorted(places, key=lambda p: (p.edits, -p.n_words, p.first_word, p.label)):
        at = bisect(kept, place.first_word, key=lambda k: k.first_word)
        left = kept[at - 1] if at else None
        right = kept[at] if at < len(kept) else None
        if (left is None or left.first_word + left.n_words <= place.first_word) and (
            right is None or place.first_word + place.n_words <= right.first_word
        ):
            kept.insert(at, place)
    return kept


def _phrase_starts(joined: str, phrase: str) -> list[int]:
    """Word positions at which the phrase's words stand consecutively."""
    padded, wanted, starts = f" {joined} ", f" {phrase} ", []
    at, before, last = padded.find(wanted), 0, 0
    while at >= 0:
        before += padded.count(" ", last, at)
        starts.append(before)
        last, at = at, padded.find(wanted, at + 1)
    return starts


def scan(
    documents: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT
) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Texts are lower-cased (A-Z) and cut into words of 0-9, a-z and characters beyond ASCII.
    n_base counts the places where a phrase's words stand consecutively, first_word
    and last_word are the smallest and largest of their starts (null without any).
    places are the notices found with at most one edit in ``chars_per_edit`` characters:
    label, first word, words and edits. labels are those of both kinds. score is 1 with
    a phrase, else the best share of unedited characters of a notice, else 0.
    Null texts count as empty. Repeated rows each get their row; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    listed = tuple(notices.items())
    length = {label: len(notice) for notice, label in listed}
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
    fields = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "places": pa.list_(place),
    }

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch["text"]:
                words = _WORDS.findall((item.as_py() or "").encode().lower())
                joined = b" ".join(words).decode()
                base = {label: _phrase_starts(joined, phrase) for phrase, label in phrases.items()}
                starts = [s for found in base.values() for s in found]
                base_labels = {label for label, found in base.items() if found}
                places = find_notices(joined, _search(listed, chars_per_edit))
                best = max((1 - p.edits / length[p.label] for p in places), default=0.0)
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base_labels),
                    sorted(base_labels | {p.label for p in places}), 1.0 if starts else max(0.0, best), [p._asdict() for p in places],
                ))
            columns = zip(*rows) if rows else [[] for _ in fields]
            arrays = [pa.array(list(column), of) for column, of in zip(columns, fields.values())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *fields])

    return documents.select("doc_id", "text").mapInArrow(
        search,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double, places array<struct<label string, first_word long, n_words long, edits long>>",
    )
