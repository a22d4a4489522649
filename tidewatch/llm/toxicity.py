"""Toxicity: misspelled terms by a Levenshtein automaton over a lexicon trie, scored in context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.labels import held_out, training_rows
from tidewatch.session import release, written

#: Labelled rows the lexicon is learned from, at most.
TRAINING_ROWS = 20_000
#: A learned term stands in so many toxic training texts, and so many times as often as in others.
LEAST_TEXTS, LEAST_RATIO = 6, 20.0
#: A stem is a word beginning with so many different endings, and stands out further.
LEAST_ENDINGS, STEM_RATIO = 5, 100.0
#: Lengths of stems.
STEMS = (4, 5, 6)
#: One clean text in so many is counted first: what fails by these fails by all.
FIRST = 10
#: A term that more ordinary words are near to is not looked for with misspellings.
MOST_NEIGHBOURS = 2
#: Abusive words that need no labels.
LEXICON = ("idiot", "moron", "scum", "loser", "pathetic", "worthless", "disgusting", "stupid", "imbecile", "bastard", "asshole", "trottel", "connard", "gilipollas")
#: Words before a term that report it, and words around it that aim it at someone.
REPORTING = frozenset(("said", "says", "wrote", "called", "quote", "quoted", "quoting", "word", "term", "phrase", "sagte", "schrieb", "dijo", "dit", "palabra", "mot", "wort"))
ADDRESSING = frozenset(("you", "your", "youre", "du", "dein", "ihr", "tu", "ton", "vous", "eres", "usted"))
#: Context factors, words on either side that are looked at, and the score's growth with the sum.
QUOTED, REPORTED, ADDRESSED, AROUND, GROWTH = 0.2, 0.4, 1.3, 6, 1.24
#: Words on either side that tell a copy of a place from another place.
BESIDE = 4
#: A misspelled term counts this much of the term.
MISSPELLED = 0.5
_WORDS = re.compile(r"[^\W\d_]+")
_QUOTES = {"“": "”", "«": "»", "„": "“", "‘": "’", '"': '"'}
#: Words and states that a worker remembers before it starts afresh.
_REMEMBERED, _STATES = 200_000, 50_000


class Term(NamedTuple):
    text: str
    weight: float
    stem: bool
    exact: bool = False


class Found(NamedTuple):
    term: str
    weight: float
    edits: int


def allowed_edits(term: Term) -> int:
    """None for short or exact terms and stems, one for others, two for long ones."""
    if term.stem or term.exact or len(term.text) < 5:
        return 0
    return 1 if len(term.text) < 10 else 2


class Automaton:
    """All terms with their misspellings: trie places with edits used, determined state by state as words need them."""

    def __init__(self, terms: list[Term], not_terms: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[Term | None] = [None]
        self.room: list[int] = [0]  # the most edits that a term below allows
        self.not_terms = not_terms
        for term in sorted(terms, key=lambda t: (t.text, t.stem)):
            node = 0
            self.room[0] = max(self.room[0], allowed_edits(term))
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.room.append(0)
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], allowed_edits(term))
            self.ends[node] = term
        self.steps: dict[frozenset, dict[str, frozenset]] = {}
        self.accepted: dict[frozenset, tuple[Found | None, Found | None]] = {}
        self.known: dict[str, Found | None] = {}
        self.start = self._closed({0: 0})

    def _closed(self, places: dict[int, int]) -> frozenset:
        """With the places reached by leaving out letters of a term."""
        todo = list(places.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and places.get(child, 99) > edits + 1:
                    places[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(places.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        places: dict[int, int] = {}
        for node, edits in state:
            if edits + 1 <= self.room[node]:  # an extra letter
                places[node] = min(places.get(node, 99), edits + 1)
            for key, child in self.children[node].items():  # the letter, or another in its place
                cost = edits + (key != letter)
                if cost <= self.room[child]:
                    places[child] = min(places.get(child, 99), cost)
        return self._closed(places)

    def _accept(self, state: frozenset) -> tuple[Found | None, Found | None]:
        """The nearest term that ends here, and the nearest stem."""
        if state not in self.accepted:
            best: list[Found | None] = [None, None]
            for node, edits in state:
                term = self.ends[node]
                if term and edits <= allowed_edits(term):
                    found = Found(term.text, term.weight * (MISSPELLED if edits else 1.0), edits)
                    old = best[term.stem]
                    if old is None or (found.edits, -found.weight, found.term) < (old.edits, -old.weight, old.term):
                        best[term.stem] = found
            self.accepted[state] = (best[0], best[1])
        return self.accepted[state]

    def match(self, word: str) -> Found | None:
        """The term that a lower-case word is or misspells, or whose stem it begins with."""
        if word in self.known:
            return self.known[word]
        state, stem = self.start, None
        for letter in word:
            steps = self.steps.setdefault(state, {})
            after = steps.get(letter)
            if after is None:
                after = steps[letter] = self._step(state, letter)
            state = after
            if not state:
                break
            stem = stem or self._accept(state)[1]
        found = (self._accept(state)[0] if state else None) or stem
        if found and found.edits and word in self.not_terms:
            found = None
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        if len(self.steps) >= _STATES:
            self.steps.clear()
            self.accepted.clear()
        self.known[word] = found
        return found


def _quoted(line: str, start: int, end: int) -> bool:
    """Whether a quotation opens before the place in its line and closes behind it."""
    for opening, closing in _QUOTES.items():
        if opening == closing:
            if line.count(opening, 0, start) % 2 and opening in line[end:]:
                return True
        elif line.rfind(opening, 0, start) > line.rfind(closing, 0, start) and closing in line[end:]:
            return True
    return False


def rate(text: str, automaton: Automaton) -> tuple[float, list[tuple[str, int, int, float]]]:
    """The score of one text and its terms: term, first character, edits, weight in context."""
    lowered = text.lower()
    if not any(map(automaton.match, set(_WORDS.findall(lowered)))):
        return 0.0, []
    total, places = 0.0, []
    at = 0
    for line in lowered.split("\n"):
        words = list(_WORDS.finditer(line))
        for i, word in enumerate(words):
            found = automaton.match(word.group())
            if not found:
                continue
            before = [w.group() for w in words[max(0, i - AROUND) : i]]
            behind = [w.group() for w in words[i + 1 : i + 1 + AROUND]]
            factor = 1.0
            if _quoted(line, word.start(), word.end()):
                factor = QUOTED
            elif REPORTING.intersection(before):
                factor = REPORTED
            elif ADDRESSING.intersection(before) or ADDRESSING.intersection(behind):
                factor = ADDRESSED
            total += found.weight * factor
            places.append((found.term, at + word.start(), found.edits, found.weight * factor))
        at += len(line) + 1
    return 1 - math.exp(-GROWTH * total), places


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a text at its first place, with hashes of the text and of the ``BESIDE`` words before and behind it; of the text where there are none."""
    for batch in batches:
        for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
            found = _WORDS.findall(text.lower())
            if not found:
                continue
            first = {word: i for i, word in reversed(list(enumerate(found)))}
            of = xxhash.xxh3_64_intdigest(text.encode())
            hashes = [
                [xxhash.xxh3_64_intdigest(" ".join(w).encode()) if w else of for w in sides]
                for sides in ((found[max(0, i - BESIDE) : i] for i in first.values()), (found[i + 1 : i + 1 + BESIDE] for i in first.values()))
            ]
            columns = [pa.array([label] * len(first), pa.int32()), pa.array(list(first), pa.string())]
            columns += [pa.array(h, pa.uint64()).view(pa.int64()) for h in ([of] * len(first), *hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "word", "of", "before", "behind"])


def _surroundings(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): copied words stand between the same words, so a word counts once for each surrounding, on the side with fewer."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("hash")) for i, c in enumerate(("of", "before", "behind"))]))
    single = rows.select(key, sides.alias("at")).select(key, "at.*").distinct()
    return single.groupBy(key, "side").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.min("n").alias("n"))


def _standing_out(rows: DataFrame, keys: DataFrame, key: str, toxic: int, clean: int, ratio: float) -> list[tuple[str, float, int]]:
    """(key, weight, n_toxic) of the ``keys`` whose surroundings are so many times as frequent in toxic texts.

    Toxic texts are counted first, then a part of the clean ones, then all of these: each
    step counts only what the one before could not rule out, since a part never has more
    surroundings than the whole. The keys are a part of the bounded sample's.
    """
    def stands(n_toxic, n_clean):
        return (n_toxic >= LEAST_TEXTS) & (n_toxic / max(toxic, 1) >= ratio * (n_clean + 0.5) / (clean + 1))

    among = rows.join(F.broadcast(keys), key, "left_semi")
    left = _surroundings(among.filter("label = 1"), key).withColumnRenamed("n", "n_toxic").filter(stands(F.col("n_toxic"), F.lit(0)))
    left = written(left, "toxic-counts")
    tables = [left]
    for part in (F.pmod("of", F.lit(FIRST)) == 0, F.lit(True)):
        some = rows.filter((F.col("label") == 0) & part).join(F.broadcast(left.select(key)), key, "left_semi")
        counts = _surroundings(some, key).withColumnRenamed("n", "n_clean")
        left = left.select(key, "n_toxic").join(counts, key, "left").withColumn("n_clean", F.coalesce("n_clean", F.lit(0)))
        left = written(left.filter(stands(F.col("n_toxic"), F.col("n_clean"))), "clean-counts")
        tables.append(left)
    weight = F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean") + 0.3)
    found = [tuple(r) for r in left.select(key, weight, "n_toxic").collect()]
    release(*tables)
    return found


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS, lexicon: tuple[str, ...] = LEXICON) -> Automaton:
    """An automaton of ``lexicon`` and of words and stems that mark toxic texts among at most ``rows`` labelled ones.

    A word counts once for each surrounding it has, so that the words of a copied text
    are not taken for terms; all distinct texts are trained on. Words of texts that are not toxic are no
    misspellings. Everything the driver gets comes from the bounded sample.
    """
    texts = training_rows(documents, labels, label, rows)
    # The documents are read once for the sample; everything below reads the sample.
    texts = written(texts.select("label", "text").dropDuplicates(["label", "text"]), "training")
    words = written(texts.mapInArrow(_placed, "label int, word string, of long, before long, behind long"), "words")
    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    plain = written(words.groupBy("word").agg(F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_clean")), "counts")
    # No word or stem has more toxic surroundings than toxic texts, so those in too few texts are out from the start.
    often = plain.filter(F.col("in_toxic") >= LEAST_TEXTS).select("word")
    counted = _standing_out(words, often, "word", toxic, clean, LEAST_RATIO)
    begun = plain.filter("in_toxic > 0").select("word", "in_toxic", F.explode(F.array(*[F.substring("word", 1, n) for n in STEMS])).alias("stem"))
    stems = begun.filter(F.length("word") > F.length("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("endings"), F.sum("in_toxic").alias("most"))
    stems = stems.filter((F.col("endings") >= LEAST_ENDINGS) & (F.col("most") >= LEAST_TEXTS)).select("stem")
    begins = words.withColumn("stem", F.explode(F.array(*[F.substring("word", 1, n) for n in STEMS]))).filter(F.length("word") > F.length("stem"))
    found = _standing_out(begins, stems, "stem", toxic, clean, STEM_RATIO)
    # A longer stem that stands in as good as all the texts is clearer; else the shortest stands for longer ones.
    texts_of = {r[0]: r[2] for r in found}
    vague = {s[:n] for s, count in texts_of.items() for n in range(4, len(s)) if count >= 0.95 * texts_of.get(s[:n], math.inf)}
    clear = {s for s in texts_of if s not in vague}
    stems = [Term(r[0], r[1], True) for r in found if r[0] in clear and not any(r[0][:n] in clear for n in range(4, len(r[0])))]
    terms = {r[0]: Term(r[0], r[1], False) for r in counted if len(r[0]) >= 3}
    common = {r[0] for r in plain.filter(F.col("word").isin(*lexicon) & (F.col("in_clean") > 0)).select("word").collect()} - set(terms) if lexicon else set()
    for word in lexicon:
        if word not in common:
            terms.setdefault(word, Term(word, 1.0, False))
    own = [t for t in terms.values() if not any(t.text.startswith(s.text) for s in stems)]
    nearby = Automaton([*own, *stems])
    ordinary = plain.filter("in_clean > 0").select("word")

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, f.term) for w in batch["word"].to_pylist() if (f := nearby.match(w)) and f.edits]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["word", "term"])

    neighbours = [tuple(r) for r in ordinary.mapInArrow(misread, "word string, term string").collect()]
    release(texts, words, plain)
    crowded = Counter(term for _, term in neighbours)
    own = [t._replace(exact=crowded[t.text] > MOST_NEIGHBOURS) for t in own]
    return Automaton([*own, *stems], frozenset(word for word, _ in neighbours))


def score(documents: DataFrame, automaton: Automaton, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted, terms.

    terms are the places of terms: term, first character, edits, and weight in
    context (quoted and reported terms count less, terms aimed at someone more).
    The score grows from 0 without terms towards 1 with the sum of the weights.
    Null and empty texts have none. Repeated rows each get their row; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(automaton)  # grows with the bounded sample only
    term = pa.struct([("term", pa.string()), ("start", pa.int64()), ("edits", pa.int64()), ("weight", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rated = [rate(x.as_py() or "", shared.value) for x in batch["text"]]
            places = [[dict(zip(("term", "start", "edits", "weight"), p)) for p in found] for _, found in rated]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([s for s, _ in rated], pa.float64()), pa.array(places, pa.list_(term))], ["doc_id", "score", "terms"]
            )

    rows = documents.select("doc_id", "text").mapInArrow(
        apply, f"doc_id {kind}, score double, terms array<struct<term string, start long, edits long, weight double>>"
    )
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")


def scorer(automaton: Automaton):
    """A column function: the score of a text column, as ``score`` gives it."""
    shared = SparkSession.active().sparkContext.broadcast(automaton)

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: rate(x or "", shared.value)[0]).astype("float64")

    return rated
