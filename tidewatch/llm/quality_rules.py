"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Documents on which cost and selectivity of the rules are measured, at most, and the input partitions they come from.
SAMPLE_ROWS, SAMPLE_PARTITIONS = 2048, 64
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
# An odd factor for the rolling hash of word windows.
_FACTOR = 0x9E3779B97F4A7C15


class Text:
    """One text and its statistics, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: at ASCII white space

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.uint64, count=self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        places = self.n_words - WINDOW + 1
        if places < 2:
            return 0
        ids, rolled = self.word_ids + np.uint64(1), np.zeros(places, dtype=np.uint64)
        for step in range(WINDOW):
            rolled = rolled * np.uint64(_FACTOR) + ids[step : step + places]
            rolled ^= rolled >> np.uint64(29)
        _, which, counts = np.unique(rolled, return_inverse=True, return_counts=True)
        marks = np.zeros(self.n_words + 1, dtype=np.int64)
        starts = np.flatnonzero(counts[which] > 1)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + WINDOW, -1)
        return int((np.cumsum(marks[:-1]) > 0).sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return int((self.word_ids[1:] == self.word_ids[:-1]).sum())

    @cached_property
    def n_exclamations(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, bytes(range(65, 91))))


class Rule(NamedTuple):
    """A reason to reject a document."""

    name: str
    rejects: Callable[[Text], bool]


RULES = [
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("stutter", lambda t: 10 * t.n_stutters > 3 * t.n_words),
    Rule("exclamations", lambda t: 2 * t.n_exclamations > t.n_words),
    Rule("capitals", lambda t: 2 * t.n_capitals > t.word_chars),
    # Scripts without spaces have long words; they take several bytes a character.
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words and len(t.raw) < 1.5 * len(t.text)),
]
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_order(documents: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, the best rejection per cost first, measured on a sample.

    The sample is the first rows of up to 64 evenly spread input partitions; the rest
    is not read. Each rule is measured on its own, with the statistics it needs.
    Rules that reject nothing come last, the cheapest first. The order changes the
    work, not the verdict.
    """
    partitions = max(1, documents.rdd.getNumPartitions())
    stride = -(-partitions // SAMPLE_PARTITIONS)
    each = max(1, sample_rows // -(-partitions // stride))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        left = each
        for batch in batches:
            texts = batch["text"].slice(0, left).to_pylist()
            rows = []
            for rule in rules:
                began = time.perf_counter()
                rejected = sum(rule.rejects(Text(x)) for x in texts)
                rows.append({"name": rule.name, "seconds": time.perf_counter() - began, "rejected": rejected})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64())]))
            left -= len(texts)
            if left <= 0:
                return

    measured = documents.select("text").mapInArrow(measure, "name string, seconds double, rejected long")
    found = {r[0]: (r[1], r[2]) for r in measured.groupBy("name").agg(F.sum("seconds"), F.sum("rejected")).collect()}

    def rank(rule: Rule) -> tuple:
        seconds, rejected = found.get(rule.name, (0.0, 0))
        return (-rejected / max(seconds, 1e-9), seconds)

    return [r.name for r in sorted(rules, key=rank)]


def judge(documents: DataFrame, rules: list[Rule] = RULES, statistics: tuple[str, ...] = STATISTICS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, the statistics, kept, rejected_by, n_tested.

    The rules are tested in the order of ``rule_order``, and the first that rejects
    ends the test, so rejected_by (null if kept) may differ between orders while
    kept does not. ``statistics`` name properties of ``Text`` that are returned for
    every document. Null texts count as empty, and are rejected by the word count.
    Repeated rows each get their row; other columns are ignored.
    """
    by_name = {r.name: r for r in rules}
    order = [by_name[n] for n in rule_order(documents, rules, sample_rows)]
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", *statistics, "kept", "rejected_by", "n_tested"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[list[int]] = [[] for _ in statistics]
            reasons, tested = [], []
            for item in batch["text"]:
                text = Text(item.as_py())
                at = next((i for i, rule in enumerate(order) if rule.rejects(text)), len(order))
                reasons.append(order[at].name if at < len(order) else None)
                tested.append(min(at + 1, len(order)))
                for column, name in zip(values, statistics):
                    column.append(getattr(text, name))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], *(pa.array(v, pa.int64()) for v in values), pa.array([r is None for r in reasons], pa.bool_()),
                    pa.array(reasons, pa.string()), pa.array(tested, pa.int32()),
                ],
                fields,
            )

    columns = "".join(f"{name} long, " for name in statistics)
    return documents.select("doc_id", "text").mapInArrow(test, f"doc_id {kind}, {columns}kept boolean, rejected_by string, n_tested int")
