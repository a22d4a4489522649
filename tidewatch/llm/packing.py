"""Packing of tokenized documents into sequences by length patterns and non-negative least squares."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from tidewatch.llm.bpe import split_words
from tidewatch.session import written

#: Tokens in a sequence, and the id that ends a document.
SIZE, END_ID = 4096, 1
#: Documents in an enumerated pattern, and partners tried for each length of a pattern of three.
MOST_DOCUMENTS, PARTNERS = 3, 12
#: Steps of the least-squares solver; what it leaves is packed all the same.
STEPS = 400
#: Shares of each length that patterns leave, so that what is packed after them still has short documents for the gaps; the best of them is taken.
RESERVES = (0.05, 0.3, 0.7)
#: Words a worker remembers before it starts afresh; this bounds memory and changes no result.
REMEMBERED = 600_000
#: Rows of one Arrow batch.
_ROWS = 4096
_END_OF_WORD = "</w>"
#: To the tokenizer's rules a run of these letters is one word, and so is a run of these marks behind it.
_LETTERS, _MARKS = "a-zß-öø-ÿ", ".,;:!?%$&()*#\"-"
_PLAIN = re.compile(f"[{_LETTERS}]+|[{re.escape(_MARKS)}]+").fullmatch
_MARK = f"[{re.escape(_MARKS)}]"
_MARKED = re.compile(f"{_MARK}(?<=[{_LETTERS}]{_MARK}){_MARK}*(?=[ \n\t\r]|\\Z)")
_BEYOND_LATIN = re.compile("[^\x00-\xff]").search


class WordCoder:
    """ids of whole texts, word by word, as the tokenizer in ``path`` gives them.

    A word is what stands between white space; no token crosses it. In texts of Latin letters the
    marks that end a word are words of their own, as the tokenizer takes them. Words of Latin letters, and such marks, are
    encoded in large batches by the same model without the regular expressions of the full
    tokenizer; all others go through the full tokenizer word by word. Each word is encoded
    once until the memory is emptied.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.remembered = remembered
        self.words: dict[str, bytes] = {}
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(_END_OF_WORD)]] = True
        self.fast = Tokenizer(self.full.model)
        self.fast.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.short = self._agrees()
        self.words.clear()

    def _agrees(self) -> bool:
        """Whether this tokenizer has the rules that the short way stands for."""
        probe = ["Harbour", "été.", "Größe,", "tide%%%", "x", 'q"', "mooring-", "zz*#", "ÀÖØöøÿ", "a(;b", "a. b"]
        for text in probe:
            words = _MARKED.sub(r" \g<0>", text.lower()).split()
            plain = [w for w in words if _PLAIN(w)]
            self._learn_plain(plain)
            expected = np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            if len(plain) == len(words) and b"".join(self.words.get(w, b"") for w in words) != expected:
                return False
        return True

    def _learn_plain(self, plain: list[str]) -> list[str]:
        """Remember plain words; returns those that the model spells otherwise than with one ending piece."""
        words, unclear = self.words, []
        chunks = [plain[i : i + 1024] for i in range(0, len(plain), 1024)]
        for chunk, code in zip(chunks, self.fast.encode_batch([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(code.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(chunk):
                unclear += chunk
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(chunk, (4 * last + 4).tolist()):
                words[word] = raw[start:end]
                start = end
        return unclear

    def _learn(self, new: list[str]) -> None:
        short = _PLAIN if self.short else lambda _: None
        plain = [w for w in new if len(w) < 256 and short(w)]
        others = [w for w in new if not (len(w) < 256 and short(w))] if len(plain) < len(new) else []
        others += self._learn_plain(plain)
        for word, code in zip(others, self.full.encode_batch(others, add_special_tokens=False)):
            self.words[word] = np.array(code.ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; texts of a batch share one round of encoding."""
        cut = [self._cut(x) for x in texts]
        if len(self.words) > self.remembered:
            self.words.clear()
        new: set[str] = set()
        for words in cut:
            new.update(words)
        known = self.words
        unknown = [w for w in new if w not in known]
        if unknown:
            self._learn(unknown)
        here = {w: known[w] for w in new}  # small enough for the processor's cache
        for words in cut:
            yield b"".join(map(here.__getitem__, words))

    def _cut(self, text: str) -> list[str]:
        """Words of a text. One of Latin letters is lowered first, as the tokenizer does itself; special tokens are matched before that."""
        if self.short and "<|" not in text and (text.isascii() or not _BEYOND_LATIN(text)):
            text = _MARKED.sub(r" \g<0>", text.lower())
        return split_words(text)


@lru_cache(maxsize=1)
def _coder(path: str) -> WordCoder:
    """Once per Python worker."""
    return WordCoder(path)


def cut_pieces(documents: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokenized documents, each with ``end_id`` behind it, cut after every ``size`` ids.

    Null and empty texts have the one id ``end_id``. Repeated rows each have their
    pieces; other columns are ignored. Texts are taken whole, a few megabytes at a time.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        """Runs of rows with some megabytes of text."""
        start, texts, held = 0, [], 0
        for at, x in enumerate(batch["text"]):
            texts.append(x.as_py() or "")
            held += len(texts[-1])
            if held > 1 << 22:
                yield start, texts
                start, texts, held = at + 1, [], 0
        if texts:
            yield start, texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for first, texts in groups(batch):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for at, coded in enumerate(coder.ids(texts)):
                    coded += end
                    for begin in range(0, len(coded), 4 * size):
                        part = coded[begin : begin + 4 * size] if len(coded) > 4 * size else coded
                        rows.append(first + at)
                        piece.append(begin // (4 * size))
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(cut, fields)


def patterns(lengths: np.ndarray, size: int = SIZE, partners: int = PARTNERS) -> np.ndarray:
    """Rows of up to three lengths (descending, 0 for none) that fill ``size`` exactly.

    ``lengths`` are the distinct lengths below ``size``. All pairs are listed. For three,
    each length is tried as the largest with ``partners`` others, spread evenly over those that leave a length that occurs.
    """
    have = np.zeros(size + 1, dtype=bool)
    have[lengths] = True
    found = [(int(a), int(size - a), 0) for a in lengths if a >= size - a and have[size - a]]
    if MOST_DOCUMENTS >= 3:
        for a in lengths.tolist():
            rest = size - a
            middle = lengths[(lengths <= min(a, rest - 1)) & (lengths >= rest - lengths)]
            middle = middle[have[rest - middle]]
            if len(middle):
                for b in middle[np.unique(np.linspace(0, len(middle) - 1, partners).astype(int))].tolist():
                    found.append((a, b, rest - b))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts of the patterns whose lengths add up closest to the histogram.

    Weighted least squares by accelerated projected gradients; long documents weigh
    more, since short ones left over are easy to place. ``histogram[n]`` counts length n.
    """
    if not len(rows):
        return np.zeros(0)
    size = len(histogram) - 1
    weight = 0.1 + np.arange(size + 1) / size
    weight[0] = 0
    target = weight * histogram
    flat, n = rows.ravel(), len(rows)

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * np.bincount(flat, weights=np.repeat(x, rows.shape[1]), minlength=size + 1)

    def backward(r: np.ndarray) -> np.ndarray:
        return (weight * r)[rows].sum(axis=1)

    # Steps per pattern, by how crowded its lengths are: a diagonal bound of the curvature.
    crowd = np.bincount(flat, minlength=size + 1) * weight**2
    step = 1.0 / (rows.shape[1] * np.maximum(crowd[rows].max(axis=1), 1e-12))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        after = np.maximum(y - step * backward(forward(y) - target), 0.0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def round_counts(rows: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that use no length more often than it occurs, and the histogram of what is left.

    Counts are cut to whole numbers; then, by falling fraction, each pattern is repeated once more where all its lengths are left.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max // 4
    whole = np.zeros(len(rows), dtype=np.int64)

    def use(i: int, most: int) -> None:
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(most, *(left[lengths] // times)))
        if n > 0:
            whole[i] += n
            left[lengths] -= n * times

    for i in np.flatnonzero(counts >= 1).tolist():
        use(i, int(counts[i]))
    fraction = counts - np.floor(counts)
    for i in np.argsort(-fraction, kind="stable").tolist():
        if fraction[i] < 0.5:
            break
        use(i, 1)
    left[0] = 0
    return whole, left


def pack_residual(left: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: (sequences, [(length, times), ...]) for groups of like sequences.

    Equal sequences are one group, so the work and the result grow with the number of
    lengths and not with that of documents.
    """
    rooms: list[int] = []  # sorted room left
    groups: dict[int, list[tuple[int, tuple]]] = {}
    full: list[tuple[int, tuple]] = []

    def put(room: int, n: int, held: tuple) -> None:
        if room == 0:
            full.append((n, held))
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((n, held))

    def place(length: int, count: int, room: int, n: int, held: tuple) -> int:
        """Fill ``n`` like sequences with up to ``count`` documents; what is left to place."""
        times = room // length
        whole = min(n, count // times)
        if whole:
            put(room - times * length, whole, (*held, (length, times)))
        count -= whole * times
        if whole < n:
            if count:
                put(room - count * length, 1, (*held, (length, count)))
                count, whole = 0, whole + 1
            if whole < n and held:
                put(room, n - whole, held)
        return count

    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                count = place(length, count, size, -(-count // (size // length)), ())
                continue
            room = rooms[at]
            n, held = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            count = place(length, count, room, n, held)
    return [(n, list(held)) for n, held in full + [g for some in groups.values() for g in some]]


def plan(histogram: dict[int, int], size: int = SIZE, reserves: tuple[float, ...] = RESERVES) -> dict[str, np.ndarray]:
    """Slots in the order of (length, first): documents first, first+1, ... of a length go to sequence
    base + i // times at offset + (i % times) * length, where i counts from the slot's first document.

    The slots fix the whole packing. Their number grows with the number of lengths, at most ``size``.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rows = patterns(np.flatnonzero(counts[:size]), size)
    fitted = fit_counts(rows, counts)
    tried = []
    for reserve in reserves:
        wanted = np.ceil(counts * (1 - reserve)).astype(np.int64)
        repeats, left = round_counts(rows, fitted * (1 - reserve), wanted)
        groups = [(int(n), [(int(x), 1) for x in row if x]) for row, n in zip(rows[repeats > 0], repeats[repeats > 0])]
        tried.append(groups + pack_residual(left + counts - wanted, size))
    groups = min(tried, key=lambda some: sum(n for n, _ in some))
    taken = np.zeros(size + 1, dtype=np.int64)
    slots, base = [], 0
    for n, held in groups:
        offset = 0
        for length, times in held:
            slots.append((length, int(taken[length]), base, times, offset))
            taken[length] += n * times
            offset += length * times
        base += n
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "offset"), table.T))


def pack(documents: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): the pieces of ``cut_pieces``, packed into sequences of at most ``size`` ids.

    Patterns of two and three lengths that fill a sequence exactly are enumerated, their
    repeat counts are fitted to the histogram of lengths by non-negative least squares and
    rounded, and what is left is packed by best fit on the histogram. All that reaches the
    driver is the histogram, one number per length. Pieces are then numbered within their
    length, in slices by the partition that made them, and the n-th piece of a length
    takes the n-th place that the plan has for it.

    Null texts count as empty. Of pieces of one length any may take any place: repeated
    rows and ties change nothing else. An empty table gives an empty one. Other columns
    are ignored. Pieces are written once, so lost executors change no place.
    """
    if not 0 < size < 1 << 20:
        raise ValueError("size must be below 2^20")
    spark = documents.sparkSession
    made = cut_pieces(documents, path, size, end_id, with_ids).withColumn("_at", F.monotonically_increasing_id())
    made = written(made, "pieces")
    plain = made.drop("ids").withColumn("_slice", F.shiftright("_at", 33))
    counts = written(plain.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    slots = spark.sparkContext.broadcast(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("_at")
    ranked = plain.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_at", (F.col("_rank") + F.col("_before")).alias("_rank"))
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        # Length and rank as one sorted number: a length is below 2^20, a rank below 2^43.
        edges = (table["length"] << 43) + table["first"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            slot = np.searchsorted(edges, (length << 43) + rank, side="right") - 1
            inner = rank - table["first"][slot]
            sequence = table["base"][slot] + inner // table["times"][slot]
            offset = table["offset"][slot] + inner % table["times"][slot] * length
            fields = ["doc_id", "piece", "start", "length", "ids_crc32", "_at"]
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in fields), pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {kinds[n]}" for n in ("doc_id", "piece", "start", "length", "ids_crc32", "_at"))
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    if with_ids:
        placed = placed.join(made.select("_at", "ids"), "_at")
    return placed.drop("_at")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, members, ids): whole sequences from ``pack`` with ids; members are (offset, doc_id, piece, length) in order.

    A sequence has a bounded number of ids, so a group is bounded as well.
    """
    member = F.struct("offset", "doc_id", "piece", "length", "ids").alias("member")
    gathered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("members"))
    whole = F.aggregate("members", F.lit(b""), lambda held, m: F.concat(held, m["ids"]))
    return gathered.select(
        "sequence_id", F.aggregate("members", F.lit(0).cast("long"), lambda held, m: held + m["length"]).alias("length"),
        F.transform("members", lambda m: F.struct(m["offset"].alias("offset"), m["doc_id"].alias("doc_id"), m["piece"].alias("piece"), m["length"].alias("length"))).alias("members"),
        whole.alias("ids"),
    )
