"""Prefix trie of conversations: recursive cuts at half depth name the prefixes, and totals are grafted upward."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.numbering import numbered
from tidewatch.session import written

#: Turns in a block. Longer segments are cut by joins, those inside a block by windows.
BLOCK = 1024
#: Conversations that share a base, and the first turns taken from it at most.
FAMILY, HEADS = 20, 4
#: Ids in one piece of a list of ids.
IDS = 1024


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """256 bits of a turn's role and text; null is empty."""
    role_text, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.sha2(F.concat(F.octet_length(role_text).cast("string"), F.lit(":"), role_text, said).cast("binary"), 256)


def count_words(text: str = "text") -> Column:
    """Runs of characters other than space and the ASCII control characters 9 to 13."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position from 1, n_turns, digest, words) of ``turns`` (conv_id, turn, role, text).

    Ordered by turn, null first, ties by digest. Repeated rows are turns of their own. Rows without conv_id are left out.
    """
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.unhex(turn_digest()).alias("digest"), count_words().alias("words")
    )
    placed = numbered(written(rows, "turns"), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "position", "n_turns")
    return placed.select("conv_id", (F.col("position") + 1).alias("position"), "n_turns", "digest", "words")


def head_size(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth from 1, length, digest, words).

    Conversation c begins with the first h turns of conversation c - c % 20 (all if it has
    fewer, none if it is absent), followed by its own turns after its first h; h is the
    unsigned crc32 of its decimal id modulo 4. ``turns`` is the result of ``ordered_turns``.
    """
    convs = turns.filter("position = 1").select("conv_id", F.col("n_turns").alias("own"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base"))
    wanted = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": head_size(F.col("conv_id"))})
    kept = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = wanted.join(lengths, "base", "left").select(
        "conv_id", "base", "h", kept.alias("n_head"), (kept + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    )
    convs = written(convs, "rebuilt")
    # A base has at most three turns here and twenty conversations that take them.
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("position") < HEADS)).select(F.col("conv_id").alias("base"), "position", "digest", "words")
    taken = convs.filter("n_head > 0").join(heads, "base").filter("position <= n_head").select("conv_id", F.col("position").alias("depth"), "length", "digest", "words")
    own = turns.join(convs, "conv_id").filter("position > h").select(
        "conv_id", (F.col("n_head") + F.col("position") - F.col("h")).alias("depth"), "length", "digest", "words"
    )
    return convs.select("conv_id", "length"), taken.unionByName(own)


def _named(salt: int, *parts) -> Column:
    return F.xxhash64(F.lit(salt), *parts)


def name_prefixes(turns: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """``turns`` (conv_id, depth, digest, ...) with a1, a2, the name of the prefix before the turn, and b1, b2, that of the prefix up to it.

    A segment of 2m turns is cut in the middle. Its first half, which hangs below the
    segment's root, names the cut prefix: 128 bits of the root's name and of the half's
    turns. The first halves are the upper trie and keep the root; each second half is
    a sequence of the lower forest below its cut prefix. All segments of a round are cut in parallel, and
    after log2 of the longest conversation every prefix has been the cut of one segment. ``block`` is a power of two.
    """
    zero = F.lit(0).cast("long")
    rows = turns.withColumns({"i": F.col("depth") - 1, "a1": zero, "a2": zero, "b1": zero, "b2": zero})
    rows = rows.withColumns({"x1": _named(1, "depth", "digest"), "x2": _named(2, "digest", "depth"), "block": F.floor(F.col("i") / block)})
    half = 1 << max(0, longest - 1).bit_length()
    while half >= block:
        seg = F.floor(F.col("i") / (2 * half))
        upper = F.floor(F.col("i") / half) % 2 == 0
        cuts = rows.filter(upper).groupBy("conv_id", seg.alias("seg")).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.first("a1").alias("a1"), F.first("a2").alias("a2")
        ).filter(F.col("n") == half)
        first = ((2 * F.col("seg") + 1) * (half // block)).cast("long")
        # A cut goes to the block it ends in and to each block of the second half, so that no join key has more than a block of turns.
        names = cuts.select(
            "conv_id", first.alias("first"), F.explode(F.sequence(first - 1, first + half // block - 1)).alias("block"),
            _named(3, "a1", "a2", "x1", "x2").alias("c1"), _named(4, "a2", "a1", "x2", "x1").alias("c2"),
        )
        below, at_cut = F.col("block") >= F.col("first"), F.col("i") == F.col("first") * block - 1
        rows = rows.join(names, ["conv_id", "block"], "left").withColumns(
            {f"{k}{j}": F.when(where, F.col(f"c{j}")).otherwise(F.col(f"{k}{j}")) for k, where in (("a", below), ("b", at_cut)) for j in (1, 2)}
        ).drop("c1", "c2", "first")
        rows = written(rows, "named")
        half //= 2
    rows = rows.repartition("conv_id", "block")  # all windows below share this shuffle
    while half >= 1:
        segment = Window.partitionBy("conv_id", "block", F.floor(F.col("i") / (2 * half)))
        lower, at_cut = F.floor(F.col("i") / half) % 2 == 1, F.col("i") % (2 * half) == half - 1
        # The first half is whole wherever it is asked for: at its last turn and in the second half.
        s1, s2 = (F.bit_xor(F.when(~lower, F.col(x))).over(segment) for x in ("x1", "x2"))
        rows = rows.withColumns({"s1": s1, "s2": s2})
        rows = rows.withColumns({"c1": _named(3, "a1", "a2", "s1", "s2"), "c2": _named(4, "a2", "a1", "s2", "s1")})
        rows = rows.withColumns(
            {f"{k}{j}": F.when(where, F.col(f"c{j}")).otherwise(F.col(f"{k}{j}")) for k, where in (("a", lower), ("b", at_cut)) for j in (1, 2)}
        ).drop("s1", "s2", "c1", "c2")
        half //= 2
    return rows.drop("i", "x1", "x2", "block")


def _nodes(rows: DataFrame, smallest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, words) below the root, whose conv_id is ``smallest``, and paths (conv, depth, length, node): the node's conv_id for each turn."""
    named = rows.groupBy("depth", "b1", "b2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("a1").alias("a1"), F.first("a2").alias("a2")
    )
    named = written(named, "nodes")
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = named.join(above, ["depth", "a1", "a2"], "left")
    nodes = nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(smallest)).cast("long").alias("parent_conv_id"), "n_convs", "words")
    reps = named.select("depth", "b1", "b2", F.col("conv_id").alias("node"))
    paths = rows.select(F.col("conv_id").alias("conv"), "depth", "length", "b1", "b2").join(reps, ["depth", "b1", "b2"])
    return written(nodes, "trie"), written(paths.select("conv", "depth", "length", "node"), "paths")


def graft(nodes: DataFrame, paths: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, n_leaves, saved_tokens) with the last two summed over each node's subtree.

    The cuts are undone from the shortest segments upward. When segments of m levels join to 2m, the
    roots of the lower forest are summed per cut prefix, and that sum is grafted onto the cut prefix and its
    ancestors in the upper half, the m nodes on the path of its smallest member. After log2 rounds every total is whole.
    """
    m = 1
    while m < longest:
        width = min(m, block)
        lowest = (F.col("depth") - 1) % (2 * m) == m
        grafts = nodes.filter(lowest).groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        # Stretches of the upper half: no join key has more than a block of levels.
        last = F.floor((F.col("cut") - 1) / width)
        grafts = grafts.select("conv", "leaves", "saved", F.explode(F.sequence(last - (m // width - 1), last)).alias("stretch"))
        steps = paths.select("conv", "depth", "node", F.floor((F.col("depth") - 1) / width).alias("stretch"))
        steps = steps.filter(F.floor((F.col("depth") - 1) / m) % 2 == 0)
        added = steps.join(grafts, ["conv", "stretch"]).groupBy(F.col("node").alias("conv_id"), "depth").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        joined = nodes.join(added, ["conv_id", "depth"], "left").withColumns(
            {"n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("saved", F.lit(0))}
        )
        nodes = written(joined.select(*nodes.columns), "grafted")
        m *= 2
    return nodes


def listed_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): sha256 of the members (conv_id, depth, member) of each node, in ascending order, as decimals joined by commas.

    The ids are sorted in ranges, so that a node with very many is spread over tasks, which
    join them to pieces; one digest per node then reads the pieces in order, never holding them all.
    """
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "depth", "member"]
    ranges = ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[str] = []
            node = first = None
            for at, member in zip(zip(*(batch[c].to_pylist() for c in order[:2])), batch["member"].to_pylist()):
                if at != node or len(held) == IDS:
                    if held:
                        rows.append((*node, first, ",".join(held)))
                    node, first, held = at, member, []
                held.append(str(member))
            if held:
                rows.append((*node, first, ",".join(held)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "first", "ids"]
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for at, ids in zip(zip(batch["conv_id"].to_pylist(), batch["depth"].to_pylist()), batch["ids"]):
                if at == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = at, sha256()
                sha.update(ids.as_py().encode())
            yield _digests(done)
        if sha is not None:
            yield _digests([(*node, sha.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    cut = ranges.mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    dealt = cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    A node is a distinct sequence of first turns by role and text, named by its smallest
    member and its depth. n_convs counts the rebuilt conversations that begin with it;
    n_leaves and saved_tokens are sums over its subtree: of childless nodes, and of (n_convs - 1)
    times the words of each node's last text. ends_sha256 is the digest of the conversations that end there.

    Turns are ordered by number, null first, ties by a digest of role and text; null roles
    and texts are empty. Repeated rows are turns of their own. Conversations that have no turn after
    rebuilding are members of the root. Rows without conv_id are left out. An empty table
    has no node. Texts of any length count by their digest; conversations of any length are cut into blocks.
    """
    convs, turns = rebuild(ordered_turns(conversations))
    smallest, n_convs, longest = convs.agg(F.min("conv_id"), F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0))).first()
    rows = written(name_prefixes(turns, longest, block), "prefixes")
    nodes, paths = _nodes(rows, smallest)
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = written(counted.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ), "counted")
    whole = graft(counted, paths, longest, block)
    depth, top = F.lit(0).cast("long"), F.lit(smallest).cast("long")
    root = whole.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")
    ).withColumns({"conv_id": top, "depth": depth, "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(n_convs).cast("long")}).filter("n_convs > 0")
    # Every rebuilt conversation ends once: at its last turn, or at the root.
    ends = paths.filter("depth = length").select(F.col("node").alias("conv_id"), "depth", F.col("conv").alias("member"))
    turnless = convs.filter("length = 0").select(top.alias("conv_id"), depth.alias("depth"), F.col("conv_id").alias("member"))
    digests = listed_digest(written(ends.unionByName(turnless), "ends"))
    table = whole.unionByName(root.select(*whole.columns))
    joined = table.join(digests, ["conv_id", "depth"], "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
