"""Merkle manifest of a table: leaf digests, one tree per group, proofs, and versions by path copying."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.numbering import numbered
from tidewatch.session import written

#: Levels of a tree inside one aligned block, and the nodes a block begins with.
HEIGHT = 10
BLOCK = 1 << HEIGHT
#: In a path: the sibling stands left, right, or the node is hashed alone.
LEFT, RIGHT, ALONE = b"l", b"r", b"a"


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the values one after the other: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined_digest(hexes) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


class BlockTree:
    """The tree over the nodes of one aligned block, kept with all its versions.

    Nodes are only ever added. A version is the number of its top node; it shares every
    node that it did not have to copy. ``height`` levels are built, single nodes being hashed alone.
    """

    def __init__(self, digests: list[str], height: int):
        self.digest = list(digests)
        self.children: list[tuple[int, int]] = [(-1, -1)] * len(digests)
        self.size, self.height = len(digests), height
        level = list(range(len(digests)))
        for _ in range(height):
            level = [self._add(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
        self.top = level[0]

    def _add(self, left: int, right: int) -> int:
        self.children.append((left, right))
        self.digest.append(joined_digest([self.digest[left]] + ([self.digest[right]] if right >= 0 else [])))
        return len(self.digest) - 1

    def _down(self, at: int, top: int) -> list[tuple[int, int, bool]]:
        """(node, sibling or -1, whether the node is the right child) from the leaf's level upward."""
        found, node = [], top
        for level in range(self.height - 1, -1, -1):
            left, right = self.children[node]
            goes_right = bool(at >> level & 1)
            node, sibling = (right, left) if goes_right else (left, right)
            found.append((node, sibling, goes_right))
        return found[::-1]

    def path(self, at: int) -> list[tuple[bytes, str]]:
        """Side and digest of each sibling of leaf ``at`` and its ancestors, up to the top."""
        return [
            (ALONE, "") if sibling < 0 else (LEFT if goes_right else RIGHT, self.digest[sibling]) for _, sibling, goes_right in self._down(at, self.top)
        ]

    def changed(self, at: int, digest: str) -> int:
        """The version in which leaf ``at`` has ``digest``: its ancestors are copied, all else is shared."""
        self.digest.append(digest)
        self.children.append((-1, -1))
        node = len(self.digest) - 1
        for _, sibling, goes_right in self._down(at, self.top):
            node = self._add(sibling, node) if goes_right else self._add(node, sibling)
        return node


def _pack_path(path: list[tuple[bytes, str]]) -> bytes:
    return b"".join(side + bytes.fromhex(sibling) for side, sibling in path)


def _unpack_path(raw: bytes) -> list[tuple[bytes, str]]:
    path, at = [], 0
    while at < len(raw):
        side = raw[at : at + 1]
        width = 0 if side == ALONE else 32
        path.append((side, raw[at + 1 : at + 1 + width].hex()))
        at += 1 + width
    return path


def climbed(digest: str, path: list[tuple[bytes, str]]) -> list[str]:
    """The digests of the ancestors that a digest has with these siblings, upward."""
    found = []
    for side, sibling in path:
        digest = joined_digest([sibling, digest] if side == LEFT else [digest, sibling])
        found.append(digest)
    return found


def _height(total: int, most: int = HEIGHT) -> int:
    """Levels in a block of a tree level with ``total`` nodes: all, or up to the one node that remains."""
    return most if total > 1 << most else (total - 1).bit_length()


def _blocks(nodes: DataFrame, columns: list[str], height: int) -> DataFrame:
    """(tree, block, total, held, top): the nodes (tree, position, total, digest, further columns) of each aligned block, and the digest on top.

    A block has at most 2^height nodes, so a row is bounded. The result is a written table.
    """
    held = F.struct("position", "digest", *columns)
    gathered = nodes.groupBy("tree", F.shiftright("position", height).alias("block")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(held)).alias("held")
    )
    kinds = {f.name: f.dataType.simpleString() for f in gathered.schema}

    def topped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for total, some in zip(batch["total"].to_pylist(), batch["held"]):
                digests = [x.hex() for x in some.values.field("digest").to_pylist()]
                tops.append(bytes.fromhex(_top(digests, _height(total, height))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], [*batch.schema.names, "top"])

    fields = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return written(gathered.mapInArrow(topped, f"{fields}, top binary"), "blocks")


def _top(digests: list[str], height: int) -> str:
    for _ in range(height):
        digests = [joined_digest(digests[i : i + 2]) for i in range(0, len(digests), 2)]
    return digests[0]


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("total")).first()[0] or 0


def _upper(nodes: DataFrame, most: int, height: int) -> DataFrame:
    """(tree, position, path, root): for each node (tree, position, total, digest) its path to the root of its tree.

    Aligned blocks are reduced to their tops, which are the nodes of the next round, until one
    node of each tree remains; then paths are handed down again, each block adding its own part.
    """
    blocks = _blocks(nodes, [], height)
    if most > 1 << height:
        tops = blocks.select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / (1 << height)).alias("total"), F.col("top").alias("digest"))
        above = _upper(tops, -(-most // (1 << height)), height)
        blocks = _with_paths(blocks, above)
    else:
        blocks = blocks.withColumns({"path": F.lit(b""), "root": F.col("top")})
    kind = blocks.schema["tree"].dataType.simpleString()

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, row in zip(batch["held"], batch.drop_columns(["held"]).to_pylist()):
                tree = BlockTree([x.hex() for x in held.values.field("digest").to_pylist()], _height(row["total"], height))
                paths = pa.array([_pack_path(tree.path(i)) + row["path"] for i in range(tree.size)], pa.binary())
                same = [pa.array([row[name]] * tree.size, batch.schema.field(name).type) for name in ("tree", "root")]
                yield pa.RecordBatch.from_arrays([same[0], held.values.field("position"), paths, same[1]], ["tree", "position", "path", "root"])

    needed = blocks.select("tree", "total", "held", "path", "root")
    return written(needed.mapInArrow(down, f"tree {kind}, position long, path binary, root binary"), "paths")


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path and root of their top."""
    place = above.select(F.struct("tree", F.col("position").alias("block")).alias("_place"), "path", "root")
    return blocks.withColumn("_place", F.struct("tree", "block")).join(place, "_place").drop("_place")


def manifest(
    leaves: DataFrame, group: str, order: str, changed: str | None = None, with_proofs: bool = False, height: int = HEIGHT
) -> DataFrame:
    """(order column, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of ``leaves``.

    ``leaves`` has ``leaf``, a lowercase hex digest per row. Per value of ``group`` they
    are ordered by ``order`` (null first, ties by digest); while several nodes remain,
    every two consecutive ones become the digest of their digests, and the last one alone becomes
    its own. What remains are the subroots, which by the order of ``group`` (null
    first) give the root likewise. ``proof_sha256`` is the digest of a leaf's siblings from
    level to level. ``changed`` names a column with another digest for tampered leaves, null for the others.

    Leaves are cut into aligned blocks of 2^height. Inside a block every tampered leaf makes a
    version of the block's tree, which copies the leaf's ancestors and shares all other nodes;
    the version's top then goes on up the path of its block, which distributed rounds over the
    tops of the blocks have built. ``folded_root`` is the root of that version, or of the leaf itself.
    With ``with_proofs`` come the siblings (side, digest) and, for versions, the digests of the copied ancestors.

    Repeated rows are leaves of their own. An empty table has no rows. No task holds more
    than a block or its path; a group of any size is spread over blocks.
    """
    given = leaves.schema[order].dataType.simpleString()
    hexed = [F.unhex("leaf").alias("digest"), (F.unhex(changed) if changed else F.lit(None).cast("binary")).alias("changed")]
    narrow = written(leaves.select(F.col(group).alias("tree"), F.col(order).alias("id"), *hexed), "leaves")
    placed = numbered(narrow, ["tree"], [F.col("id").asc_nulls_first(), F.col("digest").asc()], "position", "total")
    blocks = _blocks(placed, ["id", "changed"], height)
    # The tops of the blocks of each tree, then the tops of the trees.
    tops = blocks.select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / (1 << height)).alias("total"), F.col("top").alias("digest"))
    inner = _upper(tops, _most(tops), height)
    subroots = written(inner.filter("position = 0").select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    ranked = numbered(subroots, ["all"], [F.col("name").asc_nulls_first()], "position", "total")
    ranked = written(ranked.select(F.col("all").alias("tree"), "name", "position", "total", "digest"), "ranked")
    outer = _upper(ranked.drop("name"), _most(ranked), height)
    last = ranked.join(outer.select("position", F.col("path").alias("last"), F.col("root").alias("whole")), "position")
    last = last.select(F.struct(F.col("name").alias("tree")).alias("_tree"), "last", "whole")
    ready = _with_paths(blocks, inner).withColumn("_tree", F.struct("tree")).join(last, "_tree")
    ready = ready.select("total", "held", F.col("root").alias("subroot"), F.concat("path", "last").alias("path"), F.col("whole").alias("root"))
    fields = f"id {given}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    fields += ", proof array<struct<side:string,digest:string>>, copied array<string>" * with_proofs

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, row in zip(batch["held"], batch.drop_columns(["held"]).to_pylist()):
                values = held.values
                digests = [x.hex() for x in values.field("digest").to_pylist()]
                tree = BlockTree(digests, _height(row["total"], height))
                above, subroot, root = _unpack_path(row["path"]), row["subroot"].hex(), row["root"].hex()
                end = "".join(sibling for _, sibling in above)
                untouched = climbed(tree.digest[tree.top], above)
                proofs, folded, paths, copied = [], [], [], []
                for at, other in enumerate(values.field("changed").to_pylist()):
                    path = tree.path(at)
                    proofs.append(joined_digest([*(sibling for _, sibling in path), end]))
                    version = tree.top if other is None else tree.changed(at, other.hex())
                    ancestors = untouched if other is None else climbed(tree.digest[version], above)
                    folded.append(ancestors[-1] if ancestors else tree.digest[version])
                    if with_proofs:
                        paths.append([{"side": side.decode(), "digest": sibling} for side, sibling in path + above if side != ALONE])
                        copied.append([] if other is None else tree.digest[version - tree.height + 1 : version + 1] + ancestors)
                n = len(digests)
                columns = [values.field("id"), pa.array(digests), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded)]
                columns.append(pa.array([x == root for x in folded], pa.bool_()))
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if with_proofs:
                    pairs = pa.list_(pa.struct([("side", pa.string()), ("digest", pa.string())]))
                    columns += [pa.array(paths, pairs), pa.array(copied, pa.list_(pa.string()))]
                    names += ["proof", "copied"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return ready.mapInArrow(verify, fields).withColumnRenamed("id", order)


def document_leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed) of ``documents``: the digest of doc_id, source, lang, n_chars and text, and that of the tampered row.

    A row is tampered where 7 divides the crc32 of its decimal doc_id: its n_chars is one more; a null stays.
    A null doc_id is never tampered.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(fields)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return documents.select("doc_id", "lang", leaf_digest(fields).alias("leaf"), F.when(hit, leaf_digest(more)).alias("changed"))
