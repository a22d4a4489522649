import zlib
from hashlib import sha256

import pytest

from tests.llm.conftest import by_id
from tidewatch.llm.merkle import BlockTree, climbed, document_leaves, manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(digests):
    """All levels of a tree, by the plain rule."""
    found = [digests]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def siblings(tree, at):
    found = []
    for level in tree[:-1]:
        other = at ^ 1
        found.append(("l" if other < at else "r", level[other]) if other < len(level) else ("a", ""))
        at >>= 1
    return found


def fold(digest, path):
    for side, other in path:
        digest = h(other, digest) if side == "l" else h(digest, other)
    return digest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_force(rows):
    """doc_id -> (leaf, subroot, root, proof, folded, verified), for distinct doc_ids."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = {}
    for doc_id, text, lang, source, n_chars in rows:
        plain = h(*(field(x) for x in (doc_id, source, lang, n_chars, text)))
        more = n_chars + 1 if n_chars is not None else None
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        leaf.setdefault(lang, []).append((doc_id is not None, doc_id or 0, plain, h(*(field(x) for x in (doc_id, source, lang, more, text))) if tampered else plain))
    trees = {}
    for lang in langs:
        leaf[lang].sort()
        trees[lang] = levels([x[2] for x in leaf[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    out = {}
    for i, lang in enumerate(langs):
        for at, (known, doc_id, plain, other) in enumerate(leaf[lang]):
            path = siblings(trees[lang], at) + siblings(top, i)
            folded = fold(other, path)
            out.setdefault(doc_id if known else None, []).append(
                (plain, trees[lang][-1][0], top[-1][0], h(*(x[1] for x in path)), folded, folded == top[-1][0])
            )
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check(make, rows, height):
    got = by_id(manifest(document_leaves(make(rows, SCHEMA)), "lang", "doc_id", "changed", height=height), *COLUMNS)
    expected = brute_force(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize(("n", "height"), [(1, 2), (2, 1), (9, 1), (33, 2), (33, 10)])
def test_sizes_and_heights(make, n, height):
    langs = [None, "en", "de", "é", "", "en", "en"]
    rows = [(i, f"tide {i}", langs[i % 7], None if i % 5 == 0 else "pier", None if i % 4 == 0 else i) for i in range(n)]
    check(make, rows, height)


def test_hot_group_of_many_blocks(make):
    rows = [(i * 3, "x" * (i % 40), "en" if i % 3 else "fr", "s", i) for i in range(700)]
    check(make, rows, 3)


def test_many_groups(make):
    check(make, [(i, "text", f"lang {i % 70}", "s", i) for i in range(150)], 2)


def test_nulls_repeats_and_long_texts(make):
    rows = [(None, None, None, None, None), (0, None, "en", "", 0), (1, "", "en", None, 5), (9, "long " * 60_000, "en", "s", 300_000), (-7, "é\n漢", "en", "s", -1)]
    check(make, rows, 2)
    # Rows of one doc_id are leaves of their own, ordered by digest; equal rows are interchangeable.
    again = [(4, "same", "en", "s", 4)] * 40 + [(4, "other", "en", "s", 4)] * 3
    found = manifest(document_leaves(make(again, SCHEMA)), "lang", "doc_id", "changed", height=2)
    got, expected = sorted(tuple(r) for r in found.select(*COLUMNS[1:]).collect()), sorted(brute_force(again)[4])
    assert got == expected


def test_empty_table(make):
    assert manifest(document_leaves(make([], SCHEMA)), "lang", "doc_id", "changed").collect() == []


def test_proofs_and_versions(make):
    rows = [(i, f"t{i}", "en" if i % 2 else "de", "s", i) for i in range(50)]
    found = manifest(document_leaves(make(rows, SCHEMA)), "lang", "doc_id", "changed", with_proofs=True, height=2).collect()
    assert any(r["copied"] for r in found)
    for row in found:
        assert sha256("".join(x["digest"] for x in row["proof"]).encode()).hexdigest() == row["proof_sha256"]
        assert row["verified"] == (not row["copied"])
        assert not row["copied"] or row["copied"][-1] == row["folded_root"] != row["root"]


def test_versions_share_untouched_nodes():
    tree = BlockTree([h(str(i)) for i in range(11)], 4)
    plain = levels([h(str(i)) for i in range(11)])
    assert tree.digest[tree.top] == plain[-1][0]
    before, children = list(tree.digest), list(tree.children)
    for at in range(11):
        held = len(tree.digest)
        version = tree.changed(at, h("other"))
        assert len(tree.digest) - held == 5  # the leaf and its four ancestors
        changed = [h(str(i)) for i in range(11)]
        changed[at] = h("other")
        assert tree.digest[version] == levels(changed)[-1][0]
        assert climbed(h("other"), tree.path(at))[-1] == tree.digest[version]
    assert tree.digest[: len(before)] == before and tree.children[: len(children)] == children
