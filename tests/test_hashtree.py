"""Hash trees against full comparisons."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import hashtree

SCHEMA = "berth int, ship string, tons int, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fleet(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), rng.choice([None, "Aurora", "Borealis", ""]), rng.randrange(5), rng.choice(["", None, "n"])) for _ in range(n)]


def difference(left, right):
    """Keys with different multisets of rows: key -> (kind, rows left, rows right)."""
    by_key = ({}, {})
    for side, rows in zip(by_key, (left, right)):
        for r in rows:
            side.setdefault(r[:2], Counter())[r] += 1
    out = {}
    for key in by_key[0].keys() | by_key[1].keys():
        a, b = by_key[0].get(key), by_key[1].get(key)
        if a != b:
            out[key] = ("missing" if b is None else "extra" if a is None else "changed", sum((a or {}).values()), sum((b or {}).values()))
    return out


def found(spark, left, right, **more):
    rows = hashtree.differing_keys(frame(spark, left), frame(spark, right), ["berth", "ship"], levels=2, **more).collect()
    assert len({tuple(r)[:2] for r in rows}) == len(rows)
    return {tuple(r)[:2]: tuple(r)[2:] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_differing_keys(spark, seed):
    left = fleet(400, seed)
    right = [(r[0], r[1], r[2] + (i % 97 == 5), r[3]) for i, r in enumerate(left) if i % 83 != 7] + fleet(3, seed + 10)
    assert found(spark, left, right) == difference(left, right)


def test_copies_and_hot_keys(spark):
    left = [(1, "Aurora", 3, "")] * 500 + [(2, "b", 1, None)]
    assert found(spark, left, left[1:]) == {(1, "Aurora"): ("changed", 500, 499)}
    assert found(spark, left, left[::-1]) == {}


def test_equal_empty_and_one_sided(spark):
    rows = fleet(20)
    assert found(spark, rows, rows) == {} == found(spark, [], [])
    assert found(spark, rows, []) == difference(rows, [])
    assert found(spark, [], rows) == difference([], rows)


def test_texts_that_only_join_alike_differ(spark):
    assert found(spark, [(1, "a", 1, "x")], [(1, "a", 1, "x"), (1, None, 1, "-")]) == {(1, None): ("extra", 0, 1)}
    a, b = frame(spark, [(1, "1:2", None, "-")]), frame(spark, [(1, "1:2", None, None)])
    assert hashtree.differing_keys(a, b, ["berth"], levels=1).count() == 1


def test_walk_goes_down_differing_ranges_only(spark):
    left = [(i, "s", i, "") for i in range(3000)]
    right = [(i, "s", i + (i == 1234), "") for i in range(3000)]
    trees = [hashtree.table_tree(frame(spark, rows), ["berth"], levels=3) for rows in (left, right)]
    seen = hashtree.walk(*trees).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("d")).orderBy("level").collect()
    assert [r["d"] for r in seen] == [1, 1, 1, 1]
    assert seen[0]["n"] == 1 and all(r["n"] <= 16 for r in seen)
    same = hashtree.walk(trees[0], trees[0]).collect()
    assert [(r["level"], r["differs"]) for r in same] == [(0, False)]


def test_stored_trees_and_appended_batches(spark, tmp_path):
    left, batch = fleet(200, 4), fleet(30, 5)
    stored = str(tmp_path / "leaves")
    hashtree.leaves(frame(spark, left), ["berth", "ship"], levels=2).write.parquet(stored)
    whole = hashtree.merged_leaves(spark.read.parquet(stored), hashtree.leaves(frame(spark, batch), ["berth", "ship"], levels=2))
    direct = hashtree.table_tree(frame(spark, left + batch), ["berth", "ship"], levels=2)
    assert sorted(map(tuple, hashtree.hash_tree(whole).collect())) == sorted(map(tuple, direct.collect()))
    trees = {"left_tree": hashtree.hash_tree(whole), "right_tree": hashtree.table_tree(frame(spark, left), ["berth", "ship"], levels=2)}
    assert found(spark, left + batch, left, **trees) == difference(left + batch, left)


def test_root_does_not_depend_on_order(spark):
    rows = fleet(100, 7)
    digests = {tuple(hashtree.root_digest(hashtree.table_tree(frame(spark, r).repartition(n), ["berth"])).first()) for r, n in ((rows, 1), (rows[::-1], 3))}
    assert len(digests) == 1
    assert hashtree.root_digest(hashtree.table_tree(frame(spark, []), ["berth"])).collect() == []


def test_rows_are_shuffled_once(spark):
    """Beside the comparison of trees, whose tables are small, both tables share one shuffle."""
    left = fleet(400, 3)
    rows = hashtree.differing_keys(frame(spark, left), frame(spark, left[:-9] + fleet(9, 8)), ["berth", "ship"], levels=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_k") == 1 and "FullOuter" not in plan.split("Union")[0]
    assert all(r.kind in ("missing", "extra", "changed") for r in rows.collect())
