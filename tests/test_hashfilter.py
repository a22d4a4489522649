"""Filters of stored hashes: nothing stored is missed, little else passes, and results are exact."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import hashfilter as H
from tidewatch.operators import loads
from tidewatch.sources.snapshots import Snapshots


def hashes(numbers):
    return [hashlib.sha256(str(n).encode()).hexdigest() for n in numbers]


@pytest.fixture(scope="module")
def stored(spark):
    """Five batches of 2 000 hashes."""
    return spark.createDataFrame([(f"b{n % 5}", h) for n, h in enumerate(hashes(range(10_000)))], "batch_id string, record_hash string").cache()


def test_no_stored_hash_is_missed(spark, stored):
    filters = H.build_filter(stored, by=("batch_id",), blocks=16)
    merged = H.merge_filters(filters)
    assert merged.count() == 16
    assert H.maybe_stored(stored, merged, blocks=16).count() == 10_000
    own = H.maybe_stored(stored, filters, blocks=16).join(stored, ["record_hash", "batch_id"], "left_semi")
    assert own.count() == 10_000
    new = spark.createDataFrame([(h,) for h in hashes(range(50_000, 60_000))] + [(None,)], "record_hash string")
    # 16 blocks of 32 768 bits for 10 000 hashes: 52 bits a hash, 6 of them set.
    assert H.maybe_stored(new, merged, blocks=16).count() < 20


def test_merging_equals_building_at_once(spark, stored):
    at_once = {r["block"]: bytes(r["bits"]) for r in H.build_filter(stored, blocks=8).collect()}
    merged = {r["block"]: bytes(r["bits"]) for r in H.merge_filters(H.build_filter(stored, by=("batch_id",), blocks=8)).collect()}
    assert merged == at_once


def test_only_batches_with_hits_are_read(spark, stored, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    store.write("hashes", stored, F.col("batch_id"))
    filters = H.build_filter(stored, by=("batch_id",), blocks=256)
    arriving = [(i, h) for i, h in enumerate([*hashes([3, 8, 13, 13, 7]), *hashes(range(20_000, 21_000)), *hashes(range(20_000, 20_010)), None, None])]
    incoming = spark.createDataFrame(arriving, "id int, record_hash string")
    asked = []

    def read(names):
        asked.extend(names)
        return store.read("hashes", partitions=names)

    known = H.known_hashes(incoming, filters, "batch_id", read, blocks=256)
    assert sorted(r[0] for r in known.collect()) == sorted(hashes([3, 8, 13, 7]))
    assert set(asked) == {"b2", "b3"}
    got = sorted(map(tuple, loads.load_outcomes(incoming, known, "id").select("id", "outcome").collect()))
    assert got == sorted(map(tuple, loads.load_outcomes(incoming, stored, "id").select("id", "outcome").collect()))
    assert sum(o == "duplicate" for _, o in got) == 5 + 10


def test_nothing_stored_or_nothing_arriving(spark, stored):
    none = stored.limit(0)
    filters = H.build_filter(none, by=("batch_id",))
    assert H.known_hashes(stored, filters, "batch_id", lambda names: none).collect() == []
    assert H.maybe_stored(none, H.build_filter(stored, blocks=4), blocks=4).collect() == []
