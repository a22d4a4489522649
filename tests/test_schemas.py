import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import contracts, drift

V1 = {"customer_id": ("integer", False), "name": ("string", False)}
V2 = {**V1, "phone": ("string", True)}
V3 = {**V2, "customer_id": ("string", False)}
V4 = {k: v for k, v in V3.items() if k != "phone"}
ORDERS = ({"order_id": ("integer", False), "total_amount": ("float", False)},)
ORDERS += ({**ORDERS[0], "total_amount": ("float", True)},)


@pytest.fixture
def observations(spark):
    rows = []
    history = {"customers": [V1, V1, V2, V3, V3, V4], "orders": list(ORDERS)}
    for dataset, schemas in history.items():
        for day, schema in enumerate(schemas, 1):
            rows += [(dataset, f"2024-01-{day:02d} 00:00:00", c, t, n) for c, (t, n) in schema.items()]
    return spark.createDataFrame(
        rows, "dataset_name string, t string, column_name string, data_type string, nullable boolean"
    ).select("dataset_name", F.col("t").cast("timestamp_ntz").alias("observed_at"), "column_name", "data_type", "nullable")


def test_versions_change_only_with_the_schema(observations):
    rows = drift.register_schemas(observations).collect()
    got = sorted((r.dataset_name, r.version_number, r.detected_at.day) for r in rows)
    assert got == [("customers", 1, 1), ("customers", 2, 3), ("customers", 3, 4), ("customers", 4, 6), ("orders", 1, 1), ("orders", 2, 2)]


def test_hash_is_that_of_the_sorted_document(observations):
    versions = drift.register_schemas(observations)
    (first,) = versions.filter("dataset_name = 'customers' AND version_number = 1").collect()
    columns = [
        {"name": n, "data_type": t, "nullable": null, "position": i}
        for i, (n, (t, null)) in enumerate(sorted(V1.items()))
    ]
    want = hashlib.sha256(json.dumps({"columns": columns}, sort_keys=True).encode()).hexdigest()
    assert first.version_hash == want


def test_drift_kinds(observations):
    columns = drift.version_columns(drift.register_schemas(observations))
    history = {(r.dataset_name, r.current_version): r for r in drift.drift_history(columns).collect()}
    assert {k: (r.drift_type, r.severity) for k, r in history.items()} == {
        ("customers", 2): ("column_added", "info"),
        ("customers", 3): ("type_changed", "critical"),
        ("customers", 4): ("column_removed", "critical"),
        ("orders", 2): ("nullability_changed", "warning"),
    }
    assert history["customers", 2].position_changes == 0
    compared = {r.dataset_name: r for r in drift.compare_versions(columns, 1, 3).collect()}
    assert set(compared) == {"customers"}
    assert (compared["customers"].drift_type, compared["customers"].added_changes) == ("type_changed", 1)


def test_same_versions_have_no_drift(observations):
    columns = drift.version_columns(drift.register_schemas(observations))
    (row,) = drift.compare_versions(columns.filter("dataset_name = 'orders'"), 1, 2).collect()
    assert row.has_drift
    twin = columns.filter("version_number = 1").unionAll(
        columns.filter("version_number = 1").withColumn("version_number", F.lit(2).cast("bigint"))
    )
    assert not any(r.has_drift for r in drift.compare_versions(twin, 1, 2).collect())


def test_adding_a_column_shifts_later_positions(spark):
    schema = "k string, column_name string, data_type string, nullable boolean, position int"
    old = spark.createDataFrame([("t", "b", "int", True, 0)], schema)
    new = spark.createDataFrame([("t", "a", "int", True, 0), ("t", "b", "int", True, 1)], schema)
    changes = {(r.column_name, r.change) for r in drift.compare_columns(old, new, ["k"]).collect()}
    assert changes == {("a", "added"), ("b", "position")}


def test_latest_acknowledgement_wins(spark):
    history = spark.createDataFrame([("t", 2, False), ("t", 3, False)], "dataset_name string, current_version int, acknowledged boolean")
    acks = spark.createDataFrame(
        [("t", 2, "ann", "2024-01-01", None), ("t", 2, "bob", "2024-01-02", "ok")],
        "dataset_name string, current_version int, acknowledged_by string, acknowledged_at string, notes string",
    )
    rows = drift.acknowledge(history, acks, ["dataset_name", "current_version"]).collect()
    assert sorted((r.current_version, r.acknowledged, r.acknowledged_by) for r in rows) == [(2, True, "bob"), (3, False, None)]


def test_contract(spark):
    contract = spark.createDataFrame(
        [("t", "id", "integer", True), ("t", "at", "timestamp", True), ("t", "x", "float", False), ("u", "id", "integer", True)],
        "dataset_name string, column_name string, data_type string, required boolean",
    )
    observed = spark.createDataFrame(
        [("t", "id", "INT64 "), ("t", "x", "object"), ("t", "y", "string"), ("u", "id", "long"), ("w", "z", "int")],
        "dataset_name string, column_name string, data_type string",
    )
    errors = {(r.dataset_name, r.column_name): r.error_type for r in contracts.contract_errors(contract, observed).collect() if r.dataset_name != "w"}
    assert errors == {("t", "at"): "missing_column", ("t", "x"): "type_mismatch", ("t", "y"): "unexpected_column"}
    verdicts = {r.dataset_name: (r.is_valid, r.error_count) for r in contracts.contract_validate(contract, observed).collect()}
    assert verdicts == {"t": (False, 3), "u": (True, 0)}
    schema = contracts.contract_schema([{"name": "id", "data_type": "integer", "nullable": False}])
    assert schema.simpleString() == "struct<id:bigint>"


def test_registration_against_stored_versions(observations):
    """Only changes after the stored versions are new; the same schema again adds nothing."""
    def shape(versions):
        return sorted((r.dataset_name, r.version_number, r.version_hash, r.detected_at) for r in versions.collect())

    everything = drift.register_schemas(observations)
    for day in (1, 2, 3, 5):
        cut = F.lit(f"2024-01-0{day} 12:00:00").cast("timestamp_ntz")
        stored = drift.register_schemas(observations.filter(F.col("observed_at") < cut))
        new = drift.register_new_schemas(stored, observations.filter(F.col("observed_at") > cut))
        assert shape(stored.unionByName(new)) == shape(everything)
    last = observations.filter("dataset_name = 'customers' AND observed_at = TIMESTAMP_NTZ '2024-01-06 00:00:00'")
    assert drift.register_new_schemas(everything, last).count() == 0
    assert shape(drift.register_new_schemas(everything.limit(0), observations)) == shape(everything)


def test_contract_reads_each_side_once(spark):
    contract = spark.range(0).selectExpr("'d' AS dataset_name", "'c' AS column_name", "'string' AS data_type", "true AS required")
    observed = spark.range(0).selectExpr("'d' AS dataset_name", "'c' AS column_name", "'string' AS data_type")
    for check in (contracts.contract_validate, contracts.contract_errors):
        plan = check(contract, observed)._jdf.queryExecution().analyzed().toString()
        assert plan.count("Range (") == 2 and plan.count("Join ") == 1
