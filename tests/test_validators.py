import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import checksums, runs, validators


def row(df):
    (found,) = df.collect()
    return found


def test_null_counts(people):
    counts = {r.column_name: r.null_count for r in validators.null_counts(people).collect()}
    assert counts == {"id": 0, "name": 1, "email": 2, "phone": 3}
    total = row(validators.null_totals(people))
    assert (total.total_null_values, total.total_cells, total.overall_null_percentage) == (6, 20, 30.0)


def test_null_check_passes_and_keeps_details(people):
    found = row(validators.null_check(people))
    assert (found.status, found.passed, found.failed_records) == ("passed", True, 6)
    assert found.message == "Null validation passed: 30.0% null values overall"
    details = json.loads(found.details)
    assert details["null_counts"] == {"id": 0, "name": 1, "email": 2, "phone": 3}
    assert details["columns_checked"] == 4


def test_null_check_errors_in_order(people):
    found = row(
        validators.null_check(
            people, non_null_columns=["email", "id"], max_null_percentage=50.0,
            column_thresholds={"name": 10, "phone": 80}, columns=["name", "email", "phone", "absent"],
        )
    )
    assert found.status == "failed"
    assert found.errors == [
        "Column 'absent' not found in DataFrame",
        "Column 'email' must not contain nulls, found 2 (40.0%)",
        "Column 'name' exceeds null threshold: 20.0% > 10.0%",
        "Column 'phone' exceeds global null threshold: 60.0% > 50.0%",
    ]


def test_null_threshold_is_exclusive(people):
    assert row(validators.null_check(people, column_thresholds={"name": 20.0})).passed


def test_empty_column_fails(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, empty_field string")
    found = row(validators.null_check(df))
    assert found.errors == ["Found 1 completely empty column(s): empty_field"]
    assert json.loads(found.details)["empty_columns"] == ["empty_field"]


def test_high_share(spark):
    df = spark.createDataFrame([(i, None if i else "x") for i in range(10)], "id int, optional_field string")
    assert {r.column_name: r.null_percentage for r in validators.null_counts(df).collect()}["optional_field"] == 90.0


def test_empty_frame_is_a_warning(people):
    for check in (validators.null_check, checksums.checksum_check):
        found = row(check(people.limit(0)))
        assert (found.status, found.passed, found.total_records, found.errors) == ("warning", False, 0, [])


def test_nulls_of_all_columns(moorings):
    found = row(validators.null_totals(moorings))
    assert found.total_null_values == 6 and found.overall_null_percentage == pytest.approx(100 * 6 / 45, abs=0.01)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "`a.b` int, `it's ``odd``` string")
    counts = {r.column_name: r.null_count for r in validators.null_counts(df).collect()}
    assert counts == {"a.b": 1, "it's `odd`": 1}
    assert row(checksums.dataset_checksum(df)).total_records == 2


def test_datatype_mismatches_are_counted_not_thrown(spark):
    df = spark.createDataFrame(
        [("1", "x", "2020-01-01", "yes"), ("a", "2.5", "never", "true"), (None, None, None, None)],
        "i string, f string, d string, b string",
    )
    found = row(
        validators.datatype_check(df, {"i": "integer", "f": "float", "d": "date", "b": "boolean", "z": "string"})
    )
    assert (found.failed_records, found.status) == (4, "failed")
    assert found.errors == ["Column 'z' not found in DataFrame"]


def test_type_families_are_exact(spark):
    df = spark.sql("SELECT 1 AS a, 1L AS b, CAST(1 AS DECIMAL(9,2)) AS c, array('x') AS d, INTERVAL '1' DAY AS e")
    assert validators.type_matches(df, "a", "integer") and validators.type_matches(df, "b", "integer")
    assert validators.type_matches(df, "c", "float")
    assert not validators.type_matches(df, "d", "string")
    assert not validators.type_matches(df, "e", "integer")


@pytest.mark.parametrize("bad, status", [(0, "passed"), (5, "warning"), (6, "failed")])
def test_datatype_bands(spark, bad, status):
    df = spark.range(100).select(F.when(F.col("id") < bad, "x").otherwise("1").alias("v"))
    assert row(validators.datatype_check(df, {"v": "integer"})).status == status


def test_pattern_finds_anywhere(spark):
    df = spark.createDataFrame([("xabcx",), ("zzz",), (None,)], "v string")
    found = row(validators.datatype_columns(df, string_patterns={"v": "abc"}))
    assert found.pattern_mismatch_count == 1


def test_range_on_numbers_and_texts(moorings):
    df = moorings.withColumn("text", F.col("age").cast("string"))
    rows = validators.datatype_columns(df, numeric_ranges={"age": (0, 120), "text": (0, 120)}).collect()
    assert [r.out_of_range_count for r in rows] == [3, 3]
    assert (rows[0].actual_min, rows[0].actual_max) == (-1.0, 400.0)


def test_row_checksum_text(spark):
    df = spark.createDataFrame([(1, "Alice", 100), (2, None, 200)], "id int, name string, value int")
    hashes = [r.h for r in df.select(checksums.row_checksum(df.columns).alias("h")).collect()]
    assert hashes == [hashlib.md5(x.encode()).hexdigest() for x in ("1|Alice|100", "2|NULL|200")]


@pytest.mark.parametrize("algorithm", ["md5", "sha256"])
def test_piece_sums_use_all_digits(spark, algorithm):
    digits = checksums.DIGITS[algorithm]
    base = "0123456789abcdef" * (digits // 16)
    hashes = [base] + [base[:i] + ("f" if base[i] != "f" else "0") + base[i + 1 :] for i in range(digits)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id int, h string")
    sums = df.groupBy("id").agg(*checksums._piece_sums(F.col("h"), "w", algorithm)).drop("id").collect()
    assert len(set(sums)) == digits + 1
    whole = df.filter("id = 0").agg(*checksums._piece_sums(F.col("h"), "w", algorithm)).first()
    assert list(whole) == [int(base[i : i + 4], 16) for i in range(0, digits, 4)]


@pytest.mark.parametrize("algorithm", ["md5", "sha256"])
def test_dataset_checksum_ignores_order_and_sees_changes(spark, repeated, algorithm):
    def digest(df):
        return row(checksums.dataset_checksum(df, algorithm=algorithm)).dataset_checksum

    base = digest(repeated)
    assert digest(repeated.orderBy(F.col("value").desc()).repartition(7)) == base
    assert digest(repeated.unionAll(repeated.limit(1))) != base
    assert digest(repeated.withColumn("value", F.col("value") + 1)) != base
    assert digest(repeated.filter("id <> 6")) != base


def test_checksum_check(repeated):
    found = row(checksums.checksum_check(repeated, detect_duplicates=True))
    assert (found.status, found.failed_records) == ("failed", 2)
    assert found.errors == ["Found 2 duplicate row(s) based on checksum"]
    plain = row(checksums.checksum_check(repeated))
    assert plain.passed
    digest = json.loads(plain.details)["dataset_checksum"]
    # Both ways to compute the digest agree.
    assert json.loads(found.details)["dataset_checksum"] == digest
    assert row(checksums.dataset_checksum(repeated)).dataset_checksum == digest
    assert row(checksums.checksum_check(repeated, expected_checksum=digest)).passed
    missing = row(checksums.checksum_check(repeated, columns=["nope"]))
    assert missing.status == "error"


def existence(spark, df, required, optional=(), **options):
    rows = [("t", c, True) for c in required] + [("t", c, False) for c in optional]
    expected = spark.createDataFrame(rows, "dataset_name string, column_name string, required boolean")
    observed = validators.schema_table(df, "t")
    return row(validators.column_existence(expected, observed, validators.row_count(df, "t"), **options))


def test_column_existence(spark, people):
    found = existence(spark, people, ["id", "name"], ["email", "fax"])
    assert (found.status, found.total_records) == ("passed", 5)
    assert found.message == (
        "All 2 required columns present, 1 optional column(s) present, 1 extra column(s) allowed"
    )
    assert existence(spark, people, ["id", "fax"]).errors == ["Missing 1 required column(s): fax"]
    assert existence(spark, people, ["id"], allow_extra_columns=False).status == "warning"
    assert existence(spark, people, ["ID", "NAME"]).status == "failed"
    assert existence(spark, people, ["ID", "NAME"], case_sensitive=False).status == "passed"


def test_schema_check(spark, people):
    expected = spark.createDataFrame(
        [("t", "id", True, "bigint"), ("t", "fax", True, None), ("t", "name", False, "string")],
        "dataset_name string, column_name string, required boolean, data_type string",
    )
    found = row(
        validators.schema_check(expected, validators.schema_table(people, "t"), validators.row_count(people, "t"))
    )
    assert found.errors == ["Missing required columns: fax", "Type mismatches found in 1 column(s)"]
    assert found.total_records == 0


def test_defaults_run_in_one_aggregation(spark, people):
    contract = [
        {"name": "id", "data_type": "integer"},
        {"name": "name", "data_type": "string"},
        {"name": "email", "data_type": "string", "required": False},
    ]
    df = runs.validate_with_defaults(people, "people", contract, checksum_columns=["id"])
    status = {r.validator_name: r.status for r in df.collect()}
    assert status == {
        "ColumnExistenceValidator": "passed", "SchemaValidator": "passed", "NullValidator": "failed",
        "DatatypeValidator": "passed", "ChecksumValidator": "passed",
    }
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_defaults_survive_a_broken_check(people):
    df = runs.validate_with_defaults(people, "people", checksum_columns=["nope"])
    found = {r.validator_name: (r.status, r.message) for r in df.collect()}
    assert found["NullValidator"][0] == "failed"
    assert found["ChecksumValidator"] == (
        "error", "Validator execution failed: No valid columns for checksum calculation"
    )
    (summary,) = runs.validation_summary(df).collect()
    assert (summary.overall_status, summary.error_validators, summary.total_records) == ("error", 1, 5)


def test_result_and_log_rows(people):
    from tidewatch.plans.common import at

    results = runs.validate_with_defaults(people, "people")
    logs = runs.validation_log_rows(results, at("2024-01-01 00:00:00")).collect()
    assert [(r.validation_type, r.status) for r in logs] == [("null", "failed"), ("aggregated", "failed")]
    assert logs[1].message == "Executed 1 validators: 0 passed, 1 failed, 0 warnings"
    (audit,) = runs.audit_rows(results, "system", "dev", at("2024-01-01 00:00:00")).collect()
    assert "; " in audit.error_summary and audit.validation_type == "null"
