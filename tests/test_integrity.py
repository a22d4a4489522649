from tidewatch.operators import integrity


def test_duplicates(repeated):
    (found,) = integrity.pk_uniqueness(repeated, ["id"]).collect()
    assert (found.duplicate_count, found.unique_duplicate_keys, found.has_duplicates) == (2, 2, True)
    (found,) = integrity.detect_duplicates(repeated, ["id"]).collect()
    assert (found.total_records, found.unique_records, found.duplicate_count) == (5, 3, 2)
    (found,) = integrity.detect_duplicates(repeated, []).collect()
    assert (found.unique_records, found.has_duplicates) == (5, False)


def test_null_keys_form_one_group_but_leave_the_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (3, 4), (5, 5)], "k int, v int")
    (found,) = integrity.pk_uniqueness(df, ["k"]).collect()
    assert (found.duplicate_count, found.unique_duplicate_keys) == (2, 2)
    rows = integrity.dup_pk_rows(df, ["k"]).collect()
    assert sorted((r.k, r.v, r._pk_occurrence_count) for r in rows) == [(3, 3, 2), (3, 4, 2)]


def test_orphans(spark):
    child = spark.createDataFrame([(1, 1, 9), (2, None, 9), (3, 7, 9), (4, 7, 8)], "id int, a int, b int")
    parents = {
        "p": spark.createDataFrame([(1,), (2,), (1,)], "k int"),
        "q": spark.createDataFrame([(9,)], "k int"),
    }
    keys = {"a": ("p", "k"), "b": ("q", "k"), "c": ("p", "k"), "id": ("gone", "k")}
    assert sorted(r.id for r in integrity.fk_orphans(child, "a", parents["p"], "k").collect()) == [2, 3, 4]
    assert [r.a for r in integrity.fk_orphan_values(child, "a", parents["p"], "k").collect()] == [None, 7]
    checks = {r.fk_column: r for r in integrity.fk_check(child, keys, parents).collect()}
    assert (checks["a"].orphan_count, checks["a"].orphan_keys, checks["a"].valid) == (3, 2, False)
    assert (checks["b"].orphan_count, checks["b"].valid) == (1, False)
    assert (checks["c"].orphan_count, checks["c"].valid) == (0, False)
    assert checks["c"].error == "Foreign key column 'c' not found in dataset"
    assert checks["id"].error == "Parent dataset 'gone' not provided"
    (result,) = integrity.integrity_check(child, ["id"], keys, parents).collect()
    assert (result.status, result.failed_records, result.pass_rate) == ("failed", 4, 0.0)
    assert result.errors == [
        "Found 1 orphan record(s) with invalid foreign key 'b'",
        "Found 3 orphan record(s) with invalid foreign key 'a'",
    ]
    rows = integrity.union_failed_rows(child, ["id"], keys, parents).collect()
    assert sorted((r.id, r._invalid_fk_column, r.validation_failure_type) for r in rows) == [
        (2, "a", "orphan_foreign_key"), (3, "a", "orphan_foreign_key"), (4, "a", "orphan_foreign_key"),
        (4, "b", "orphan_foreign_key"),
    ]


def test_nothing_to_check_gives_an_empty_tagged_frame(repeated):
    rows = integrity.union_failed_rows(repeated)
    assert rows.columns[-1] == "validation_failure_type" and rows.count() == 0


def test_clean_table_passes(repeated):
    (result,) = integrity.integrity_check(repeated.dropDuplicates(["id"]), ["id"]).collect()
    assert (result.status, result.pass_rate, result.errors) == ("passed", 100.0, [])


def test_rows_not_matching_leaves_nulls_out(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "ok boolean")
    assert integrity.rows_not_matching(df, "ok").count() == 1


def _scans(df):
    """File scans that really run: those of reused exchanges do not."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("FileScan parquet")


def test_one_scan_for_any_number_of_keys(spark, tmp_path):
    path = str(tmp_path / "child")
    rows = [(i, i % 7, f"k{i % 5}", float(i % 3), None if i % 4 == 0 else i % 6) for i in range(300)]
    spark.createDataFrame(rows, "id bigint, a int, b string, c double, d int").write.parquet(path)
    child = spark.read.parquet(path)
    parents = {
        "ints": spark.createDataFrame([(i,) for i in range(5)], "k bigint"),
        "texts": spark.createDataFrame([("k0",), ("k1",)], "k string"),
        "reals": spark.createDataFrame([(0.0,), (-0.0,), (2.0,)], "k double"),
        "decimals": spark.createDataFrame([("1",), ("2",), ("x",)], "k string"),
    }
    keys = {"a": ("ints", "k"), "b": ("texts", "k"), "c": ("reals", "k"), "d": ("decimals", "k")}
    found = integrity.fk_check(child, keys, parents)
    got = {r.fk_column: (r.orphan_count, r.orphan_keys, r.sample_orphans) for r in found.collect()}
    expected = {}
    for name, at, ok in (("a", 1, set(range(5))), ("b", 2, {"k0", "k1"}), ("c", 3, {0.0, 2.0}), ("d", 4, {1, 2})):
        lost = [r[at] for r in rows if r[at] not in ok]
        order = sorted(set(lost), key=lambda v: (v is not None, v if v is not None else 0))
        expected[name] = (len(lost), len(order), ["NULL" if v is None else str(v) for v in order])
    assert got == expected
    assert _scans(found) == 1
    orphans = integrity.union_orphans(child, keys, parents)
    assert {r[0]: r[1] for r in orphans.groupBy("_invalid_fk_column").count().collect()} == {k: v[0] for k, v in expected.items()}
    assert orphans.columns == [*child.columns, "_invalid_fk_column"] and _scans(integrity.union_orphans(child, keys, parents)) == 1


def test_samples_are_the_smallest_by_value(spark):
    child = spark.createDataFrame([(v,) for v in [*range(500, -500, -1), None]], "a int")
    found = integrity.fk_check(child, {"a": ("p", "k")}, {"p": spark.createDataFrame([(-499,)], "k int")}).first()
    assert found.orphan_count == 1000 and found.sample_orphans == ["NULL", *[str(v) for v in range(-498, -399)]]
