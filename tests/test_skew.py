"""Plans on a key that holds a third of the rows: AQE must split it, or it must be counted first."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import integrity, loads, records
from tidewatch.session import work_path

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_skew_limits(spark):
    old = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """30 000 rows on disk; key 0 holds a third of them."""
    path = work_path(spark, "hot")
    rows = spark.range(0, 30000, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("v")
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot_rows_avoid_the_shuffle(df):
    """Rows with a hot key meet a broadcast; a join by shuffle only sees the others."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "strategy=broadcast" in plan and "isnull(_hot" in plan


def test_duplicate_rows(hot, small_skew_limits):
    more = hot.unionAll(hot.filter("id < 30"))
    rows = integrity.dup_pk_rows(more, ["k"])
    assert len(rows.collect()) == 10000 + 10 + 2 * 20
    assert hot_rows_avoid_the_shuffle(rows)


def test_orphans_split_the_hot_key(spark, hot, small_skew_limits):
    parents = spark.range(1, 20000).withColumnRenamed("id", "p")
    rows = integrity.fk_orphans(hot, "k", parents, "p")
    assert len(rows.collect()) == 10000 + 20000 - len([i for i in range(1, 20000) if i % 3])
    assert "skew=true" in final_plan(rows)


def test_record_duplicates(hot, small_skew_limits):
    payload = hot.select("id", F.to_json(F.struct("k", "v")).alias("p"))
    rows = records.record_duplicates(payload, "id", "p", ["k"])
    assert len(rows.collect()) == 9999
    assert hot_rows_avoid_the_shuffle(rows)


def test_existing_records(hot, small_skew_limits):
    payload = hot.select("id", F.to_json(F.struct("k")).alias("p"))
    rows = records.existing_duplicates(payload, payload.filter("id < 300"), "p", ["k"], "id")
    found = {(r.record_index, r.k) for r in rows.collect()}
    assert found == {(i, "0") for i in range(0, 30000, 3)} | {(i, str(i)) for i in range(300) if i % 3}
    assert hot_rows_avoid_the_shuffle(rows)


def test_load_outcomes(hot, small_skew_limits):
    incoming = hot.select("id", "v", F.sha2(F.col("k").cast("string"), 256).alias("record_hash"))
    rows = loads.load_outcomes(incoming, incoming.filter("id < 5 AND id > 0"), "id")
    outcomes = [r.outcome for r in rows.collect()]
    # 10 000 copies of one hash, which is stored already, and three more stored records.
    assert outcomes.count("duplicate") == 10000 + 3 and len(outcomes) == 30000
    assert hot_rows_avoid_the_shuffle(rows)


def test_new_records_shrink_before_the_shuffle(hot, small_skew_limits):
    incoming = hot.select("id", "v", F.sha2(F.col("k").cast("string"), 256).alias("record_hash"))
    fresh = loads.load_dedup(incoming, incoming.filter("id = 1"), "id")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("WindowGroupLimit")
    assert fresh.count() == 20000


def test_nothing_collects_rows_of_a_key(hot):
    for df in (integrity.pk_uniqueness(hot, ["k"]), integrity.detect_duplicates(hot, ["k"])):
        # The sample is collected from its first hundred keys; the counts collect nothing.
        sample = df.select("sample_keys")._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit 100" in sample
        plan = df.drop("sample_keys")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect" not in plan and "Window" not in plan


def test_orphans_without_a_value_are_dealt_over_all_tasks(spark, hot, small_skew_limits):
    children = hot.withColumn("k", F.expr("nullif(k, 0)"))
    parents = spark.range(1, 20000).select(F.col("id").alias("p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = integrity.fk_orphans(children, "k", parents, "p").filter("k IS NULL")
        tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 10000 and len(tasks) == 16 and max(tasks) < 1000


def test_orphans_of_several_keys_are_repeated_after_the_joins(spark, hot, small_skew_limits):
    children = hot.select("*", F.expr("IF(id % 5 = 0, NULL, CAST(id % 7 AS STRING))").alias("t"))
    parents = {"p": spark.range(1, 20000).unionAll(spark.range(1, 9)).toDF("p"), "q": spark.createDataFrame([(n,) for n in range(4)], "q int")}
    rows = integrity.union_orphans(children, {"k": ("p", "p"), "t": ("q", "q")}, parents)
    counts = {r[0]: r[1] for r in rows.groupBy("_invalid_fk_column").count().collect()}
    assert counts == {"k": 10000 + len([i for i in range(20000, 30000) if i % 3]), "t": len([i for i in range(30000) if i % 5 == 0 or i % 7 > 3])}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")
    rows.collect()
    assert "skew=true" in final_plan(rows)


def test_keys_are_counted_once_for_hot_and_other_rows(hot, small_skew_limits):
    children = hot.withColumn("k", F.expr("IF(k = 0, 0, k DIV 2)"))
    rows = integrity.dup_pk_rows(children, ["k"])
    counts = Counter(i // 2 if i % 3 else 0 for i in range(30000))
    assert len(rows.collect()) == sum(n for n in counts.values() if n > 1)
    assert "ReusedExchange [k#" in rows._jdf.queryExecution().executedPlan().toString()
