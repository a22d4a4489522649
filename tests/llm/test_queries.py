"""Registered queries against DuckDB, and that each reads whole tables."""

import os

import pytest

from tests.compare import compare, connect
from tidewatch.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not present")


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_bpe", "op2_simhash", "op5_quality_rules", "op6_licenses", "op8_quality_model", "op9_toxicity", "op10_decontamination"])
def test_one_row_per_document(spark, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES[name](spark, FOLDER).select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in documents.select("doc_id").collect())


def test_native_plans(spark):
    for name in ("op7_chats", "op10_decontamination"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
