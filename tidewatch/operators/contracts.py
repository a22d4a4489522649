"""Schema contracts against observed columns, for all datasets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import normalize_type

KEYS = ["dataset_name", "column_name"]


def compare_contract(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """(dataset_name, column_name, in_contract, in_data, expected, actual, error_type): every column of either side, once.

    One full outer join; error_type is null for a column that is as agreed.
    """
    want = contract.select(*KEYS, "required", F.col("data_type").alias("expected"), F.lit(True).alias("in_contract"))
    have = observed.select(*KEYS, F.coalesce("data_type", F.lit("unknown")).alias("actual"), F.lit(True).alias("in_data"))
    both = want.join(have, KEYS, "full_outer").fillna(False, ["in_contract", "in_data"])
    differs = normalize_type(F.col("expected")) != normalize_type(F.col("actual"))
    kind = (
        F.when(~F.col("in_data") & F.col("required"), "missing_column")
        .when(~F.col("in_contract"), "unexpected_column")
        .when(F.col("in_data") & differs, "type_mismatch")
    )
    return both.withColumn("error_type", kind).drop("required")


def contract_errors(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per missing, unexpected or mistyped column."""
    name, kind = F.col("column_name"), F.col("error_type")
    missing, unexpected = kind == "missing_column", kind == "unexpected_column"
    message = (
        F.when(missing, F.concat(F.lit("Required column '"), name, F.lit("' is missing from dataset")))
        .when(unexpected, F.concat(F.lit("Column '"), name, F.lit("' exists in dataset but not in contract")))
        .otherwise(
            F.concat(
                F.lit("Column '"), name, F.lit("' has type '"), F.col("actual"), F.lit("' but expected '"),
                F.col("expected"), F.lit("'"),
            )
        )
    )
    return compare_contract(contract, observed).filter(kind.isNotNull()).select(
        "dataset_name", "error_type", "column_name",
        F.when(missing, F.concat(F.lit("Required column: "), name))
        .when(unexpected, F.lit("Column should not exist")).otherwise(F.col("expected")).alias("expected"),
        F.when(missing, F.lit("Column not found"))
        .when(unexpected, F.concat(F.lit("Column found: "), name)).otherwise(F.col("actual")).alias("actual"),
        message.alias("message"),
    )


def contract_missing(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Required contract columns the dataset does not have."""
    return contract_errors(contract, observed).filter(F.col("error_type") == "missing_column")


def contract_unexpected(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Dataset columns the contract does not know."""
    return contract_errors(contract, observed).filter(F.col("error_type") == "unexpected_column")


def contract_type_mismatch(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Columns on both sides whose normalised types differ."""
    return contract_errors(contract, observed).filter(F.col("error_type") == "type_mismatch")


def contract_validate(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """One verdict per dataset that has a contract, from one comparison of its columns."""
    def errors(kind: str, name: str):
        return F.count_if(F.col("error_type") == kind).alias(name)

    return (
        compare_contract(contract, observed).groupBy("dataset_name").agg(
            F.count_if("in_contract").alias("total_columns_expected"),
            F.count_if("in_data").alias("total_columns_actual"),
            F.count("error_type").alias("error_count"),
            errors("missing_column", "missing_columns"),
            errors("unexpected_column", "unexpected_columns"),
            errors("type_mismatch", "type_mismatches"),
        )
        .filter(F.col("total_columns_expected") > 0)
        .withColumn("is_valid", F.col("error_count") == 0)
    )


# Spark types of the logical contract types.
LOGICAL_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def contract_schema(columns: list[dict]) -> T.StructType:
    """A read schema from the column list of one contract."""
    return T.StructType(
        [T.StructField(c["name"], LOGICAL_TYPES[c["data_type"]], c.get("nullable", True)) for c in columns]
    )
