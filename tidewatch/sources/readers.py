"""Readers: files by type, folders, logs, contracts and rule documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewatch.functions import fixed


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
    encoding: str = "UTF-8", infer: bool = True,
) -> DataFrame:
    """CSV with a header. Give a schema for large files: inference reads them twice."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    return reader.csv(path)


def read_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
    whole_document: bool = True,
) -> DataFrame:
    """JSON: one document per file (array or object), or one object per line."""
    reader = spark.read.option("multiLine", whole_document)
    return (reader.schema(schema) if schema else reader).json(path)


def read_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV, Parquet or JSON lines, chosen by the end of the path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json(spark, path, whole_document=options.pop("whole_document", False), **options)
    raise ValueError(f"Unsupported file type: {path}")


def read_objects(spark: SparkSession, paths: Sequence[str], kind: str, schema=None) -> DataFrame:
    """Several object-store paths of one format as one frame."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", ",")
    if schema:
        reader = reader.schema(schema)
    return reader.load(list(paths))


def list_objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, modified) of every file below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(folder)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )


def read_processed_or_raw(spark: SparkSession, processed: str, raw: str, **options) -> DataFrame:
    """The processed copy of a dataset if there is one, else the raw file."""
    for path in (processed, raw):
        try:
            return read_by_extension(spark, path, **options)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"Dataset not found: {raw}")


LOG_SCHEMA = "timestamp timestamp_ntz, level string, logger string, message string"


def read_json_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON-lines log without its malformed lines."""
    lines = (
        spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    )
    return lines.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


CONTRACT_SCHEMA = (
    "name string, description string, dataset_name string, version string, is_active boolean, "
    "schema_definition struct<columns: array<struct<name: string, data_type: string, "
    "required: boolean, nullable: boolean>>>, _corrupt_record string"
)


def read_contract_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per contract file, with ``is_readable`` false for a broken document."""
    files = (
        spark.read.schema(CONTRACT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(folder)
    )
    readable = F.col("_corrupt_record").isNull() & F.col("schema_definition").isNotNull()
    return files.select(
        "*", F.col("_metadata.file_path").alias("file_path"), readable.alias("is_readable")
    ).drop("_corrupt_record")


def load_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contract columns, one row each; broken files are left out (see read_contract_files)."""
    return (
        read_contract_files(spark, folder).filter("is_readable")
        .select(
            "name", "dataset_name",
            F.coalesce("version", F.lit("1.0.0")).alias("version"),
            F.coalesce("is_active", F.lit(True)).alias("is_active"),
            F.posexplode("schema_definition.columns").alias("position", "c"),
        )
        .select(
            F.col("name").alias("contract_name"), "dataset_name", "version", "is_active", "position",
            F.col("c.name").alias("column_name"), F.col("c.data_type").alias("data_type"),
            F.coalesce("c.required", F.lit(True)).alias("required"),
            F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
        )
    )


RULES_SCHEMA = (
    "version string, rules array<struct<rule_id: string, name: string, description: string, "
    "rule_type: string, enabled: boolean, target_columns: array<string>, "
    "parameters: map<string, string>, "
    "thresholds: array<struct<metric: string, operator: string, value: double>>, "
    "severity: string, tags: array<string>>>"
)


def load_rules(spark: SparkSession, path: str, whole_document: bool = True) -> DataFrame:
    """Rule definitions, one row each, with the problem of an invalid one in ``problem``."""
    documents = spark.read.schema(RULES_SCHEMA).option("multiLine", whole_document).json(path)
    rules = documents.select(F.explode("rules").alias("r")).select("r.*")
    severity = F.lower(F.coalesce("severity", F.lit("error")))
    problem = (
        F.when(F.coalesce(F.length(F.trim("rule_id")), F.lit(0)) == 0, "rule_id cannot be empty")
        .when(F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0, "name cannot be empty")
        .when(~severity.isin(*fixed.SEVERITIES), "unknown severity")
        .when(F.col("rule_type").isNull() | ~F.col("rule_type").isin(*fixed.RULE_TYPES), "unknown rule type")
    )
    return rules.withColumns(
        {
            "rule_id": F.trim("rule_id"),
            "name": F.trim("name"),
            "severity": severity,
            "enabled": F.coalesce("enabled", F.lit(True)),
            "problem": problem,
        }
    )


def file_type_guard(files: DataFrame, name: str = "name") -> DataFrame:
    """File names with their type and whether it may be ingested."""
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.select("*", kind.alias("file_type"), kind.isin(*fixed.INGESTIBLE_TYPES).alias("supported"))


def check_file_type(path: str) -> str:
    """The type of one path; ValueError if it cannot be ingested."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in fixed.INGESTIBLE_TYPES:
        raise ValueError(
            f"Unsupported file type '{kind}'. Supported formats: {', '.join(fixed.INGESTIBLE_TYPES)}"
        )
    return kind


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A monitoring table kept as Parquet."""
    return spark.read.parquet(path)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str,
    partitions: int, **properties: str,
) -> DataFrame:
    """A monitoring table kept in a database, read in parallel ranges."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
        .option("partitionColumn", partition_column).option("lowerBound", lower)
        .option("upperBound", upper).option("numPartitions", partitions).load()
    )
