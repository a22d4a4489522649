"""Checks of schemaless records: a JSON text per row and an arrival index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import named
from tidewatch.functions.skew import join_per_key

SHOWN = 10
VALUE_LENGTH = 50

# JSON value types that satisfy each expected record type
# (a boolean also counts as an int, as in Python).
RECORD_TYPES = {
    "str": ("STRING",),
    "int": ("BIGINT", "BOOLEAN"),
    "float": ("DOUBLE", "DECIMAL"),
    "bool": ("BOOLEAN",),
    "dict": ("OBJECT",),
    "list": ("ARRAY",),
}
TYPE_NAMES = {
    "STRING": "str", "BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float",
    "BOOLEAN": "bool", "OBJECT": "dict", "ARRAY": "list",
}


def missing_fields(payload: Column, required: Sequence[str]) -> Column:
    """Required keys absent from the JSON object, in the given order."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.array_except(wanted, F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))


def record_required_columns(
    df: DataFrame, index: str, payload: str, required: Sequence[str], shown: int | None = None
) -> DataFrame:
    """Records that lack required keys; the first ``shown`` by index, or all."""
    found = (
        df.select(named(index).alias("record_index"), missing_fields(named(payload), required).alias("m"))
        .filter(F.size("m") > 0)
        .select("record_index", F.array_join("m", ",").alias("missing_columns"))
    )
    return found if shown is None else found.orderBy("record_index").limit(shown)


def _key_fields(payload: str, keys: Sequence[str]) -> list[Column]:
    return [F.get_json_object(named(payload), f"$.{k}").alias(k) for k in keys]


def record_duplicates(
    df: DataFrame, index: str, payload: str, keys: Sequence[str], shown: int | None = None
) -> DataFrame:
    """Second and later occurrences of a unique key; an absent key part counts as NULL.

    The first index per key is aggregated and joined back: no group is sorted.
    """
    rows = df.select(named(index).alias("record_index"), F.struct(*_key_fields(payload, keys)).alias("_key"))
    first = rows.groupBy("_key").agg(
        F.min("record_index").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") > 1)
    found = (
        join_per_key(rows, first, ["_key"], "_n")
        .filter(F.col("record_index") > F.col("_first"))
        .select("record_index", "_key.*")
    )
    return found if shown is None else found.orderBy("record_index").limit(shown)


def _variant_type(value: Column) -> Column:
    """Type name of a JSON value: BIGINT, STRING, OBJECT, ...; VOID for null, NULL if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _type_findings(json: str, schema: Mapping[str, str]) -> Column:
    """An entry for each field whose non-null value has another type than expected."""
    def finding(field: str, expected: str) -> Column:
        kind = _variant_type(F.variant_get(json, f"$.{field}", "variant"))
        wrong = kind.isNotNull() & ~kind.isin("VOID", *RECORD_TYPES[expected])
        text = F.substring(F.try_variant_get(json, f"$.{field}", "string"), 1, VALUE_LENGTH)
        # The value is only read for a mismatch.
        return F.when(
            wrong,
            F.struct(
                F.lit(field).alias("field"), F.lit(expected).alias("expected_type"),
                kind.alias("_type"), text.alias("value"),
            ),
        )

    return F.array_compact(F.array(*[finding(f, e) for f, e in schema.items()]))


def record_types(
    df: DataFrame, index: str, payload: str, schema: Mapping[str, str], shown: int | None = None
) -> DataFrame:
    """(record, field) pairs whose non-null value has another type than expected."""
    parsed = df.select(
        named(index).alias("record_index"), F.try_parse_json(named(payload)).alias("_json")
    )
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    found = (
        parsed.select("record_index", F.inline(_type_findings("_json", schema)))
        .select(
            "record_index", "field", "expected_type", names[F.col("_type")].alias("actual_type"), "value"
        )
    )
    return found if shown is None else found.orderBy("record_index", "field").limit(shown)


def existing_duplicates(
    incoming: DataFrame, stored: DataFrame, payload: str, keys: Sequence[str], index: str
) -> DataFrame:
    """Incoming records whose unique key is already stored."""
    rows = incoming.select(
        named(index).alias("record_index"), F.struct(*_key_fields(payload, keys)).alias("_key")
    )
    known = stored.select(F.struct(*_key_fields(payload, keys)).alias("_key")).distinct()
    # Keys are counted and compared first, then joined back to the records.
    present = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(known, "_key", "left_semi")
    return join_per_key(rows, present, ["_key"], "_n").select("record_index", "_key.*")


def row_count_check(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected against actual row counts per key.

    ``expected``: (keys, expected_count). ``actual``: the loaded rows.
    """
    counted = actual.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("actual_count"))
    compared = expected.join(counted, list(keys), "left").withColumn(
        "actual_count", F.coalesce("actual_count", F.lit(0))
    )
    valid = F.col("actual_count") == F.col("expected_count")
    return compared.select(
        *keys,
        valid.alias("is_valid"),
        "expected_count",
        "actual_count",
        (F.col("actual_count") - F.col("expected_count")).alias("difference"),
        F.concat(
            F.lit("Row count validation "), F.when(valid, "passed").otherwise("failed"),
            F.lit(": expected="), F.col("expected_count").cast("string"),
            F.lit(", actual="), F.col("actual_count").cast("string"),
        ).alias("message"),
    )


def validate_batch(
    df: DataFrame,
    index: str,
    payload: str,
    required: Sequence[str] = (),
    unique_keys: Sequence[str] = (),
    schema: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per configured record check with its number of findings, from one scan and one aggregation per key."""
    none = F.lit(0)
    flags = df.select(
        F.struct(*_key_fields(payload, unique_keys), none.alias("_none")).alias("_key"),
        (F.size(missing_fields(named(payload), required)) > 0).cast("int").alias("missing") if required else none.alias("missing"),
        named(payload).alias("_payload"),
    )
    wrong = F.size(_type_findings("_json", schema)) if schema else none
    flags = flags.withColumn("_json", F.try_parse_json("_payload")).select("_key", "missing", wrong.alias("wrong"))
    sums = [F.sum("missing").alias("missing"), F.sum("wrong").alias("wrong")]
    if unique_keys:
        # One row per key, combined before the shuffle; the findings of its records go along.
        flags = flags.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), *sums)
        sums.append(F.sum(F.col("n") - 1).alias("again"))
    counted = flags.agg(*[F.coalesce(s, none).cast("bigint").alias(n) for s, n in zip(sums, ("missing", "wrong", "again"))])
    kinds = [
        (required, "required_columns", "Required columns", " records missing required columns", "missing"),
        (unique_keys, "duplicates", "Duplicate", " duplicate records found", "again"),
        (schema, "data_types", "Data type", " type mismatches found", "wrong"),
    ]
    rows = []
    for wanted, kind, title, text, name in kinds:
        if wanted:
            n = F.col(name)
            message = F.concat(
                F.lit(f"{title} validation "), F.when(n == 0, "passed").otherwise("failed"), F.lit(": "), n.cast("string"), F.lit(text)
            )
            rows.append(
                F.struct(F.lit(kind).alias("validation_type"), (n == 0).alias("is_valid"), n.alias("finding_count"), message.alias("message"))
            )
    return counted.select(F.inline(F.array(*rows)))


def batch_verdict(checks: DataFrame) -> DataFrame:
    """All checks of a batch in one row: overall verdict, passed and failed checks."""
    return checks.agg(
        F.bool_and("is_valid").alias("all_valid"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("is_valid").alias("passed_checks"),
        F.count_if(~F.col("is_valid")).alias("failed_checks"),
    )
