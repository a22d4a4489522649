"""Schema versions and drift, over tables of (dataset, observation, column) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordering import latest_per_key, ordered_changes
from tidewatch.functions.scalars import micros

KINDS = ("removed", "type", "nullability", "added", "position")


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def normalize_schema(columns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per schema: its columns sorted by name, with alphabetical positions.

    A schema has as many distinct entries as a table has columns, so the set is small.
    """
    entry = F.struct(
        F.col("column_name").alias("name"), F.col("data_type"), F.col("nullable")
    )
    return columns.groupBy(*keys).agg(F.array_sort(F.collect_set(entry)).alias("columns"))


def schema_json(columns: Column) -> Column:
    """The document whose hash identifies a version: sorted keys, columns by name."""
    parts = F.transform(
        columns,
        lambda c, i: F.concat(
            F.lit('{"data_type": '), _quoted(c["data_type"]),
            F.lit(', "name": '), _quoted(c["name"]),
            F.lit(', "nullable": '), F.when(c["nullable"], "true").otherwise("false"),
            F.lit(', "position": '), i.cast("string"), F.lit("}"),
        ),
    )
    return F.concat(F.lit('{"columns": ['), F.array_join(parts, ", "), F.lit("]}"))


def schema_hash(columns: Column) -> Column:
    return F.sha2(schema_json(columns), 256)


def register_schemas(observations: DataFrame) -> DataFrame:
    """Versions of every dataset: a new one whenever the schema differs from the one before.

    ``observations``: (dataset_name, observed_at, column_name, data_type,
    nullable). Returns one row per version with its columns, number and hash.
    """
    schemas = normalize_schema(observations, ["dataset_name", "observed_at"]).withColumn(
        "version_hash", schema_hash(F.col("columns"))
    )
    # A dataset has one schema per time, so the time alone orders its observations.
    no_tie = F.lit(0).cast("bigint")
    versions = ordered_changes(
        schemas, ["dataset_name"], micros(F.col("observed_at")), no_tie, "version_hash"
    )
    return versions.select(
        "dataset_name", "version_number", "version_hash",
        F.col("observed_at").alias("detected_at"), "columns",
    )


def register_new_schemas(stored: DataFrame, observations: DataFrame) -> DataFrame:
    """Versions to append to ``stored``: new observations that differ from the latest version before them.

    ``stored`` are rows as ``register_schemas`` returns them, ``observations`` as it
    takes them. Only the latest stored version of a dataset that is observed
    again is compared, and numbers go on from it; observing the same schema again
    adds nothing. New observations count as later than every stored version.
    """
    schemas = normalize_schema(observations, ["dataset_name", "observed_at"]).withColumn(
        "version_hash", schema_hash(F.col("columns"))
    )
    observed = observations.select("dataset_name").distinct()
    latest = latest_per_key(
        stored.join(observed, "dataset_name", "left_semi"), ["dataset_name"], F.col("version_number").desc()
    )
    before = latest.select(
        "dataset_name", F.col("detected_at").alias("observed_at"), "columns", "version_hash",
        F.col("version_number").cast("bigint").alias("_stored_number"),
    )
    rows = schemas.withColumn("_stored_number", F.lit(None).cast("bigint")).unionByName(before)
    # The stored version comes first, whatever its time.
    order = F.when(F.col("_stored_number").isNotNull(), F.lit(-(1 << 53))).otherwise(micros(F.col("observed_at")))
    versions = ordered_changes(rows, ["dataset_name"], order, F.lit(0).cast("bigint"), "version_hash")
    bases = latest.select("dataset_name", (F.col("version_number") - 1).cast("bigint").alias("_offset"))
    return versions.filter(F.col("_stored_number").isNull()).join(bases, "dataset_name", "left").select(
        "dataset_name", (F.col("version_number") + F.coalesce("_offset", F.lit(0))).alias("version_number"), "version_hash",
        F.col("observed_at").alias("detected_at"), "columns",
    )


def version_columns(versions: DataFrame) -> DataFrame:
    """The exploded form: one row per version and column, with its position."""
    return versions.select(
        "dataset_name", "version_number", "version_hash", "detected_at",
        F.posexplode("columns").alias("position", "c"),
    ).select(
        "dataset_name", "version_number", "version_hash", "detected_at",
        F.col("c.name").alias("column_name"), F.col("c.data_type").alias("data_type"),
        F.col("c.nullable").alias("nullable"), "position",
    )


SIDES = ("previous", "current")


def _side(role: str) -> Column:
    """The column as it stands on one side of a comparison."""
    entry = F.struct(F.col("data_type").alias("type"), F.col("nullable"), F.col("position"))
    return F.max(F.when(F.col("_role") == role, entry)).alias(f"_{role}")


def _changes(roles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per change from rows (keys, column_name, data_type, nullable, position, _role), by one aggregation."""
    both = roles.groupBy(*keys, "column_name").agg(*[_side(role) for role in SIDES])
    old, new = F.col("_previous").isNotNull(), F.col("_current").isNotNull()
    kept = old & new
    kinds = F.array_compact(
        F.array(
            F.when(new & ~old, "added"),
            F.when(old & ~new, "removed"),
            F.when(kept & ~F.col("_previous.type").eqNullSafe(F.col("_current.type")), "type"),
            F.when(kept & ~F.col("_previous.nullable").eqNullSafe(F.col("_current.nullable")), "nullability"),
            F.when(kept & (F.col("_previous.position") != F.col("_current.position")), "position"),
        )
    )
    return both.select(
        *keys, "column_name", F.explode(kinds).alias("change"),
        *[F.col(f"_{role}.{f}").alias(f"{role}_{f}") for f in ("type", "nullable", "position") for role in SIDES],
    )


def compare_columns(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """One row per change between two schemas of the same ``keys``.

    Both sides: (keys, column_name, data_type, nullable, position), a column once.
    """
    columns = [*keys, "column_name", "data_type", "nullable", "position"]
    parts = [df.select(*columns, F.lit(role).alias("_role")) for df, role in zip((previous, current), SIDES)]
    return _changes(parts[0].unionAll(parts[1]), keys)


def _compared(columns: DataFrame) -> DataFrame:
    """Every version as the current one of its own comparison and the previous one of the next, with the later one's time."""
    heads = columns.filter((F.col("position") == 0) & (F.col("version_number") > 1)).select(
        "dataset_name", F.col("version_number").alias("current_version"), "detected_at"
    )
    roles = F.array(
        F.struct(F.col("version_number").alias("current_version"), F.lit("current").alias("_role")),
        F.struct((F.col("version_number") + 1).alias("current_version"), F.lit("previous").alias("_role")),
    )
    both = columns.select("dataset_name", "column_name", "data_type", "nullable", "position", F.inline(roles))
    # A first version has nothing before it, and the newest nothing after it.
    return both.join(heads, ["dataset_name", "current_version"])


def drift_changes(columns: DataFrame) -> DataFrame:
    """Every version against its predecessor, one row per change."""
    return _changes(_compared(columns), ["dataset_name", "current_version"])


def categorize(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The most serious kind of change per pair of versions, with its severity."""
    relaxed = (F.col("change") == "nullability") & ~F.col("previous_nullable") & F.col("current_nullable")
    counted = changes.groupBy(*keys).agg(
        *[F.count_if(F.col("change") == k).alias(f"{k}_changes") for k in KINDS],
        F.bool_or(F.coalesce(relaxed, F.lit(False))).alias("_relaxed"),
    )
    has = {k: F.col(f"{k}_changes") > 0 for k in KINDS}
    drift_type = (
        F.when(has["removed"], "column_removed").when(has["type"], "type_changed")
        .when(has["nullability"], "nullability_changed").when(has["added"], "column_added")
        .otherwise("position_changed")
    )
    severity = (
        F.when(has["removed"] | has["type"], "critical")
        .when(has["nullability"] & F.col("_relaxed"), "warning").otherwise("info")
    )
    return counted.withColumn("drift_type", drift_type).withColumn("severity", severity).drop("_relaxed")


def drift_history(columns: DataFrame) -> DataFrame:
    """Drift rows of all versions: type, severity, change counts and time."""
    keys = ["dataset_name", "current_version", "detected_at"]
    drift = categorize(_changes(_compared(columns), keys), keys)
    return drift.withColumn("previous_version", F.col("current_version") - 1).withColumn("acknowledged", F.lit(False))


def compare_versions(columns: DataFrame, version1: int, version2: int) -> DataFrame:
    """Any two versions of every dataset that has both."""
    present = (
        columns.filter(F.col("version_number").isin(version1, version2))
        .select("dataset_name", "version_number").distinct()
        .groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2)
        .select("dataset_name")
    )
    both = columns.join(present, "dataset_name", "left_semi")
    changes = compare_columns(
        both.filter(F.col("version_number") == version1),
        both.filter(F.col("version_number") == version2),
        ["dataset_name"],
    )
    drift = categorize(changes, ["dataset_name"])
    return present.join(drift, "dataset_name", "left").select(
        "dataset_name",
        F.col("drift_type").isNotNull().alias("has_drift"),
        "drift_type", "severity",
        *[F.coalesce(f"{k}_changes", F.lit(0)).alias(f"{k}_changes") for k in KINDS],
    )


def schema_timeline(versions: DataFrame, history: DataFrame) -> DataFrame:
    """Every version with the drift it caused, if any."""
    drift = history.select(
        "dataset_name", F.col("current_version").alias("version_number"), "drift_type", "severity"
    )
    return versions.select("dataset_name", "version_number", "detected_at").join(
        drift, ["dataset_name", "version_number"], "left"
    ).withColumn("drift_occurred", F.col("drift_type").isNotNull())


def acknowledge(history: DataFrame, acknowledgements: DataFrame, keys: list[str]) -> DataFrame:
    """Drift rows with who acknowledged them and when; the latest acknowledgement wins.

    ``acknowledgements``: (keys, acknowledged_by, acknowledged_at, notes).
    """
    latest = latest_per_key(
        acknowledgements, keys, F.col("acknowledged_at").desc(), F.col("acknowledged_by")
    )
    joined = history.drop("acknowledged").join(latest, keys, "left")
    return joined.withColumn("acknowledged", F.col("acknowledged_at").isNotNull())
