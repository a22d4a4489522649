"""Thresholds, type names and word lists the results depend on."""

# Freshness thresholds in hours (healthy up to, warning up to).
FRESHNESS_DEFAULT = (24.0, 48.0)
FRESHNESS_BY_DATASET = {
    "customers": (12.0, 24.0),
    "orders": (6.0, 12.0),
    "transactions": (1.0, 3.0),
    "inventory": (24.0, 48.0),
}

# Service-level hours per dataset.
SLA_DEFAULT = 24.0
SLA_BY_DATASET = {
    "customers": 12.0,
    "orders": 6.0,
    "transactions": 2.0,
    "inventory": 24.0,
    "analytics": 48.0,
}

# Spellings of the logical column types used in contracts.
TYPE_ALIASES = {
    "int": "integer",
    "int64": "integer",
    "int32": "integer",
    "long": "integer",
    "str": "string",
    "object": "string",
    "varchar": "string",
    "text": "string",
    "char": "string",
    "float64": "float",
    "float32": "float",
    "double": "float",
    "decimal": "float",
    "bool": "boolean",
    "datetime": "timestamp",
    "datetime64": "timestamp",
    "time": "timestamp",
}

# Spark type names that satisfy each declared type.
TYPE_FAMILIES = {
    "string": ("string",),
    "integer": ("int", "bigint", "smallint", "tinyint"),
    "float": ("float", "double", "decimal"),
    "boolean": ("boolean",),
    "date": ("date", "timestamp", "timestamp_ntz"),
}

# Texts accepted as booleans.
BOOLEAN_TEXTS = ("true", "false", "1", "0", "True", "False")

# Parts of a failure reason that make a load retryable.
RETRYABLE_REASONS = (
    "timeout",
    "network_error",
    "temporary_error",
    "resource_limit",
    "connection_error",
)

# Messages of the checks before a load is retried: passed, failed, recommendation.
RETRY_CHECKS = {
    "staging": (
        "Staging data exists ({staged} records)",
        "No staging data found - may need to re-ingest",
        "Re-ingest source data before retry",
    ),
    "reason": (
        "Failure reason is retryable",
        "Failure reason may not be retryable - review required",
        "Review failure reason: {reason}",
    ),
    "retries": (
        "Retry count acceptable ({retries}/3)",
        "Maximum retry attempts reached ({retries})",
        "Investigate root cause before further retries",
    ),
    "warehouse": (
        "No partial data in warehouse (clean retry)",
        "Partial data exists in warehouse ({loaded} records)",
        "Clean up partial warehouse data before retry",
    ),
    "elapsed": (
        "Sufficient time elapsed since failure ({hours}h)",
        "Recent failure - consider waiting before retry",
        "Wait at least 1 hour between retry attempts",
    ),
}

# Load states that end a load.
TERMINAL_LOAD_STATES = ("completed", "failed", "rolled_back")

# File types accepted for ingestion.
INGESTIBLE_TYPES = ("csv", "json")

# Rule types, severities and threshold operators.
RULE_TYPES = (
    "null_check",
    "datatype",
    "range",
    "pattern",
    "uniqueness",
    "referential_integrity",
    "custom",
)
SEVERITIES = ("error", "warning", "info")
THRESHOLD_OPERATORS = (">", ">=", "<", "<=", "==", "!=")
