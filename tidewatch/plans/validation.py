"""Queries: validators, integrity, record checks and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import results as R
from tidewatch.operators import checksums, hashtree, integrity, records, rules, runs, validators
from tidewatch.plans.catalog import query
from tidewatch.plans.common import tidy, verdict
from tidewatch.session import written

DIRTY = ["order_id", "customer_id", "priority", "quantity_text", "date_text", "flag_text", "total", "comment"]

_null_rows = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_records, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 1e2 / count(*), 2) AS null_percentage FROM d"
    for c in DIRTY
)
NULL_COUNTS = f"WITH d AS (SELECT * FROM @dirty_orders) {_null_rows}"


@query("null_counts", NULL_COUNTS)
def null_counts(t):
    return validators.null_counts(t.dirty_orders)


@query(
    "null_totals",
    f"""SELECT CAST(sum(null_count) AS BIGINT) AS total_null_values,
      CAST(sum(total_records) AS BIGINT) AS total_cells,
      round(sum(null_count) * 1e2 / sum(total_records), 2) AS overall_null_percentage FROM ({NULL_COUNTS})""",
)
def null_totals(t):
    return validators.null_totals(t.dirty_orders)


@query(
    "null_check",
    """WITH m AS (SELECT count(*) AS n, count(*) - count(customer_id) AS c, count(*) - count(priority) AS p,
        count(*) - count(comment) AS e FROM @dirty_orders),
      r AS (SELECT *, round(c * 1e2 / n, 2) AS cp, round(p * 1e2 / n, 2) AS pp, round(e * 1e2 / n, 2) AS ep FROM m),
      x AS (SELECT *, [v FOR v IN [
        CASE WHEN c > 0 THEN 'Column ''customer_id'' must not contain nulls, found ' || c || ' (' || cp || '%)' END,
        CASE WHEN pp > 15 THEN 'Column ''priority'' exceeds null threshold: ' || pp || '% > 15.0%' END,
        CASE WHEN cp > 50 THEN 'Column ''customer_id'' exceeds global null threshold: ' || cp || '% > 50.0%' END,
        CASE WHEN pp > 50 THEN 'Column ''priority'' exceeds global null threshold: ' || pp || '% > 50.0%' END,
        CASE WHEN ep > 50 THEN 'Column ''comment'' exceeds global null threshold: ' || ep || '% > 50.0%' END,
        CASE WHEN e = n THEN 'Found 1 completely empty column(s): comment' END] IF v IS NOT NULL] AS errs FROM r)
      SELECT 'NullValidator' AS validator_name, CASE WHEN len(errs) = 0 THEN 'passed' ELSE 'failed' END AS status,
        len(errs) = 0 AS passed, n AS total_records, c + p + e AS failed_records,
        round((n - c - p - e) * 1e2 / n, 2) AS pass_rate,
        'Null validation failed: ' || len(errs) || ' issue(s) found' AS message,
        array_to_string(errs, ';') AS errors FROM x""",
)
def null_check(t):
    return verdict(
        validators.null_check(
            t.dirty_orders, non_null_columns=["order_id", "customer_id"], max_null_percentage=50.0,
            column_thresholds={"priority": 15.0},
        )
    )


TYPES = {
    "order_id": "integer", "quantity_text": "integer", "date_text": "date", "flag_text": "boolean",
    "total": "float", "priority": "float",
}
BAD_CELLS = """count(*) FILTER (WHERE quantity_text IS NOT NULL AND TRY_CAST(quantity_text AS BIGINT) IS NULL) AS q,
  count(*) FILTER (WHERE date_text IS NOT NULL AND TRY_CAST(date_text AS DATE) IS NULL) AS dt,
  count(*) FILTER (WHERE flag_text NOT IN ('true', 'false', '1', '0', 'True', 'False')) AS fl,
  count(*) FILTER (WHERE priority IS NOT NULL AND TRY_CAST(priority AS DOUBLE) IS NULL) AS pr,
  count(*) AS n"""


@query(
    "datatype_check",
    f"""WITH m AS (SELECT {BAD_CELLS} FROM @dirty_orders), s AS (SELECT n, q + dt + fl + pr AS f FROM m)
      SELECT 'DatatypeValidator' AS validator_name,
        CASE WHEN f = 0 THEN 'passed' WHEN (n - f) * 1e2 / n >= 95 THEN 'warning' ELSE 'failed' END AS status,
        f = 0 AS passed, n AS total_records, f AS failed_records, round((n - f) * 1e2 / n, 4) AS pass_rate,
        f || ' records failed datatype validation' AS message, 'Column ''absent'' not found in DataFrame' AS errors
      FROM s""",
)
def datatype_check(t):
    return verdict(validators.datatype_check(t.dirty_orders, {**TYPES, "absent": "string"}))


@query(
    "datatype_columns",
    f"""WITH m AS (SELECT {BAD_CELLS} FROM @dirty_orders)
      SELECT n AS total_records, 'order_id' AS column_name, 'bigint' AS actual_type, true AS type_matches,
        CAST(0 AS BIGINT) AS type_mismatch_count FROM m
      UNION ALL SELECT n, 'quantity_text', 'string', false, q FROM m
      UNION ALL SELECT n, 'date_text', 'string', false, dt FROM m
      UNION ALL SELECT n, 'flag_text', 'string', false, fl FROM m
      UNION ALL SELECT n, 'total', 'double', true, 0 FROM m
      UNION ALL SELECT n, 'priority', 'string', false, pr FROM m""",
)
def datatype_columns(t):
    return validators.datatype_columns(t.dirty_orders, TYPES).select(
        "total_records", "column_name", "actual_type", "type_matches", "type_mismatch_count"
    )


@query(
    "pattern_check",
    """SELECT count(*) AS total_records, 'text' AS column_name,
        count(*) FILTER (WHERE text IS NOT NULL AND NOT regexp_matches(text, '[.!?]$')) AS pattern_mismatch_count
      FROM @documents""",
)
def pattern_check(t):
    return validators.datatype_columns(t.documents, string_patterns={"text": "[.!?]$"}).select(
        "total_records", "column_name", "pattern_mismatch_count"
    )


def _range(column: str, low: float, high: float) -> str:
    return (
        f"SELECT count(*) AS total_records, '{column}' AS column_name, "
        f"count(*) FILTER (WHERE {column} < {low} OR {column} > {high}) AS out_of_range_count, "
        f"min({column}) * 1e0 AS actual_min, max({column}) * 1e0 AS actual_max FROM @lineitem"
    )


@query(
    "range_check",
    f"{_range('l_quantity', 5, 45)} UNION ALL {_range('l_discount', '1e-2', '8e-2')} "
    f"UNION ALL {_range('l_linenumber', 1, 6)}",
)
def range_check(t):
    return validators.datatype_columns(
        t.lineitem,
        numeric_ranges={"l_quantity": (5, 45), "l_discount": (0.01, 0.08), "l_linenumber": (1, 6)},
    ).select("total_records", "column_name", "out_of_range_count", "actual_min", "actual_max")


@query(
    "datatype_status",
    """WITH m AS (SELECT l_returnflag || l_linestatus AS part, count(*) AS n,
        count(*) FILTER (WHERE l_quantity > 50 - ascii(l_returnflag) % 3) AS f FROM @lineitem GROUP BY 1)
      SELECT part AS validator_name, n AS total_records, f AS failed_records,
        round((n - f) * 1e2 / n, 4) AS pass_rate,
        CASE WHEN f = 0 THEN 'passed' WHEN (n - f) * 1e2 / n >= 95 THEN 'warning' ELSE 'failed' END AS status FROM m""",
)
def datatype_status(t):
    part = F.concat("l_returnflag", "l_linestatus").alias("part")
    counted = t.lineitem.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_quantity") > 50 - F.ascii("l_returnflag") % 3).alias("f"),
    )
    rows = validators.datatype_status(counted, F.col("n"), F.col("f"), F.col("part"))
    return tidy(rows.select("validator_name", "total_records", "failed_records", "pass_rate", "status"))


# --- checksums ----------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag"]


def _row_text(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns) + ")"


def _digest(hash_sql: str, table: str) -> str:
    """Digits of whole hashes counted place by place, then put together four by four."""
    places = ", ".join(f"sum(strpos('123456789abcdef', substr(h, {p}, 1))) AS d{p}" for p in range(1, 33))
    sums = ", ".join(
        f"CAST(d{p} * 4096 + d{p + 1} * 256 + d{p + 2} * 16 + d{p + 3} AS VARCHAR)" for p in range(1, 33, 4)
    )
    counted = f"SELECT count(*) AS n, {places} FROM (SELECT {hash_sql} AS h FROM {table})"
    return f"SELECT n, concat_ws('|', CAST(n AS VARCHAR), {sums}) AS s FROM ({counted})"


@query(
    "row_checksum",
    f"SELECT l_orderkey, l_linenumber, l_suppkey, md5({_row_text(LINE)}) AS row_checksum FROM @lineitem",
)
def row_checksum(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", checksums.row_checksum(LINE).alias("row_checksum")
    )


@query(
    "row_checksum_sha256",
    "SELECT doc_id, sha256(coalesce(text, 'NULL') || '|' || lang) AS row_checksum FROM @documents",
)
def row_checksum_sha256(t):
    return t.documents.select("doc_id", checksums.row_checksum(["text", "lang"], "sha256").alias("row_checksum"))


@query(
    "dup_checksum_groups",
    """SELECT count(*) AS duplicate_count
      FROM (SELECT md5(text) AS h FROM @documents GROUP BY 1 HAVING count(*) > 1)""",
)
def dup_checksum_groups(t):
    return checksums.duplicate_groups(t.documents, ["text"])


@query(
    "dataset_checksum",
    f"SELECT n AS total_records, md5(s) AS dataset_checksum FROM ({_digest('md5(' + _row_text(LINE) + ')', '@lineitem')})",
)
def dataset_checksum(t):
    return checksums.dataset_checksum(t.lineitem, LINE)


@query(
    "column_checksums",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, md5(s) AS column_checksum FROM ({_digest('md5(' + _row_text([c]) + ')', '@dirty_orders')})"
        for c in ("order_id", "customer_id", "priority", "total")
    ),
)
def column_checksums(t):
    return checksums.column_checksums(t.dirty_orders, ["order_id", "customer_id", "priority", "total"])


@query(
    "checksum_check",
    f"""WITH g AS (SELECT md5({_row_text(['text', 'lang'])}) AS h, count(*) AS k FROM @documents GROUP BY 1),
      d AS (SELECT md5(s) AS actual, n FROM ({_digest('md5(' + _row_text(['text', 'lang']) + ')', '@documents')})),
      x AS (SELECT d.*, (SELECT count(*) FROM g WHERE k > 1) AS dup FROM d)
      SELECT 'ChecksumValidator' AS validator_name, 'failed' AS status, false AS passed, n AS total_records,
        dup AS failed_records, round((n - dup) * 1e2 / n, 2) AS pass_rate,
        'Checksum validation failed: 3 issue(s) found' AS message,
        'Checksum columns not found: absent;Found ' || dup || ' duplicate row(s) based on checksum;'
        || 'Dataset checksum mismatch: expected ''0f0f'', got ''' || actual || '''' AS errors FROM x""",
)
def checksum_check(t):
    return verdict(
        checksums.checksum_check(t.documents, "0f0f", ["text", "lang", "absent"], detect_duplicates=True)
    )


# --- hash trees -----------------------------------------------------------------

TREE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipmode_note"]
TREE_KEYS = ["l_orderkey", "l_linenumber"]
# A copy of the line items in which some rows are gone, some new, some changed and some repeated.
TREE_LEFT = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linestatus END AS l_shipmode_note FROM @lineitem"
TREE_RIGHT = f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 701 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    l_returnflag, l_shipmode_note FROM ({TREE_LEFT}) WHERE l_orderkey % 907 <> 5
  UNION ALL SELECT -l_orderkey, l_linenumber, l_quantity, l_returnflag, NULL FROM ({TREE_LEFT}) WHERE l_orderkey % 1009 = 7
  UNION ALL SELECT * FROM ({TREE_LEFT}) WHERE l_orderkey % 1103 = 11"""


def _tree_text(columns: list[str]) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return " || ".join(parts)


def _tree_sql(table: str, levels: int) -> str:
    """All levels of a hash tree, last level first."""
    number = lambda i: f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))"
    sums = " || '|' || ".join(number(i) for i in range(4))
    leaf = f"""SELECT left(md5({_tree_text(TREE_KEYS)}), {levels}) AS r, md5({_tree_text(TREE)}) AS h FROM ({table})"""
    parts = [f"SELECT {levels} AS level, r AS range, count(*) AS n_rows, md5(count(*) || '|' || {sums}) AS digest FROM ({leaf}) GROUP BY r"]
    names = [f"l{levels}"]
    for level in range(levels - 1, -1, -1):
        below = names[-1]
        parts.append(f"SELECT {level} AS level, left(range, {level}) AS range, CAST(sum(n_rows) AS BIGINT) AS n_rows, md5(string_agg(range || '=' || digest, ',' ORDER BY range)) AS digest FROM {below} GROUP BY 2")
        names.append(f"l{level}")
    ctes = ", ".join(f"{n} AS ({p})" for n, p in zip(names, parts))
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)


@query("hash_tree", _tree_sql(TREE_LEFT, 2))
def hash_tree(t):
    return hashtree.table_tree(t.sql(TREE_LEFT), TREE_KEYS, TREE, 2)


@query("merged_hash_tree", f"SELECT n_rows, digest FROM ({_tree_sql(TREE_LEFT, 3)}) WHERE level = 0")
def merged_hash_tree(t):
    """The digest of a table from the leaves of its parts."""
    parts = [hashtree.leaves(t.sql(f"SELECT * FROM ({TREE_LEFT}) WHERE l_orderkey % 3 = {i}"), TREE_KEYS, TREE, 3) for i in range(3)]
    return hashtree.root_digest(hashtree.hash_tree(hashtree.merged_leaves(*parts)))


@query(
    "differing_ranges",
    f"""SELECT coalesce(a.range, b.range) AS range, coalesce(a.n_rows, 0) AS left_rows, coalesce(b.n_rows, 0) AS right_rows
      FROM ({_tree_sql(TREE_LEFT, 3)}) AS a FULL JOIN ({_tree_sql(TREE_RIGHT, 3)}) AS b ON a.level = b.level AND a.range = b.range
      WHERE coalesce(a.level, b.level) = 3 AND a.digest IS DISTINCT FROM b.digest""",
)
def differing_ranges(t):
    return hashtree.differing_ranges(*[written(hashtree.table_tree(t.sql(x), TREE_KEYS, TREE, 3), "tree") for x in (TREE_LEFT, TREE_RIGHT)])


def _whole_rows(table: str) -> str:
    rows = f"SELECT {', '.join(TREE_KEYS)}, {_tree_text(TREE)} AS whole FROM ({table})"
    return f"SELECT {', '.join(TREE_KEYS)}, count(*) AS n, string_agg(whole, chr(10) ORDER BY whole) AS listed FROM ({rows}) GROUP BY {', '.join(TREE_KEYS)}"


@query(
    "differing_keys",
    f"""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
        CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'changed' END AS kind,
        coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows
      FROM ({_whole_rows(TREE_LEFT)}) AS a FULL JOIN ({_whole_rows(TREE_RIGHT)}) AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
      WHERE a.listed IS DISTINCT FROM b.listed""",
)
def differing_keys(t):
    return hashtree.differing_keys(t.sql(TREE_LEFT), t.sql(TREE_RIGHT), TREE_KEYS, TREE, levels=3)


# --- keys ------------------------------------------------------------------------

PK = ["l_orderkey", "l_linenumber"]
FKS = {"order_ref": ("orders", "order_id"), "supplier_ref": ("suppliers", "supplier_id")}


def _parents(t):
    return {"orders": t.fk_orders, "suppliers": t.fk_suppliers}


ORDER_ORPHAN = "NOT EXISTS (SELECT 1 FROM @fk_orders AS p WHERE p.order_id = c.order_ref)"
SUPPLIER_ORPHAN = "NOT EXISTS (SELECT 1 FROM @fk_suppliers AS p WHERE p.supplier_id = c.supplier_ref)"


@query(
    "pk_uniqueness",
    """SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(n - 1) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_count,
        count(*) FILTER (WHERE n > 1) AS unique_duplicate_keys, count(*) FILTER (WHERE n > 1) > 0 AS has_duplicates,
        coalesce((SELECT string_agg(l_orderkey || ', ' || l_linenumber, ';' ORDER BY l_orderkey, l_linenumber) FROM
          (SELECT l_orderkey, l_linenumber FROM @lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 100)), '') AS sample_keys
      FROM (SELECT count(*) AS n FROM @lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def pk_uniqueness(t):
    return tidy(integrity.pk_uniqueness(t.lineitem, PK))


@query(
    "duplicate_key_samples",
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrence_count FROM @lineitem GROUP BY 1, 2
      HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 100""",
)
def duplicate_key_samples(t):
    return integrity.duplicate_keys(t.lineitem, PK)


@query(
    "detect_duplicates",
    """SELECT CAST(sum(n) AS BIGINT) AS total_records, count(*) AS unique_records,
        CAST(sum(n) AS BIGINT) - count(*) AS duplicate_count, sum(n) > count(*) AS has_duplicates,
        (SELECT string_agg(coalesce(CAST(customer_id AS VARCHAR), 'NULL') || ', ' || coalesce(priority, 'NULL'), ';'
            ORDER BY customer_id NULLS FIRST, priority NULLS FIRST) FROM
          (SELECT customer_id, priority FROM @dirty_orders GROUP BY 1, 2 HAVING count(*) > 1
            ORDER BY 1 NULLS FIRST, 2 NULLS FIRST LIMIT 100)) AS sample_keys
      FROM (SELECT count(*) AS n FROM @dirty_orders GROUP BY customer_id, priority)""",
)
def detect_duplicates(t):
    return tidy(integrity.detect_duplicates(t.dirty_orders, ["customer_id", "priority"]))


@query(
    "dup_pk_rows",
    """SELECT l.order_ref, l.l_linenumber, l.l_partkey, l.l_extendedprice, k.n AS _pk_occurrence_count FROM @fk_child AS l
      JOIN (SELECT order_ref, l_linenumber, count(*) AS n FROM @fk_child GROUP BY 1, 2 HAVING count(*) > 1) AS k
      ON l.order_ref = k.order_ref AND l.l_linenumber = k.l_linenumber""",
)
def dup_pk_rows(t):
    rows = integrity.dup_pk_rows(t.fk_child, ["order_ref", "l_linenumber"])
    return rows.select("order_ref", "l_linenumber", "l_partkey", "l_extendedprice", "_pk_occurrence_count")


@query("fk_orphans", f"SELECT c.* FROM @fk_child AS c WHERE {ORDER_ORPHAN}")
def fk_orphans(t):
    return integrity.fk_orphans(t.fk_child, "order_ref", t.fk_orders, "order_id")


@query(
    "fk_orphan_values",
    f"SELECT DISTINCT c.order_ref FROM @fk_child AS c WHERE {ORDER_ORPHAN} ORDER BY 1 NULLS FIRST LIMIT 100",
)
def fk_orphan_values(t):
    return integrity.fk_orphan_values(t.fk_child, "order_ref", t.fk_orders, "order_id")


def _orphan_sample(column: str, orphan: str) -> str:
    return f"""coalesce((SELECT string_agg(coalesce(CAST({column} AS VARCHAR), 'NULL'), ';' ORDER BY {column} NULLS FIRST) FROM
      (SELECT DISTINCT c.{column} FROM @fk_child AS c WHERE {orphan} ORDER BY 1 NULLS FIRST LIMIT 100)), '') AS sample_orphans"""


@query(
    "fk_check",
    f"""SELECT 'order_ref' AS fk_column, 'orders' AS parent_dataset, 'order_id' AS parent_key_column,
        count(*) = 0 AS valid, count(*) AS orphan_count,
        count(DISTINCT coalesce(c.order_ref, -1)) AS orphan_keys, {_orphan_sample("order_ref", ORDER_ORPHAN)}, CAST(NULL AS VARCHAR) AS error
      FROM @fk_child AS c WHERE {ORDER_ORPHAN}
      UNION ALL SELECT 'supplier_ref', 'suppliers', 'supplier_id', count(*) = 0, count(*),
        count(DISTINCT c.supplier_ref), {_orphan_sample("supplier_ref", SUPPLIER_ORPHAN)}, NULL FROM @fk_child AS c WHERE {SUPPLIER_ORPHAN}
      UNION ALL SELECT 'l_partkey', 'parts', 'p_partkey', false, 0, 0, '', 'Parent dataset ''parts'' not provided'""",
)
def fk_check(t):
    return tidy(integrity.fk_check(t.fk_child, {**FKS, "l_partkey": ("parts", "p_partkey")}, _parents(t)))


@query(
    "integrity_check",
    f"""WITH k AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS d FROM
        (SELECT count(*) AS n FROM @fk_child GROUP BY l_orderkey, l_linenumber)),
      o AS (SELECT count(*) AS c FROM @fk_child AS c WHERE {ORDER_ORPHAN}),
      s AS (SELECT count(*) AS c FROM @fk_child AS c WHERE {SUPPLIER_ORPHAN}),
      x AS (SELECT k.n, k.d, o.c AS o, s.c AS s, k.d + o.c + s.c AS f FROM k, o, s)
      SELECT 'ReferentialIntegrityValidator' AS validator_name, 'failed' AS status, false AS passed,
        n AS total_records, f AS failed_records, round((n - f) * 1e2 / n, 4) AS pass_rate,
        'Referential integrity validation failed with 3 issue(s)' AS message,
        'Found ' || d || ' duplicate primary key value(s) in columns: l_orderkey, l_linenumber;' ||
        array_to_string(list_sort(['Found ' || o || ' orphan record(s) with invalid foreign key ''order_ref''',
          'Found ' || s || ' orphan record(s) with invalid foreign key ''supplier_ref''']), ';') AS errors FROM x""",
)
def integrity_check(t):
    return verdict(integrity.integrity_check(t.fk_child, PK, FKS, _parents(t)))


UNION_ORPHANS = f"""SELECT c.*, 'order_ref' AS _invalid_fk_column FROM @fk_child AS c WHERE {ORDER_ORPHAN}
  UNION ALL SELECT c.*, 'supplier_ref' FROM @fk_child AS c WHERE {SUPPLIER_ORPHAN}"""


@query("union_orphans", UNION_ORPHANS)
def union_orphans(t):
    return integrity.union_orphans(t.fk_child, FKS, _parents(t))


@query(
    "union_failed_rows",
    f"""SELECT l.*, k.n AS _pk_occurrence_count, 'duplicate_primary_key' AS validation_failure_type,
        CAST(NULL AS VARCHAR) AS _invalid_fk_column FROM @fk_child AS l
      JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM @lineitem GROUP BY 1, 2 HAVING count(*) > 1) AS k
        ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber
      UNION ALL SELECT * EXCLUDE (_invalid_fk_column), NULL, 'orphan_foreign_key', _invalid_fk_column
      FROM ({UNION_ORPHANS})""",
)
def union_failed_rows(t):
    return integrity.union_failed_rows(t.fk_child, PK, FKS, _parents(t))


@query("extract_failed_rows_by_condition", "SELECT * FROM @dirty_orders WHERE priority <> '1-URGENT'")
def extract_failed_rows_by_condition(t):
    return integrity.rows_not_matching(t.dirty_orders, "priority", "1-URGENT")


@query(
    "column_set_diff",
    """WITH r AS (SELECT dataset_name, column_name FROM @contract_columns WHERE required),
      o AS (SELECT dataset_name, column_name FROM @contract_columns WHERE NOT required),
      a AS (SELECT dataset_name, column_name FROM @observed_columns)
      SELECT *, 'missing' AS change FROM (SELECT * FROM r EXCEPT SELECT * FROM a)
      UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT (SELECT * FROM r UNION ALL SELECT * FROM o))
      UNION ALL SELECT *, 'present_optional' FROM (SELECT * FROM o INTERSECT SELECT * FROM a)""",
)
def column_set_diff(t):
    contract = t.contract_columns
    return integrity.column_set_diff(
        contract.filter("required"), contract.filter("NOT required"), t.observed_columns,
        ["dataset_name", "column_name"],
    )


@query("distinct_values", "SELECT DISTINCT customer_id, priority FROM @dirty_orders")
def distinct_values(t):
    return t.dirty_orders.select("customer_id", "priority").distinct()


# --- schema ------------------------------------------------------------------------

COUNTS = """(SELECT 'group_' || CAST(user_id % 20 AS VARCHAR) AS dataset_name, count(*) AS total_records
  FROM @events GROUP BY 1)"""


def _row_counts(t):
    return t.events.groupBy(
        F.concat(F.lit("group_"), (F.col("user_id") % 20).cast("string")).alias("dataset_name")
    ).agg(F.count(F.lit(1)).alias("total_records"))


@query(
    "column_existence",
    f"""WITH w AS (SELECT dataset_name, column_name, required FROM @contract_columns),
      h AS (SELECT DISTINCT dataset_name, column_name FROM @observed_columns),
      j AS (SELECT coalesce(w.dataset_name, h.dataset_name) AS dataset_name, coalesce(w.column_name, h.column_name) AS c,
        w.required, h.column_name IS NOT NULL AS seen FROM w FULL JOIN h USING (dataset_name, column_name)),
      g AS (SELECT dataset_name, count(*) FILTER (WHERE required) AS req, count(*) FILTER (WHERE required AND NOT seen) AS mis,
        count(*) FILTER (WHERE seen AND required IS NULL) AS ext, count(*) FILTER (WHERE seen AND NOT required) AS opt,
        string_agg(c, ', ' ORDER BY c) FILTER (WHERE required AND NOT seen) AS names,
        string_agg(c, ', ' ORDER BY c) FILTER (WHERE seen AND required IS NULL) AS extras FROM j GROUP BY 1)
      SELECT g.dataset_name, 'ColumnExistenceValidator' AS validator_name,
        CASE WHEN mis > 0 THEN 'failed' WHEN ext > 0 THEN 'warning' ELSE 'passed' END AS status,
        mis = 0 AND ext = 0 AS passed, CASE WHEN mis = 0 AND ext = 0 THEN n.total_records ELSE 0 END AS total_records,
        CAST(0 AS BIGINT) AS failed_records, CASE WHEN mis = 0 AND ext = 0 THEN 1e2 ELSE 0e0 END AS pass_rate,
        CASE WHEN mis > 0 THEN 'Column validation failed: ' || mis || ' required column(s) missing'
          WHEN ext > 0 THEN 'Column validation warning: ' || ext || ' unexpected column(s) found'
          ELSE 'All ' || req || ' required columns present'
            || CASE WHEN opt > 0 THEN ', ' || opt || ' optional column(s) present' ELSE '' END END AS message,
        concat_ws(';', 'Missing ' || mis || ' required column(s): ' || names,
          'Found ' || ext || ' unexpected column(s): ' || extras) AS errors
      FROM g LEFT JOIN {COUNTS} AS n ON g.dataset_name = n.dataset_name""",
)
def column_existence(t):
    return verdict(
        validators.column_existence(
            t.contract_columns, t.observed_columns, _row_counts(t), allow_extra_columns=False
        ),
        "dataset_name",
    )


@query(
    "schema_check",
    f"""WITH w AS (SELECT dataset_name, column_name, required, data_type FROM @contract_columns),
      h AS (SELECT dataset_name, column_name, data_type FROM @observed_columns),
      j AS (SELECT coalesce(w.dataset_name, h.dataset_name) AS dataset_name, coalesce(w.column_name, h.column_name) AS c,
        w.required, h.column_name IS NOT NULL AS seen, w.data_type <> h.data_type AS wrong
        FROM w FULL JOIN h ON w.dataset_name = h.dataset_name AND w.column_name = h.column_name),
      g AS (SELECT dataset_name, count(*) FILTER (WHERE wrong) AS bad,
        string_agg(c, ', ' ORDER BY c) FILTER (WHERE required AND NOT seen) AS names FROM j GROUP BY 1),
      x AS (SELECT g.*, (CASE WHEN bad > 0 THEN 1 ELSE 0 END) + (CASE WHEN names IS NULL THEN 0 ELSE 1 END) AS issues FROM g)
      SELECT x.dataset_name, 'SchemaValidator' AS validator_name,
        CASE WHEN issues = 0 THEN 'passed' ELSE 'failed' END AS status, issues = 0 AS passed,
        CASE WHEN issues = 0 THEN n.total_records ELSE 0 END AS total_records, CAST(0 AS BIGINT) AS failed_records,
        CASE WHEN issues = 0 THEN 1e2 ELSE 0e0 END AS pass_rate,
        CASE WHEN issues = 0 THEN 'Schema validation passed'
          ELSE 'Schema validation failed: ' || issues || ' issue(s) found' END AS message,
        concat_ws(';', 'Missing required columns: ' || names,
          CASE WHEN bad > 0 THEN 'Type mismatches found in ' || bad || ' column(s)' END) AS errors
      FROM x LEFT JOIN {COUNTS} AS n ON x.dataset_name = n.dataset_name""",
)
def schema_check(t):
    return verdict(validators.schema_check(t.contract_columns, t.observed_columns, _row_counts(t)), "dataset_name")


@query(
    "aggregate_results",
    """WITH g AS (SELECT dataset_name, count(*) AS total_validators,
        count(*) FILTER (WHERE status = 'passed') AS passed_validators,
        count(*) FILTER (WHERE status = 'failed') AS failed_validators,
        count(*) FILTER (WHERE status = 'warning') AS warning_validators,
        count(*) FILTER (WHERE status = 'error') AS error_validators,
        coalesce(min_by(total_records, id) FILTER (WHERE total_records > 0), 0) AS total_records,
        round(coalesce(sum(execution_time_ms), 0), 4) AS total_execution_time_ms FROM @audit_logs GROUP BY 1)
      SELECT *, CASE WHEN error_validators > 0 THEN 'error' WHEN failed_validators > 0 THEN 'failed'
        WHEN warning_validators > 0 THEN 'warning' ELSE 'passed' END AS overall_status,
        error_validators + failed_validators + warning_validators = 0 AS overall_passed FROM g""",
)
def aggregate_results(t):
    return tidy(R.aggregate_results(t.audit_logs, ["dataset_name"], order="id"))


CONTRACT = [
    {"name": "order_id", "data_type": "integer"},
    {"name": "customer_id", "data_type": "integer"},
    {"name": "quantity_text", "data_type": "integer"},
    {"name": "total", "data_type": "float"},
    {"name": "comment", "data_type": "string", "required": False},
    {"name": "discount", "data_type": "float", "required": False},
]
DEFAULTS_SQL = f"""WITH m AS (SELECT count(*) AS n, count(*) - count(customer_id) AS c, count(*) - count(priority) AS p,
    count(*) - count(comment) AS e,
    count(*) FILTER (WHERE TRY_CAST(quantity_text AS BIGINT) IS NULL) AS q FROM @dirty_orders),
  r AS (SELECT *, (CASE WHEN round(c * 1e2 / n, 2) > 5 THEN 1 ELSE 0 END) + (CASE WHEN round(p * 1e2 / n, 2) > 5 THEN 1 ELSE 0 END) + 2 AS k FROM m)
  SELECT 'dirty_orders' AS dataset_name, 0 AS position, 'ColumnExistenceValidator' AS validator_name, 'passed' AS status,
    n AS total_records, CAST(0 AS BIGINT) AS failed_records, 1e2 AS pass_rate,
    'All 4 required columns present, 1 optional column(s) present, ' || (8 - 5) || ' extra column(s) allowed' AS message FROM r
  UNION ALL SELECT 'dirty_orders', 1, 'SchemaValidator', 'failed', 0, 0, 0e0, 'Schema validation failed: 1 issue(s) found' FROM r
  UNION ALL SELECT 'dirty_orders', 2, 'NullValidator', 'failed', n, c + p + e, round((n - c - p - e) * 1e2 / n, 2),
    'Null validation failed: ' || k || ' issue(s) found' FROM r
  UNION ALL SELECT 'dirty_orders', 3, 'DatatypeValidator', CASE WHEN (n - q) * 1e2 / n >= 95 THEN 'warning' ELSE 'failed' END,
    n, q, round((n - q) * 1e2 / n, 4), q || ' records failed datatype validation' FROM r
  UNION ALL SELECT 'dirty_orders', 4, 'ChecksumValidator', 'passed', n, 0, 1e2,
    'Checksum validation passed (algorithm: md5)' FROM r"""


def default_results(t):
    return runs.validate_with_defaults(
        t.dirty_orders, "dirty_orders", CONTRACT, checksum_columns=["order_id", "total"]
    )


@query("validate_with_defaults", DEFAULTS_SQL)
def validate_with_defaults(t):
    return tidy(
        default_results(t).select(
            "dataset_name", "position", "validator_name", "status", "total_records", "failed_records",
            "pass_rate", "message",
        )
    )


# --- records -----------------------------------------------------------------------

REQUIRED = ["id", "kind", "user"]
MISSING = """SELECT idx AS record_index, concat_ws(',', CASE WHEN json_exists(payload, '$.id') THEN NULL ELSE 'id' END,
    CASE WHEN json_exists(payload, '$.kind') THEN NULL ELSE 'kind' END,
    CASE WHEN json_exists(payload, '$.user') THEN NULL ELSE 'user' END) AS missing_columns
  FROM @records WHERE NOT (json_exists(payload, '$.id') AND json_exists(payload, '$.kind') AND json_exists(payload, '$.user'))"""


@query("record_required_columns", MISSING)
def record_required_columns(t):
    return records.record_required_columns(t.records, "idx", "payload", REQUIRED)


@query("sample_first_n", f"{MISSING} ORDER BY 1 LIMIT 10")
def sample_first_n(t):
    return records.record_required_columns(t.records, "idx", "payload", REQUIRED, records.SHOWN)


REPEATED = """SELECT idx AS record_index, payload ->> '$.kind' AS kind, payload ->> '$.user' AS "user",
    row_number() OVER (PARTITION BY payload ->> '$.kind', payload ->> '$.user' ORDER BY idx) AS rn FROM @records"""


@query("record_duplicates", f'SELECT record_index, kind, "user" FROM ({REPEATED}) WHERE rn > 1')
def record_duplicates(t):
    return records.record_duplicates(t.records, "idx", "payload", ["kind", "user"])


@query(
    "occurrence_index",
    f'SELECT record_index, kind, "user" FROM ({REPEATED}) WHERE rn > 1 ORDER BY record_index LIMIT 10',
)
def occurrence_index(t):
    return records.record_duplicates(t.records, "idx", "payload", ["kind", "user"], records.SHOWN)


RECORD_SCHEMA = {"id": "int", "kind": "str", "amount": "float", "active": "bool", "user": "str"}


def _wrong(field: str, expected: str, types: str) -> str:
    actual = (
        f"CASE json_type(payload, '$.{field}') WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' "
        "WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
    )
    return (
        f"SELECT idx AS record_index, '{field}' AS field, '{expected}' AS expected_type, {actual} AS actual_type, "
        f"substr(payload ->> '$.{field}', 1, 50) AS value FROM @records "
        f"WHERE json_type(payload, '$.{field}') NOT IN ({types}, 'NULL')"
    )


WRONG_TYPES = " UNION ALL ".join(
    [
        _wrong("id", "int", "'BIGINT', 'UBIGINT', 'BOOLEAN'"),
        _wrong("kind", "str", "'VARCHAR'"),
        _wrong("amount", "float", "'DOUBLE'"),
        _wrong("active", "bool", "'BOOLEAN'"),
        _wrong("user", "str", "'VARCHAR'"),
    ]
)


@query("record_types", WRONG_TYPES)
def record_types(t):
    return records.record_types(t.records, "idx", "payload", RECORD_SCHEMA)


@query(
    "existing_duplicates",
    """SELECT idx AS record_index, payload ->> '$.id' AS id FROM @records
      WHERE payload ->> '$.id' IN (SELECT CAST(3 * CAST(payload ->> '$.id' AS BIGINT) AS VARCHAR) FROM @records)""",
)
def existing_duplicates(t):
    stored = t.records.select(
        "idx", F.to_json(F.struct((3 * F.get_json_object("payload", "$.id").cast("bigint")).alias("id"))).alias("payload")
    )
    return records.existing_duplicates(t.records, stored, "payload", ["id"], "idx")


@query(
    "row_count_check",
    """WITH e AS (SELECT batch_id, dataset_name, records_loaded % 8 AS expected_count FROM @load_history),
      a AS (SELECT batch_id, dataset_name, count(*) AS n FROM @processed GROUP BY 1, 2),
      j AS (SELECT e.*, coalesce(a.n, 0) AS actual_count FROM e LEFT JOIN a
        ON e.batch_id = a.batch_id AND e.dataset_name = a.dataset_name)
      SELECT batch_id, dataset_name, actual_count = expected_count AS is_valid, expected_count, actual_count,
        actual_count - expected_count AS difference,
        'Row count validation ' || CASE WHEN actual_count = expected_count THEN 'passed' ELSE 'failed' END
        || ': expected=' || expected_count || ', actual=' || actual_count AS message FROM j""",
)
def row_count_check(t):
    expected = t.load_history.select(
        "batch_id", "dataset_name", (F.col("records_loaded") % 8).alias("expected_count")
    )
    return records.row_count_check(expected, t.processed, ["batch_id", "dataset_name"])


@query(
    "validate_batch",
    f"""WITH c AS (SELECT 'required_columns' AS validation_type, count(*) AS finding_count FROM ({MISSING})
      UNION ALL SELECT 'duplicates', count(*) FROM ({REPEATED}) WHERE rn > 1
      UNION ALL SELECT 'data_types', count(*) FROM ({WRONG_TYPES}))
      SELECT validation_type, finding_count = 0 AS is_valid, finding_count,
        CASE validation_type WHEN 'required_columns' THEN 'Required columns' WHEN 'duplicates' THEN 'Duplicate'
          ELSE 'Data type' END || ' validation ' || CASE WHEN finding_count = 0 THEN 'passed' ELSE 'failed' END || ': '
        || finding_count || CASE validation_type WHEN 'required_columns' THEN ' records missing required columns'
          WHEN 'duplicates' THEN ' duplicate records found' ELSE ' type mismatches found' END AS message FROM c""",
)
def validate_batch(t):
    return records.validate_batch(t.records, "idx", "payload", REQUIRED, ["kind", "user"], RECORD_SCHEMA)


@query(
    "batch_verdict",
    f"""WITH c AS (SELECT count(*) = 0 AS ok FROM ({MISSING})
      UNION ALL SELECT count(*) = 0 FROM (SELECT 1 FROM @records GROUP BY idx HAVING count(*) > 1))
      SELECT bool_and(ok) AS all_valid, count(*) AS total_checks, count(*) FILTER (WHERE ok) AS passed_checks,
        count(*) FILTER (WHERE NOT ok) AS failed_checks FROM c""",
)
def batch_verdict(t):
    unique = t.records.withColumn("payload", F.to_json(F.struct("idx", "payload")))
    checks = records.validate_batch(t.records, "idx", "payload", REQUIRED).unionAll(
        records.validate_batch(unique, "idx", "payload", unique_keys=["idx"])
    )
    return records.batch_verdict(checks)


# --- rules ---------------------------------------------------------------------------


def _rule(rule_id, kind, columns=(), thresholds=(), enabled=True, **parameters):
    return rules.parse_rule(
        {
            "rule_id": rule_id, "name": rule_id.replace("_", " "), "rule_type": kind, "enabled": enabled,
            "target_columns": list(columns), "parameters": parameters,
            "thresholds": [dict(zip(("metric", "operator", "value"), x)) for x in thresholds],
        }
    )


def _rule_sql(rule_id: str, kind: str, total: str, failed: str, status: str, table: str) -> str:
    return (
        f"SELECT '{rule_id}' AS rule_id, '{kind}' AS rule_type, {status} AS status, n AS total_records, "
        f"f AS failed_records, round((n - f) * 1e2 / n, 2) AS pass_rate FROM "
        f"(SELECT {total} AS n, {failed} AS f FROM {table})"
    )


NULLS_FAILED = "count(*) - count(customer_id) + count(*) - count(priority)"
RULE_SQL = {
    "rule_null_check": _rule_sql(
        "orders_nulls", "null_check", "count(*)", NULLS_FAILED,
        "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", "@dirty_orders",
    ),
    "rule_datatype": _rule_sql(
        "orders_types", "datatype", "count(*)",
        "count(*) FILTER (WHERE TRY_CAST(quantity_text AS BIGINT) IS NULL)",
        "CASE WHEN f = 0 THEN 'passed' WHEN (n - f) * 1e2 / n >= 95 THEN 'warning' ELSE 'failed' END",
        "@dirty_orders",
    ),
    "rule_range": _rule_sql(
        "total_range", "range", "count(*)", "count(*) FILTER (WHERE total < 2000 OR total > 450000)",
        "CASE WHEN round((n - f) * 1e2 / n, 2) >= 99 THEN CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END ELSE 'failed' END",
        "@dirty_orders",
    ),
    "rule_pattern": _rule_sql(
        "date_pattern", "pattern", "count(*)",
        "count(*) FILTER (WHERE NOT regexp_matches(date_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))",
        "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", "@dirty_orders",
    ),
    "rule_uniqueness": _rule_sql(
        "order_unique", "uniqueness", "count(*)", "count(*) - count(DISTINCT order_id)",
        "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", "@dirty_orders",
    ),
    "rule_referential": _rule_sql(
        "order_parent", "referential_integrity", "count(*)", f"count(*) FILTER (WHERE {ORDER_ORPHAN})",
        "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", "@fk_child AS c",
    ),
}
RULES = {
    "rule_null_check": _rule("orders_nulls", "null_check", ["customer_id", "priority"]),
    "rule_datatype": _rule("orders_types", "datatype", expected_types={"quantity_text": "integer", "order_id": "integer"}),
    "rule_range": _rule("total_range", "range", ["total"], [("pass_rate", ">=", 99.0)], min_value=2000, max_value=450000),
    "rule_pattern": _rule("date_pattern", "pattern", ["date_text"], pattern="^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    "rule_uniqueness": _rule("order_unique", "uniqueness", ["order_id"], [("pass_rate", "==", 100.0)]),
}
RULE_COLUMNS = ["rule_id", "rule_type", "status", "total_records", "failed_records", "pass_rate"]


def _one_rule(key):
    @query(key, RULE_SQL[key])
    def plan(t):
        return rules.run_rules(t.dirty_orders, [RULES[key]]).select(*RULE_COLUMNS)

    return plan


for _key in RULES:
    _one_rule(_key)


@query("rule_referential", RULE_SQL["rule_referential"])
def rule_referential(t):
    rule = _rule(
        "order_parent", "referential_integrity", reference_df=t.fk_orders, source_column="order_ref",
        reference_column="order_id",
    )
    return rules.run_rules(t.fk_child, [rule]).select(*RULE_COLUMNS)


CUSTOM = _rule_sql(
    "custom_total", "custom", "count(*)", "count(*) FILTER (WHERE NOT coalesce(total > customer_id * 100, false))",
    "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", "@dirty_orders",
)
ALL_RULES = [
    *RULES.values(),
    _rule("custom_total", "custom", expression="total > customer_id * 100"),
    _rule("off", "range", ["total"], enabled=False, min_value=0),
    _rule("no_column", "null_check", ["absent"]),
    _rule("no_parent", "referential_integrity"),
    _rule("bad_column", "custom", expression="nowhere > 3"),
    _rule("bad_sql", "custom", expression="total >"),
    _rule("bad_pattern", "pattern", ["priority"], pattern="(open"),
]
RUN_ALL = " UNION ALL ".join(
    [RULE_SQL[k] for k in RULES]
    + [
        CUSTOM,
        "SELECT 'no_column', 'null_check', 'error', 0, 0, 0e0",
        "SELECT 'no_parent', 'referential_integrity', 'error', 0, 0, 0e0",
        "SELECT 'bad_column', 'custom', 'error', 0, 0, 0e0",
        "SELECT 'bad_sql', 'custom', 'error', 0, 0, 0e0",
        "SELECT 'bad_pattern', 'pattern', 'error', 0, 0, 0e0",
    ]
)


@query("rule_run_all", RUN_ALL)
def rule_run_all(t):
    return rules.run_rules(t.dirty_orders, ALL_RULES).select(*RULE_COLUMNS)


@query(
    "rule_run_summary",
    f"""SELECT count(*) AS total_rules, count(*) FILTER (WHERE status = 'passed') AS passed_rules,
      count(*) FILTER (WHERE status <> 'passed') AS failed_rules FROM ({RUN_ALL})""",
)
def rule_run_summary(t):
    return rules.run_summary(rules.run_rules(t.dirty_orders, ALL_RULES))


THRESHOLDS = """SELECT 'rule_' || CAST(p_partkey AS VARCHAR) AS rule_id,
    CASE p_size % 4 WHEN 0 THEN 'pass_rate' WHEN 1 THEN 'failed_records' WHEN 2 THEN 'total_records' ELSE 'latency' END AS metric,
    CASE p_partkey % 6 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '==' ELSE '!=' END AS operator,
    p_size * 2e0 AS value FROM @part"""
RULE_RESULTS = """SELECT 'rule_' || CAST(l_partkey AS VARCHAR) AS rule_id, count(*) AS total_records,
    count(*) FILTER (WHERE l_discount > 5e-2) AS failed_records,
    (count(*) - count(*) FILTER (WHERE l_discount > 5e-2)) * 1e2 / count(*) AS pass_rate FROM @lineitem GROUP BY 1"""
EVALUATED = f"""SELECT r.rule_id, metric, operator, value AS expected,
    CASE metric WHEN 'pass_rate' THEN pass_rate WHEN 'failed_records' THEN failed_records * 1e0 ELSE total_records * 1e0 END AS actual
  FROM ({RULE_RESULTS}) AS r JOIN ({THRESHOLDS}) AS h ON r.rule_id = h.rule_id WHERE metric <> 'latency'"""
MET = """CASE operator WHEN '>' THEN actual > expected WHEN '>=' THEN actual >= expected WHEN '<' THEN actual < expected
    WHEN '<=' THEN actual <= expected WHEN '==' THEN actual = expected ELSE actual <> expected END"""


def _evaluated(t):
    def spark(text):
        return t.sql(text.replace("VARCHAR", "STRING").replace("count(*) FILTER (WHERE l_discount > 5e-2)", "count_if(l_discount > 5e-2)"))

    return rules.threshold_results(spark(RULE_RESULTS), spark(THRESHOLDS))


@query(
    "rule_thresholds",
    f"SELECT rule_id, metric, operator, expected, round(actual, 4) AS actual, {MET} AS met FROM ({EVALUATED})",
)
def rule_thresholds(t):
    return tidy(_evaluated(t))


@query(
    "rule_verdicts",
    f"""SELECT rule_id, bool_and({MET}) AS passed, count(*) FILTER (WHERE NOT {MET}) AS violations
      FROM ({EVALUATED}) GROUP BY 1""",
)
def rule_verdicts(t):
    return rules.rule_verdicts(_evaluated(t))


@query(
    "rule_inventory",
    """SELECT count(*) AS total_rules, count(*) FILTER (WHERE enabled) AS enabled_rules,
      count(*) FILTER (WHERE NOT enabled) AS disabled_rules FROM @rule_table""",
)
def rule_inventory(t):
    return rules.inventory(t.rule_table)


@query("rule_tags", "SELECT DISTINCT unnest(tags) AS tag FROM @rule_table")
def rule_tags(t):
    return rules.distinct_tags(t.rule_table)


@query(
    "rule_select",
    """SELECT rule_id, name, rule_type, severity FROM @rule_table
      WHERE enabled AND rule_type = 'range' AND list_contains(tags, 'ECONOMY')""",
)
def rule_select(t):
    return rules.select_rules(t.rule_table, enabled=True, rule_type="range", tag="ECONOMY").select(
        "rule_id", "name", "rule_type", "severity"
    )
