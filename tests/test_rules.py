import json

import pytest

from tidewatch.operators import rules


def rule(kind, columns=(), thresholds=(), **extra):
    return {
        "rule_id": extra.pop("rule_id", kind), "name": kind, "rule_type": kind, "target_columns": list(columns),
        "thresholds": [dict(zip(("metric", "operator", "value"), t)) for t in thresholds],
        **({"enabled": extra.pop("enabled")} if "enabled" in extra else {}), "parameters": extra,
    }


def run(df, *definitions, **options):
    parsed = rules.parse_rules({"rules": list(definitions)})
    return {r.rule_id: r for r in rules.run_rules(df, parsed, **options).collect()}


def test_parsing_rejects_bad_rules():
    good = rule("range", ["age"])
    for change in ({"rule_id": " "}, {"name": ""}, {"severity": "fatal"}, {"rule_type": "magic"}):
        with pytest.raises(ValueError):
            rules.parse_rule({**good, **change})
    with pytest.raises(ValueError, match="Invalid JSON"):
        rules.parse_rules("{not json")
    with pytest.raises(ValueError):
        rules.parse_rule(rule("range", ["age"], [("pass_rate", "~", 1)]))
    parsed = rules.parse_rules(json.dumps({"rules": [{**good, "severity": "WARNING", "rule_id": " r1 "}]}))
    assert (parsed[0].rule_id, parsed[0].severity, parsed[0].enabled) == ("r1", "warning", True)


def test_all_types(moorings):
    parents = moorings.sparkSession.createDataFrame([(101,), (102,), (103,)], "k int")
    parsed = rules.parse_rules(
        {
            "rules": [
                rule("null_check", ["name", "email"]),
                rule("datatype", expected_types={"age": "integer", "email": "integer"}),
                rule("range", ["age"], min_value=0, max_value=120),
                rule("pattern", ["email"], pattern=r"^[^@\s]+@[^@\s]+\.[a-z]+$"),
                rule("uniqueness", ["id"]),
                rule("custom", expression="salary > 0"),
            ]
        }
    )
    reference = rules.Rule(
        "reference", "reference", "referential_integrity",
        parameters={"reference_df": parents, "source_column": "id", "reference_column": "k"},
    )
    found = {r.rule_id: (r.status, r.failed_records) for r in rules.run_rules(moorings, [*parsed, reference]).collect()}
    assert found == {
        "null_check": ("failed", 3),
        "datatype": ("failed", 7),
        "range": ("failed", 3),
        "pattern": ("failed", 1),
        "uniqueness": ("failed", 1),
        "custom": ("failed", 3),
        "reference": ("failed", 6),
    }


def test_thresholds_decide(moorings):
    found = run(
        moorings,
        rule("range", ["age"], [("pass_rate", ">=", 90.0)], rule_id="strict", min_value=0),
        rule("null_check", ["id"], [("failed_records", "<=", 10), ("unknown", ">", 1)], rule_id="loose"),
    )
    assert found["strict"].status == "failed" and found["strict"].message.endswith("Threshold violations: 1")
    assert found["loose"].status == "failed" and "Threshold" not in found["loose"].message


def test_disabled_and_broken_rules(moorings):
    found = run(
        moorings,
        rule("range", ["age"], enabled=False, rule_id="off"),
        rule("null_check", ["absent"], rule_id="absent"),
        rule("referential_integrity", rule_id="no_parent"),
        rule("null_check", ["salary"], rule_id="fine"),
        include_disabled=True,
    )
    assert (found["off"].status, found["off"].message) == ("passed", "Rule off is disabled")
    assert found["absent"].status == "error" and found["no_parent"].status == "error"
    assert found["fine"].failed_records == 1


def test_rules_that_cannot_be_planned_leave_the_others(moorings):
    found = run(
        moorings,
        rule("custom", expression="nowhere > 3", rule_id="column"),
        rule("custom", expression="age >", rule_id="sql"),
        rule("custom", expression="age", rule_id="number"),
        rule("pattern", ["name"], pattern="(open", rule_id="pattern"),
        rule("datatype", expected_types={"age": "no such type"}, rule_id="type"),
        rule("null_check", ["salary"], rule_id="fine"),
    )
    assert {k: found[k].status for k in ("column", "sql", "number", "pattern")} == dict.fromkeys(("column", "sql", "number", "pattern"), "error")
    assert "nowhere" in found["column"].errors[0] and found["fine"].failed_records == 1


def test_cell_rules_share_one_aggregation(moorings):
    parsed = rules.parse_rules(
        {"rules": [rule("range", ["age"], rule_id=f"r{i}", min_value=i) for i in range(20)]}
    )
    plan = rules.run_rules(moorings, parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_table_of_rules(spark):
    table = spark.createDataFrame(
        [("a", "range", True, ["x", "y"]), ("b", "pattern", False, ["y"]), ("c", "range", False, [])],
        "rule_id string, rule_type string, enabled boolean, tags array<string>",
    )
    (totals,) = rules.inventory(table).collect()
    assert tuple(totals) == (3, 1, 2)
    assert [r.tag for r in rules.distinct_tags(table).collect()] == ["x", "y"]
    assert [r.rule_id for r in rules.select_rules(table, tag="y", enabled=False).collect()] == ["b"]
