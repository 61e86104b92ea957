"""JSON specs of mappings, rule sets and workflows."""

import json
from dataclasses import dataclass, field, replace

from tallyframe.operators.mapping import ColumnMapping
from tallyframe.operators.rules import EVALUATED, EXPRESSION, Rule


@dataclass(frozen=True)
class Step:
    step_type: str
    parameters: dict = field(default_factory=dict)
    description: str = ""


def read_spec(spark, path):
    """The JSON document at ``path``, on any file system Spark can read."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def mappings_from(spec):
    """``[{"source", "destination"}]`` or the long names used inside workflow steps."""
    return [
        ColumnMapping(
            item["source_column"] if "source_column" in item else item["source"],
            item["destination_column"] if "destination_column" in item else item["destination"],
        )
        for item in spec
    ]


def rules_from(spec, dataframe_expressions=False):
    """``[{"rule_type", "column", "parameter", "description"}]``.

    With ``dataframe_expressions`` custom expressions are in the syntax of data frames, as in rule files saved by
    tools built on them; otherwise they are Spark SQL.
    """
    rules = [
        item
        if isinstance(item, Rule)
        else Rule(
            item["rule_type"], item.get("column"), item.get("parameter"), item.get("description", "")
        )
        for item in spec
    ]
    if not dataframe_expressions:
        return rules
    return [replace(rule, rule_type=EVALUATED) if rule.rule_type == EXPRESSION else rule for rule in rules]


def workflow_from(spec):
    """``(name, steps)`` of ``{"name", "steps": [{"step_type", "parameters", "description"}]}``."""
    steps = [
        Step(item["step_type"], item.get("parameters", {}), item.get("description", ""))
        for item in spec["steps"]
    ]
    return spec.get("name", "workflow"), steps


def mappings_to_json(mappings):
    return json.dumps([{"source": s, "destination": d} for s, d in mappings], indent=2)


def rules_to_json(rules):
    return json.dumps([vars(rule) for rule in rules], indent=2)


def workflow_to_json(name, steps):
    return json.dumps({"name": name, "steps": [vars(step) for step in steps]}, indent=2)
