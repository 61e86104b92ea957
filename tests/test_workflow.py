import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table
from tallyframe.plans import specs, workflow
from tallyframe.plans.specs import Step


def steps(*items):
    return [Step(kind, parameters) for kind, parameters in items]


BY_HIVE = ("remove_duplicates", {"columns": ["hive", "frame"]})

# Honey by hive and frame, with repeats and nulls.
HARVEST = [(h, f, w) for h in (1, 2, None) for f in ("a", "b") for w in (4.0, None, 6.5)]


def test_chain(frame, rows):
    df = frame("hive long, frame string, kilos double", *HARVEST)
    renamed = [{"source_column": "frame", "destination_column": "Rack"}, {"source_column": "kilos", "destination_column": "kg"}]
    result, log = workflow.run_workflow(
        df, steps(BY_HIVE, ("column_map", {"mappings": renamed})), "row_id"
    )
    assert result.columns == ["Rack", "kg"]
    assert rows(result) == [("a", 4.0)] * 3 + [("b", 4.0)] * 3
    assert [(r.success, r.detail) for r in log.orderBy("step_no").collect()] == [
        (True, "Removed 12 row(s)"), (True, "Result has 2 column(s)"),
    ]


def test_order_survives_a_column_map(frame, rows):
    df = frame("k string, v long", ("a", 1), ("a", 2))
    chain = steps(
        ("column_map", {"mappings": [{"source": "k", "destination": "key"}, {"source": "v", "destination": "w"}]}),
        ("remove_duplicates", {"columns": ["key"], "keep": "last"}),
    )
    result, _ = workflow.run_workflow(df, chain, "row_id")
    assert rows(result) == [("a", 2)]


def test_validate_step_reports_and_keeps_rows(frame):
    df = frame("hive long, frame string, kilos double", *HARVEST)
    checks = [{"rule_type": "required", "column": "hive"}, {"rule_type": "required", "column": "kilos"}]
    result, log = workflow.run_workflow(df, steps(("validate", {"rules": checks})), "row_id")
    assert result.count() == len(HARVEST)
    entry = log.first()
    assert (entry.success, entry.detail) == (False, "12 issue(s) found")
    assert entry.description == "Validate against 2 rule(s)"


@pytest.mark.parametrize(
    "bad",
    [
        ("remove_duplicates", {"columns": ["queen"]}),
        ("remove_duplicates", {}),
        ("remove_duplicates", {"columns": ["hive"], "keep": "middle"}),
        ("validate", {"rules": [{"rule_type": "tasty", "column": "hive"}]}),
        ("column_map", {"mappings": []}),
    ],
)
def test_a_failing_step_stops_the_chain(frame, bad):
    df = frame("hive long", (1,), (1,), (2,))
    result, log = workflow.run_workflow(
        df, steps(bad, ("remove_duplicates", {"columns": ["hive"]})), "row_id"
    )
    entries = log.collect()
    assert len(entries) == 1 and entries[0].success is False and entries[0].detail
    assert result.count() == 3


def test_empty_and_unknown_steps_raise(frame):
    df = frame("hive long", (1,))
    for chain in ([], steps(("swarm", {}))):
        with pytest.raises(ValueError):
            workflow.run_workflow(df, chain, "row_id")
        with pytest.raises(ValueError):
            workflow.run_workflow_batch([("a", df)], chain, "row_id")


def test_batch_isolates_sources(frame, spark, rows):
    schema = "hive long, frame string"
    north = [(h, f) for h, f, _ in HARVEST]
    sources = [
        ("north", frame(schema, *north)),
        ("wax", frame("colour string", ("gold",), ("gold",))),
        ("south", frame(schema, (1, "a"), (4, None), (4, None))),
        ("fallow", frame(schema, (1, "a")).where("false")),
        ("unordered", local_table(spark, [(1,), (2,)], "drones long")),
    ]
    results, report = workflow.run_workflow_batch(sources, steps(BY_HIVE), "row_id", source="src")
    assert rows(report.drop("detail")) == [
        ("fallow", 0, 0, "OK"),
        ("north", 18, 6, "OK"),
        ("south", 3, 2, "OK"),
        ("unordered", 2, 2, "ERROR"),
        ("wax", 2, 2, "FAILED_STEP"),
    ]
    detail = {r.source: r.detail for r in report.collect()}
    assert detail["north"] == "remove_duplicates: Removed 12 row(s)"
    assert detail["fallow"] == "remove_duplicates: Removed 0 row(s)"
    assert "not found" in detail["wax"]
    hives = next(df for df in results if "hive" in df.columns)
    assert rows(hives.where("src = 'south'"), "hive", "frame") == [(1, "a"), (4, None)]
    assert rows(hives.where("src = 'north'"), "hive", "frame") == sorted(
        set(north), key=lambda r: (r[0] is not None, r[0] or 0, r[1])
    )


def test_a_source_is_computed_with_its_own_types(frame, rows):
    chain = steps(
        ("remove_duplicates", {"columns": ["k"], "keep": "highest", "rank_by": "amount"}),
        ("validate", {"rules": [{"rule_type": "custom_expression", "parameter": "amount > 9.5"}]}),
    )
    numbers = frame("k long, amount double", (1, 9.0), (1, 10.0))
    texts = frame("k long, amount string", (1, "9"), (1, "ten"))
    alone, _ = workflow.run_workflow(numbers, chain, "row_id")
    (both,), report = workflow.run_workflow_batch([("n", numbers), ("t", texts)], chain, "row_id", source="src")
    assert rows(alone, "amount") == [(10.0,)]
    assert rows(both, "src", "amount") == [("n", "10.0"), ("t", "ten")]
    details = {r.source: r.detail for r in report.collect()}
    assert details["n"].endswith("0 issue(s) found") and details["t"].endswith("1 issue(s) found")


def test_batch_equals_one_run_per_source(frame, rows):
    tables = {
        "a": frame("k long, v long", (1, 5), (1, 7), (2, 1)),
        "b": frame("k long, v long", (1, 1), (3, 2), (3, 2)),
    }
    chain = steps(
        ("remove_duplicates", {"columns": ["k"], "keep": "highest"}),
        ("validate", {"rules": [{"rule_type": "unique", "column": "v"}]}),
    )
    (result,), report = workflow.run_workflow_batch(list(tables.items()), chain, "row_id", source="src")
    for name, df in tables.items():
        alone, log = workflow.run_workflow(df, chain, "row_id")
        assert rows(result.where(F.col("src") == name), "k", "v") == rows(alone, "k", "v")
        lines = [f"{r.step_type}: {r.detail}" for r in log.orderBy("step_no").collect()]
        assert report.where(F.col("source") == name).first().detail == "; ".join(lines)


def test_checkpointed_run_gives_the_same(frame, rows):
    df = frame("k long, v long", (1, 5), (1, 7), (2, 7))
    chain = steps(
        ("remove_duplicates", {"columns": ["k"], "keep": "last"}),
        ("remove_duplicates", {"columns": ["v"]}),
    )
    lazy, lazy_log = workflow.run_workflow(df, chain, "row_id")
    kept, kept_log = workflow.run_workflow(df, chain, "row_id", checkpoint=True)
    assert rows(lazy) == rows(kept) == [(1, 1, 7)]
    assert rows(lazy_log) == rows(kept_log)


def test_own_step(frame):
    def half(df, parameters, order_by, scope):
        return workflow.StepOutcome(df.where("hive > 1"), "Keep large", "kept", figure=0)

    workflow.register_step("large", half)
    df = frame("hive long", (1,), (2,), (3,)).withColumn("src", F.lit("s"))
    _, report = workflow.run_tagged(df, steps(("large", {})), "row_id", "src")
    assert tuple(report.first())[:3] == ("s", 3, 2)
    del workflow.STEPS["large"]


SPEC = {
    "name": "Harvest",
    "steps": [
        {
            "step_type": "remove_duplicates",
            "parameters": {"columns": ["hive", "rack no"], "keep": "last"},
            "description": "One entry per rack",
        },
        {
            "step_type": "validate",
            "parameters": {"rules": [{"rule_type": "no_negative", "column": "net kilos"}]},
            "description": "",
        },
    ],
}


def test_workflow_spec_files(spark, tmp_path):
    path = tmp_path / "flow.json"
    path.write_text(json.dumps(SPEC, indent=2))
    name, loaded = specs.workflow_from(specs.read_spec(spark, str(path)))
    assert name == "Harvest" and json.loads(specs.workflow_to_json(name, loaded)) == SPEC
    assert json.loads(specs.mappings_to_json([("a", "b")])) == [{"source": "a", "destination": "b"}]


def test_a_recorded_workflow(spark, frame):
    racks = [(i % 9, i // 9, float(i % 5) - (i % 14 == 0)) for i in range(126)]
    df = frame("hive long, `rack no` long, `net kilos` double", *racks, *racks[20:55])
    _, loaded = specs.workflow_from(SPEC)
    result, log = workflow.run_workflow(df, loaded, "row_id")
    assert result.count() == 126
    below = sum(kilos < 0 for _, _, kilos in racks)
    assert [r.detail for r in log.orderBy("step_no").collect()] == ["Removed 35 row(s)", f"{below} issue(s) found"]


CHAINS = {
    "carried": [BY_HIVE, ("validate", {"rules": [{"rule_type": "required", "column": "kilos"}, {"rule_type": "required", "column": "hive"}]}),
                ("remove_duplicates", {"columns": ["hive"], "keep": "last"})],
    "highest": [("remove_duplicates", {"columns": ["frame"], "keep": "highest"}), ("remove_duplicates", {"columns": ["hive"]})],
    "text rank": [("remove_duplicates", {"columns": ["hive"], "keep": "highest", "rank_by": "frame"}), ("validate", {"rules": [{"rule_type": "no_negative", "column": "kilos"}]})],
    "unique": [BY_HIVE, ("validate", {"rules": [{"rule_type": "unique", "column": "hive"}, {"rule_type": "required", "column": "kilos"}]}),
               ("remove_duplicates", {"columns": ["hive"]})],
    "mapped": [("column_map", {"mappings": [{"source": "hive", "destination": "kilos"}, {"source": "kilos", "destination": "hive"}]}),
               ("remove_duplicates", {"columns": ["kilos"], "keep": "last"}), ("validate", {"rules": [{"rule_type": "required", "column": "hive"}]})],
    "failing": [BY_HIVE, ("validate", {"rules": [{"rule_type": "required", "column": "queen"}]}), BY_HIVE],
    "failing first": [("remove_duplicates", {"columns": ["queen"]})],
}


@pytest.mark.parametrize("name", CHAINS)
def test_one_pass_gives_the_same(frame, rows, name):
    df = frame("hive long, frame string, kilos double, apiary string", *[(*r, "abc"[i % 2]) for i, r in enumerate(HARVEST * 2)])
    chain = steps(*CHAINS[name])
    for one, lazy in zip(workflow.run_workflow(df, chain, "row_id", one_pass=True), workflow.run_workflow(df, chain, "row_id")):
        assert one.dtypes == lazy.dtypes and rows(one) == rows(lazy)
    args = df, chain, "row_id", "apiary", ["a", "b", "none"]
    for one, lazy in zip(workflow.run_tagged(*args, one_pass=True), workflow.run_tagged(*args)):
        assert one.dtypes == lazy.dtypes and rows(one) == rows(lazy)


def test_one_pass_of_an_empty_table_and_own_steps(frame, rows):
    df = frame("hive long, frame string, kilos double")
    result, log = workflow.run_workflow(df, steps(*CHAINS["unique"]), "row_id", one_pass=True)
    assert result.isEmpty() and [r.detail for r in log.orderBy("step_no").collect()] == [
        "Removed 0 row(s)", "0 issue(s) found", "Removed 0 row(s)",
    ]

    def heavy(df, parameters, order_by, scope):
        kept = df.where(F.col("kilos") > 4)
        return workflow.StepOutcome(kept, "Keep heavy frames", "done", figure=0)

    workflow.register_step("heavy", heavy)
    try:
        df = frame("hive long, frame string, kilos double, apiary string", *[(*r, "ab"[r[0] == 2]) for r in HARVEST])
        chain = steps(BY_HIVE, ("heavy", {}), BY_HIVE)
        for one, lazy in zip(
            workflow.run_tagged(df, chain, "row_id", "apiary", one_pass=True), workflow.run_tagged(df, chain, "row_id", "apiary")
        ):
            assert rows(one) == rows(lazy)
    finally:
        del workflow.STEPS["heavy"]


def test_one_pass_reads_the_source_once(spark, frame, monkeypatch):
    """All jobs together scan the source once; the shuffle gets a row per key and task."""
    from tallyframe.sources import files

    written = []
    monkeypatch.setattr(workflow, "write_once", lambda df, purpose: written.append(df) or files.write_once(df, purpose))
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    chain = steps(
        ("remove_duplicates", {"columns": ["user_id", "event_type"], "keep": "highest", "rank_by": "value"}),
        ("validate", {"rules": [{"rule_type": "custom_expression", "parameter": "value >= 50"}]}),
    )
    result, report = workflow.run_tagged(source, chain, "event_id", "event_type", one_pass=True)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*written, result, report)]
    assert sum("events.parquet" in plan for plan in plans) == len(written) == 1
    assert plans[0].count("FileScan") == 1 and plans[0].count("partial_min_by") == 1
