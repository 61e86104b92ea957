"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` how often each query is timed after one warm-up run. The value is
the sum of the medians. Results go to Spark's no-op sink, so every row is computed.

As in the baseline, loading is timed on its own and the operations start from
loaded tables (spread over the cores and cached). ``BENCH_CACHE=0`` makes them
start from the parquet files, each of which one core has to decode.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tallyframe.operators import combine, compare, dedupe, profile, rules
from tallyframe.operators.lookup import lookup_and_copy
from tallyframe.plans.specs import workflow_from
from tallyframe.plans.workflow import run_tagged
from tallyframe.session import build_session, shared_folder
from tallyframe.sources.delimited import read_delimited
from tallyframe.sources.files import POSITION_COLUMNS
from tallyframe.sources.parquet import read_parquet
from tallyframe.sources.reports import write_table

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CACHE = os.environ.get("BENCH_CACHE", "1") == "1"

KEYS = ["l_orderkey", "l_linenumber"]
CSV_COLUMNS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"]
THREE_RULES = [
    rules.Rule("required", "l_orderkey"),
    rules.Rule("dtype_numeric", "l_returnflag"),
    rules.Rule("no_negative", "l_extendedprice"),
]
_, STEPS = workflow_from(
    {
        "steps": [
            {"step_type": "remove_duplicates", "parameters": {"columns": KEYS, "keep": "first"}},
            {"step_type": "validate", "parameters": {"rules": [{"rule_type": "required", "column": "l_partkey"}]}},
        ]
    }
)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def loaded(df):
    if not CACHE:
        return df
    df = df.repartition(int(CPUS)).cache()
    df.count()
    return df


def headline(spark):
    lines = loaded(read_parquet(spark, f"{FOLDER}/lineitem.parquet", positions=True))
    orders = loaded(spark.read.parquet(f"{FOLDER}/orders.parquet"))
    part = loaded(spark.read.parquet(f"{FOLDER}/part.parquet"))
    raised = lines.withColumn("l_extendedprice", F.col("l_extendedprice") + 1)
    later = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    csv = shared_folder(spark, "bench") + ".csv"
    write_table(lines.select(*CSV_COLUMNS), csv, "csv")

    def load_and_profile():
        loaded = read_delimited(spark, csv)
        run(profile.profile_columns(loaded, CSV_COLUMNS))

    return {
        "load_csv_and_profile": load_and_profile,
        "profile": lambda: run(profile.profile_columns(lines, CSV_COLUMNS, per_column=True)),
        "duplicate_mask": lambda: run(dedupe.mark_duplicates_once(lines, KEYS, POSITION_COLUMNS)),
        "duplicate_mask_narrow": lambda: run(
            dedupe.mark_duplicates_once(lines.select(*KEYS, *POSITION_COLUMNS), KEYS, POSITION_COLUMNS)
        ),
        "duplicate_report": lambda: run(dedupe.duplicate_report(lines, KEYS)),
        "remove_duplicates": lambda: run(dedupe.drop_duplicates(lines, KEYS, POSITION_COLUMNS)),
        "remove_duplicates_highest": lambda: run(
            dedupe.drop_duplicates(lines, KEYS, POSITION_COLUMNS, "highest", "l_extendedprice")
        ),
        "validate_three_rules": lambda: run(rules.validation_summary(lines, THREE_RULES)),
        "validate_unique": lambda: run(rules.validate(lines, [rules.Rule("unique", "l_partkey")], POSITION_COLUMNS)),
        "compare_all_modified": lambda: run(compare.compare_tables(lines, raised, KEYS)),
        "compare_orders_summary": lambda: run(compare.compare_counts(orders, later, ["o_orderkey"])),
        "compare_missing": lambda: run(
            compare.rows_missing(
                orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]
            )
        ),
        "lookup": lambda: run(
            lookup_and_copy(
                lines.withColumnRenamed("l_partkey", "p_partkey"), part, "p_partkey",
                ["p_name", "p_brand"], "p_partkey",
            )
        ),
        "join_outer": lambda: run(
            combine.join_tables(orders.withColumnRenamed("o_orderkey", "l_orderkey"), lines, ["l_orderkey"], "outer")
        ),
        "union": lambda: run(combine.union_tables([lines, raised], ["a", "b"])),
        "workflow_by_source": lambda: [run(df) for df in run_tagged(lines, STEPS, POSITION_COLUMNS, "l_returnflag", one_pass=True)],
    }


def main():
    # One machine: a folder of its own is shared by driver and executors.
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__checkpoint__dir=shared.name,
    )
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name, query in headline(spark).items():
        query()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            query()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
                "cores": int(CPUS),
                "runs": RUNS,
                "loaded_tables": CACHE,
            }
        )
    )


if __name__ == "__main__":
    main()
