from pyspark.sql import functions as F

from tallyframe.operators import mapping, rules, search
from tallyframe.plans.specs import mappings_from, rules_from
from tallyframe.sources.reports import validation_tables
from tallyframe_queries.inputs import CUSTOMER_NULLS, EVENTS_DIRTY, EVENTS_NULLS, table, view, with_views

PROPS = r'\{"k": [1-4]\d\}$'
PART_NAME = r"(?:small|large)\s"
ORDER_RULE = "o_totalprice > 100000 and o_orderstatus <> 'P'"

RULES = rules_from(
    [
        {"rule_type": "required", "column": "user_id"},
        {"rule_type": "regex", "column": "props", "parameter": PROPS},
        {"rule_type": "dtype_numeric", "column": "qty_text"},
        {"rule_type": "dtype_date", "column": "when_text"},
        {"rule_type": "no_negative", "column": "amount"},
        {"rule_type": "unique", "column": "user_id"},
        {"rule_type": "custom_expression", "parameter": "amount >= 1 and user_id < 100"},
    ]
)

# Failing condition and message of each rule above, in the checking SQL.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
CHECKS = [
    ("required", "user_id", "user_id IS NULL", "'''user_id'' is required but blank'"),
    (
        "regex", "props", f"NOT regexp_matches(props, '^{PROPS}')",
        "concat('''props'' value ''', props, ''' doesn''t match pattern ', "
        + "'" + repr(PROPS).replace("'", "''") + "')",
    ),
    (
        "dtype_numeric", "qty_text",
        f"qty_text IS NOT NULL AND NOT regexp_matches(qty_text, '{NUMBER}')",
        "concat('''qty_text'' value ''', qty_text, ''' is not numeric')",
    ),
    (
        "dtype_date", "when_text",
        "when_text IS NOT NULL AND (NOT regexp_matches(when_text, '^\\d{4}-\\d\\d-\\d\\d')"
        " OR try_cast(when_text AS TIMESTAMP) IS NULL)",
        "concat('''when_text'' value ''', when_text, ''' is not a valid date')",
    ),
    (
        "no_negative", "amount", "coalesce(amount < 0, false)",
        "concat('''amount'' value ', CAST(amount AS VARCHAR), ' is negative')",
    ),
    (
        "unique", "user_id", "user_id IS NOT NULL AND count(*) OVER (PARTITION BY user_id) > 1",
        "concat('Duplicate value in ''user_id'': ', CAST(user_id AS VARCHAR))",
    ),
    (
        "custom_expression", "(row)", "NOT coalesce(amount >= 1 AND user_id < 100, false)",
        "'Row fails rule: amount >= 1 and user_id < 100'",
    ),
]


def checked(numbers):
    """SQL for the failing rows of some of the rules, one SELECT per rule."""
    parts = []
    for n in numbers:
        kind, column, failing, message = CHECKS[n]
        parts.append(
            f"SELECT event_id AS row_id, {n} AS rule_no, '{column}' AS column, '{kind}' AS rule_type,"
            f" message FROM (SELECT event_id, {failing} AS failing, {message} AS message FROM e)"
            " WHERE failing"
        )
    return with_views(" UNION ALL ".join(parts), e=EVENTS_DIRTY)


def issues(*numbers):
    def run(spark, folder):
        chosen = [RULES[n] for n in numbers]
        found = rules.validate(view(spark, folder, EVENTS_DIRTY), chosen, "event_id")
        number = F.element_at(F.array(*map(F.lit, numbers)), F.col("rule_no") + 1)
        return found.withColumn("rule_no", number)

    return run, checked(numbers)


EVERY = tuple(range(len(RULES)))
FAILED = ", ".join(f"CAST({c[2]} AS INT) AS f{n}" for n, c in enumerate(CHECKS))
FAILED_COUNT = " + ".join(f"f{n}" for n in EVERY)


def documents_unique(spark, folder):
    return rules.validate(
        table(spark, folder, "documents"), [rules.Rule("unique", "text")], "doc_id"
    ).select("row_id", "column", "rule_type", "message")


def part_names(spark, folder):
    return rules.validate(
        table(spark, folder, "part"), [rules.Rule("regex", "p_name", PART_NAME)], "p_partkey"
    ).select("row_id", "message")


def orders_expression(spark, folder):
    rule = rules.Rule("custom_expression", None, ORDER_RULE)
    found = rules.validate(table(spark, folder, "orders"), [rule], "o_orderkey")
    return found.select("row_id", "column", "message")


def summary(spark, folder):
    return rules.validation_summary(view(spark, folder, EVENTS_DIRTY), RULES)


def report(spark, folder):
    return rules.validation_report(view(spark, folder, EVENTS_DIRTY), RULES)


def report_issues(spark, folder):
    return validation_tables(view(spark, folder, EVENTS_DIRTY), RULES[:5], "event_id")["issues"]


def quarantine(spark, folder):
    _, bad = rules.split_rows(view(spark, folder, EVENTS_DIRTY), RULES[:4])
    return bad.select("event_id", F.size("issues").cast("bigint").alias("issues"))


def passed(spark, folder):
    good, _ = rules.split_rows(view(spark, folder, EVENTS_DIRTY), RULES[:4])
    return good


PART_MAPPINGS = mappings_from(
    [
        {"source": "p_name", "destination": "Part Name"},
        {"source": "p_partkey", "destination": "Key"},
        {"source": "p_retailprice", "destination": "Price"},
    ]
)


def map_columns(keep):
    return lambda spark, folder: mapping.map_columns(table(spark, folder, "part"), PART_MAPPINGS, keep)


def auto_map(spark, folder):
    parts = table(spark, folder, "part")
    wanted = ["p_size", "p_brand", "P_NAME", "p_partkey", "supplier"]
    return mapping.map_columns(parts, mapping.map_identical_names(parts.columns, wanted))


SHOWN_77 = " OR ".join(
    f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '77')"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)


def search_customers(spark, folder):
    return search.search_rows(view(spark, folder, CUSTOMER_NULLS), "77")


def search_documents(spark, folder):
    found = search.search_rows(table(spark, folder, "documents"), "ON THE")
    return found.select("doc_id", "lang", "n_chars")


def search_counts(spark, folder):
    return search.search_counts(view(spark, folder, CUSTOMER_NULLS), "77")


def sort_top(spark, folder):
    customers = view(spark, folder, CUSTOMER_NULLS)
    return search.sort_rows(customers, "c_acctbal", False, ["c_custkey"], limit=100)


def sort_blanks_first(spark, folder):
    customers = view(spark, folder, CUSTOMER_NULLS)
    return search.sort_rows(customers, "c_nationkey", True, ["c_custkey"], limit=100)


def blanks(spark, folder):
    return search.mark_blanks(
        view(spark, folder, CUSTOMER_NULLS), ["c_acctbal", "c_mktsegment"]
    ).select("c_custkey", "c_acctbal_is_blank", "c_mktsegment_is_blank")


BAD_ROWS = f"FROM (SELECT *, {FAILED} FROM e) WHERE f0 + f1 + f2 + f3"

# Conditions in the syntax of data frames, and what rows fail them in SQL, where a null comparison is false but
# for "not equal".
EVALUATED = [
    ("10 < value <= 80 & user_id != 3", "NOT (value > 10 AND value <= 80 AND user_id IS DISTINCT FROM 3)"),
    (
        "event_type in ['click', 'view'] or ~(value > 50)",
        "NOT (coalesce(event_type IN ('click', 'view'), false) OR NOT value > 50)",
    ),
    (
        "event_type == 'click' | user_id >= 20 and not value < 5",
        "NOT (coalesce(event_type = 'click', false) OR (coalesce(user_id >= 20, false) AND NOT value < 5))",
    ),
    (
        "value / (user_id - 5) > 1",
        "NOT coalesce(CASE WHEN user_id = 5 THEN value > 0 ELSE value / (user_id - 5) > 1 END, false)",
    ),
    ("`value` // 7 % 3 == 1 and event_type not in ('view',)", "NOT (floor(value / 7) % 3 = 1 AND event_type IS DISTINCT FROM 'view')"),
]


def evaluated(spark, folder):
    spec = [{"rule_type": "custom_expression", "parameter": text} for text, _ in EVALUATED]
    checks = rules_from(spec, dataframe_expressions=True)
    return rules.validate(view(spark, folder, EVENTS_NULLS), checks, "event_id").select("row_id", "rule_no", "message")


# Days before months, but for every fifth order; some days could be either. Another column has dots, mostly.
DAY, MONTH = "lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')", "lpad(CAST(1 + o_custkey % 12 AS STRING), 2, '0')"
MIXED_DATES = (
    "orders",
    [
        "o_orderkey",
        f"CASE WHEN o_orderkey % 5 = 0 THEN concat({MONTH}, '/', {DAY}, '/2024') ELSE concat({DAY}, '/', {MONTH}, '/2024') END AS slashed",
        f"CASE WHEN o_orderkey % 7 < 3 THEN concat('2024-', {MONTH}, '-', {DAY}) WHEN o_orderkey % 7 < 6"
        f" THEN concat({DAY}, '.', {MONTH}, '.2024') WHEN o_custkey % 2 = 0 THEN concat({DAY}, '.', {MONTH}, '.2024') END AS dotted",
    ],
)


def voted_dates(spark, folder):
    checks = [rules.Rule("dtype_date", "slashed", "vote"), rules.Rule("dtype_date", "dotted", "vote:yyyy-MM-dd|dd.MM.yyyy")]
    return rules.validate(view(spark, folder, MIXED_DATES), checks, "o_orderkey").select("row_id", "column", "message")


QUERIES = {
    "validate_pandas_expression": (
        evaluated,
        with_views(
            " UNION ALL ".join(
                "SELECT event_id AS row_id, {} AS rule_no, 'Row fails rule: {}' AS message FROM e WHERE {}".format(
                    n, text.replace("'", "''"), failing
                )
                for n, (text, failing) in enumerate(EVALUATED)
            ),
            e=EVENTS_NULLS,
        ),
    ),
    "validate_date_voted": (
        voted_dates,
        with_views(
            "SELECT o_orderkey AS row_id, 'slashed' AS column, concat('''slashed'' value ''', slashed, ''' is not a valid"
            " date') AS message FROM d WHERE o_orderkey % 5 = 0 AND o_orderkey % 28 >= 12 UNION ALL"
            " SELECT o_orderkey, 'dotted', concat('''dotted'' value ''', dotted, ''' is not a valid date') FROM d"
            " WHERE dotted NOT LIKE '%.%'",
            d=MIXED_DATES,
        ),
    ),
    "validate_required": issues(0),
    "validate_regex": issues(1),
    "validate_numeric": issues(2),
    "validate_date": issues(3),
    "validate_no_negative": issues(4),
    "validate_unique": issues(5),
    "validate_expression": issues(6),
    "validate_all": issues(*EVERY),
    "validate_unique_text": (
        documents_unique,
        "SELECT doc_id AS row_id, 'text' AS column, 'unique' AS rule_type,"
        " concat('Duplicate value in ''text'': ''', text, '''') AS message FROM documents"
        " QUALIFY count(*) OVER (PARTITION BY text) > 1",
    ),
    "validate_regex_part": (
        part_names,
        "SELECT p_partkey AS row_id, concat('''p_name'' value ''', p_name,"
        " ''' doesn''t match pattern ''(?:small|large)\\\\s''') AS message FROM part"
        " WHERE NOT regexp_matches(p_name, '^(small|large)\\s')",
    ),
    "validate_expression_orders": (
        orders_expression,
        "SELECT o_orderkey AS row_id, '(row)' AS column,"
        " 'Row fails rule: o_totalprice > 100000 and o_orderstatus <> ''P''' AS message"
        f" FROM orders WHERE NOT ({ORDER_RULE})",
    ),
    "validate_summary": (
        summary,
        with_views(
            f", f AS (SELECT {FAILED} FROM e) "
            + " UNION ALL ".join(
                f"SELECT {n} AS rule_no, '{c[0]}' AS rule_type, '{c[1]}' AS column,"
                f" count(*) AS total_rows, CAST(sum(f{n}) AS BIGINT) AS issues FROM f"
                for n, c in enumerate(CHECKS)
            ),
            e=EVENTS_DIRTY,
        ),
    ),
    "validate_report": (
        report,
        with_views(
            "SELECT count(*) AS total_rows, CAST(7 AS BIGINT) AS rules_checked,"
            f" CAST(sum({FAILED_COUNT}) AS BIGINT) AS issues_found FROM (SELECT {FAILED} FROM e)",
            e=EVENTS_DIRTY,
        ),
    ),
    "validate_report_issues": (
        report_issues,
        "SELECT row_id + 1 AS \"Row\", \"column\" AS \"Column\", rule_type AS \"Rule\","
        f" message AS \"Message\" FROM ({checked(range(5))})",
    ),
    "validate_quarantine": (
        quarantine,
        with_views(
            f"SELECT event_id, CAST(f0 + f1 + f2 + f3 AS BIGINT) AS issues {BAD_ROWS} > 0",
            e=EVENTS_DIRTY,
        ),
    ),
    "validate_passed": (
        passed,
        with_views(
            f"SELECT event_id, user_id, event_type, qty_text, when_text, amount, props {BAD_ROWS} = 0",
            e=EVENTS_DIRTY,
        ),
    ),
    "map_columns": (
        map_columns(False),
        'SELECT p_name AS "Part Name", p_partkey AS "Key", p_retailprice AS "Price" FROM part',
    ),
    "map_columns_keep": (
        map_columns(True),
        'SELECT p_name AS "Part Name", p_partkey AS "Key", p_retailprice AS "Price",'
        " p_brand, p_type, p_size FROM part",
    ),
    "auto_map": (auto_map, "SELECT p_partkey, p_brand, p_size FROM part"),
    "search_any_column": (
        search_customers, with_views(f"SELECT * FROM c WHERE {SHOWN_77}", c=CUSTOMER_NULLS),
    ),
    "search_documents": (
        search_documents,
        "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'on the')"
        " OR contains(lower(lang), 'on the') OR contains(lower(source), 'on the')",
    ),
    "search_counts": (
        search_counts,
        with_views(
            f"SELECT count(*) FILTER ({SHOWN_77}) AS shown_rows, count(*) AS total_rows FROM c",
            c=CUSTOMER_NULLS,
        ),
    ),
    "sort_top_n": (
        sort_top,
        with_views(
            "SELECT * FROM c ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100",
            c=CUSTOMER_NULLS,
        ),
    ),
    "sort_blanks_first": (
        sort_blanks_first,
        with_views(
            "SELECT * FROM c ORDER BY c_nationkey ASC NULLS FIRST, c_custkey LIMIT 100",
            c=CUSTOMER_NULLS,
        ),
    ),
    "mark_blanks": (
        blanks,
        with_views(
            "SELECT c_custkey, c_acctbal IS NULL AS c_acctbal_is_blank,"
            " c_mktsegment IS NULL AS c_mktsegment_is_blank FROM c",
            c=CUSTOMER_NULLS,
        ),
    ),
}
