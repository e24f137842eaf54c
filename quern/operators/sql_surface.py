"""SQL over catalog tables and data files, with checks on Catalyst's own parse of the text.

The text is parsed by Spark, its tree is walked, and it runs in a session of its own that
has nothing but the permitted views: what isn't permitted can't be named.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SqlRejected(ValueError):
    """The statement isn't one permitted SELECT."""


def _sequence(seq: Any) -> Iterator[Any]:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(node: Any) -> Iterator[Any]:
    """Plan nodes, with those of subqueries and CTEs."""
    yield node
    for child in _sequence(node.children()):
        yield from _walk(child)
    for child in _sequence(node.subqueries()):
        yield from _walk(child)
    if node.nodeName() == "UnresolvedWith":
        for pair in _sequence(node.cteRelations()):
            yield from _walk(pair._2())


def _expressions(node: Any) -> Iterator[Any]:
    for e in _sequence(node.expressions()):
        yield from _below(e)


def _below(e: Any) -> Iterator[Any]:
    yield e
    for child in _sequence(e.children()):
        yield from _below(child)


def parse(spark: SparkSession, sql: str) -> Any:
    """Catalyst's unresolved plan of one statement."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise SqlRejected(f"can't be parsed: {str(error)[:200]}") from error


#: Nodes of a SELECT that reads views and nothing else: fixed values.
SELECT_NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation",
    "WithWindowDefinition", "Window", "GlobalLimitAndOffset", "LateralJoin", "Pivot", "Unpivot", "UnresolvedOrdinal", "Generate",
}
#: Functions that compute from their arguments alone; any other is refused. Fixed values.
FUNCTIONS = set(
    """
    abs acos add_months any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort
    ascii asin atan atan2 avg bit_and bit_count bit_or bit_xor bool_and bool_or bround btrim cardinality cbrt ceil ceiling char char_length character_length chr coalesce
    collect_list collect_set concat concat_ws contains conv corr cos count count_if covar_pop covar_samp cube cume_dist date date_add date_diff date_format date_from_unix_date
    date_part date_sub date_trunc dateadd datediff day dayname dayofmonth dayofweek dayofyear decode degrees dense_rank div double element_at elt encode endswith equal_null every
    exp explode extract factorial filter find_in_set first first_value flatten float floor format_number format_string from_json from_unixtime get_json_object greatest grouping
    grouping_id hash hex hour if ifnull ilike in initcap instr int isnan isnotnull isnull json_array_length kurtosis lag last last_day last_value lcase lead least left len length
    levenshtein like ln locate log log10 log1p log2 lower lpad ltrim make_date make_timestamp map map_keys map_values max max_by md5 mean median min min_by minute mod mode month
    monthname months_between named_struct next_day not nth_value ntile nullif nvl nvl2 octet_length percent_rank percentile percentile_approx pmod posexplode position pow power
    quarter radians rank regexp regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right rlike rollup round row_number
    rpad rtrim second sequence sha sha1 sha2 sign signum sin size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct
    substr substring substring_index sum tan timestamp timestampadd timestampdiff to_char to_date to_json to_number to_timestamp transform translate trim trunc try_add try_cast
    try_divide try_element_at ucase unix_timestamp unnest upper var_pop var_samp variance weekday weekofyear width_bucket window year
    """.split()
)


def tables_of(spark: SparkSession, sql: str) -> set[str]:
    """Lower-cased names of the tables that the statement reads, without its own CTEs."""
    plan, names, own = parse(spark, sql), set(), set()
    for node in _walk(plan):
        if node.nodeName() == "UnresolvedRelation":
            names.add(".".join(_sequence(node.multipartIdentifier())).lower())
        if node.nodeName() == "UnresolvedWith":
            own |= {pair._1().lower() for pair in _sequence(node.cteRelations())}
    return names - own


def statement(spark: SparkSession, sql: str) -> dict:
    """What a statement says, from Catalyst's own parse: is_select, tables, columns (of its outermost
    SELECT, as text), where_columns, where (as text, null without any)."""
    plan = parse(spark, sql)
    nodes = list(_walk(plan))
    select = next((n for n in nodes if n.nodeName() in ("Project", "Aggregate")), None)
    shown = [] if select is None else [e.sql() for e in _sequence(select.projectList() if select.nodeName() == "Project" else select.aggregateExpressions())]
    wheres = [n.condition() for n in nodes if n.nodeName() == "Filter"]
    used = {".".join(_sequence(e.nameParts())) for c in wheres for e in _below(c) if e.nodeName() == "UnresolvedAttribute"}
    return {
        "is_select": all(n.nodeName() in SELECT_NODES for n in nodes), "tables": sorted(tables_of(spark, sql)), "columns": shown,
        "where_columns": sorted(used), "where": " AND ".join(f"({c.sql()})" for c in wheres) or None,
    }


def check(spark: SparkSession, sql: str, permitted: set[str], functions: Collection[str] = ()) -> None:
    """Raise SqlRejected unless the text is one SELECT over permitted tables and table `functions`, without
    functions that aren't known to be safe, and without conditions that always or never hold:
    in WHERE, HAVING and ON, those that compare constants, or a column with itself."""
    for node in _walk(parse(spark, sql)):
        name = node.nodeName()
        if name == "UnresolvedTableValuedFunction":
            called = ".".join(_sequence(node.name())).lower()
            if called not in functions:
                raise SqlRejected(f"table function {called} isn't permitted")
        elif name not in SELECT_NODES and not name.startswith("Resolved"):
            raise SqlRejected(f"{name} isn't permitted")
        for e in _expressions(node):
            if e.nodeName() == "UnresolvedFunction":
                parts = [x.lower() for x in _sequence(e.nameParts())]
                if len(parts) > 1 or parts[0] not in FUNCTIONS:
                    raise SqlRejected(f"function {'.'.join(parts)} isn't permitted")
        if name == "Filter":
            _check_condition(node.condition())
        if name == "UnresolvedHaving":
            _check_condition(node.havingCondition())
        if name == "Join" and node.condition().isDefined():
            _check_condition(node.condition().get())
    foreign = tables_of(spark, sql) - {t.lower() for t in permitted}
    if foreign:
        raise SqlRejected(f"no such table: {', '.join(sorted(foreign))}")


def _check_condition(condition: Any) -> None:
    if condition.nodeName() in ("And", "Or", "Not"):
        for part in _sequence(condition.children()):
            _check_condition(part)
    elif not any(e.nodeName() in ("UnresolvedAttribute", "UnresolvedStar") or "Subquery" in e.nodeName() or e.nodeName() == "Exists" for e in _below(condition)):
        raise SqlRejected("a condition compares constants only")
    else:
        parts = [e.toString() for e in _sequence(condition.children())]
        if len(parts) == 2 and parts[0] == parts[1]:
            raise SqlRejected("a condition compares a column with itself")


def run(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], most_rows: int | None = None, functions: Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a checked SELECT over `views`, with table `functions` by their names (lower case). The
    caller's filters (tenant, deleted rows, scope) belong in the views: no text can go round them."""
    functions = functions or {}
    check(spark, sql, set(views), functions)
    own, shared = spark.newSession(), []
    for name, function in functions.items():
        own.udtf.register(name, function)
    try:
        for name, view in views.items():
            shared.append(f"quern_{uuid.uuid4().hex}")  # the way from one session to another
            view.createOrReplaceGlobalTempView(shared[-1])
            own.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.`{shared[-1]}`")
        out = own.sql(sql)
    finally:
        for name in shared:
            spark.catalog.dropGlobalTempView(name)
    return out.limit(most_rows) if most_rows is not None else out


def secured(rows: DataFrame, tenant: int | None = None, tenant_col: str = "tenant_id", deleted_col: str | None = None, enabled_col: str | None = None) -> DataFrame:
    """The rows of one tenant that aren't deleted and not disabled (null means enabled)."""
    if tenant is not None:
        rows = rows.filter(F.col(tenant_col) == tenant)
    if deleted_col:
        rows = rows.filter(F.col(deleted_col).isNull())
    return rows.filter(F.coalesce(F.col(enabled_col), F.lit(True))) if enabled_col else rows


def describe(df: DataFrame) -> DataFrame:
    """column_name, data_type, position of a table."""
    rows = [(f.name, f.dataType.simpleString(), k) for k, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, position int")


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows as JSON objects, nulls included."""
    return df.orderBy(*order).limit(n).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
