"""Every operator as a query over the test tables, and the SQL that gives the same rows.

The tables are clean, so dirt is put in by expressions that mean the same in both engines.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import exprs as X
from tablewright.functions.values import FALSE_TOKENS, NULL_TOKENS, TRUE_TOKENS
from tablewright.model import RID
from tablewright.operators import actions as A
from tablewright.operators import checks as C
from tablewright.operators.checks import scan
from tablewright.operators.profile import Profile
from tablewright.plans.cleaner import Cleaner, replay
from tablewright.plans.planner import build_plan
from tablewright.sources.readers import flatten, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


ORDERS = (
    "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 11 = 0 THEN 'Unknown' ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 3 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 4 < 3 THEN NULL ELSE o_orderstatus END AS mostly_null",
    "'x' AS same",
    "o_custkey AS customer_id",
    "o_custkey AS customer_copy",
)
ORDERS_SQL = f"(SELECT {', '.join(ORDERS)} FROM orders)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*ORDERS)


def by_column(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_CHECK = {
    "miss": C.missing, "ws": C.white_space, "booltext": C.booleans_as_text, "numtext": C.numbers_as_text, "dttext": C.dates_as_text, "ambig": C.category_spellings, "dominant": C.rare_and_dominant,
    "hicard": C.high_cardinality, "const": C.constant_columns, "dupcol": C.duplicate_columns, "duprow": C.duplicate_rows, "dupkey": C.duplicate_rows, "neardup": C.duplicate_rows, "outlier": C.outliers,
    "neg": C.impossible_values, "age": C.impossible_values, "pct": C.impossible_values, "baddate": C.impossible_values, "colnames": C.column_names, "pii": C.personal_data, "sentinel": C.sentinels, "moji": C.mojibake,
    "rare": C.rare_and_dominant, "emptycol": C.empty_rows_and_columns, "emptyrow": C.empty_rows_and_columns,
}


def found(df: DataFrame, prefix: str):
    """What one check finds."""
    return [f for f in scan(df, [_CHECK[prefix]]) if f.id.startswith((prefix + "-", "failed-"))]


# -- profile and checks ------------------------------------------------------------------------------------------------

_COLUMNS = ("o_orderkey", "status", "price", "priority", "mostly_null", "same", "customer_id", "customer_copy")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls FROM {ORDERS_SQL}" for c in _COLUMNS))
def null_profile(spark, d):
    p = Profile(orders(spark, d))
    return by_column(spark, [(c, p.rows - p.stats[c]["filled"]) for c in p.fields], "name string, nulls long")


@query("SELECT name, CASE WHEN share >= 60 THEN 'high' WHEN share >= 5 THEN 'medium' ELSE 'low' END AS severity, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS n, 100.0 * (count(*) - count({c})) / count(*) AS share FROM {ORDERS_SQL}" for c in _COLUMNS) + ") WHERE n > 0")
def missing_severity(spark, d):
    return by_column(spark, [(f.columns[0], f.severity, f.evidence["count"]) for f in found(orders(spark, d), "miss")], "name string, severity string, n long")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS filled, count(DISTINCT {c}) AS different, max(n) AS top FROM {ORDERS_SQL} JOIN (SELECT {c} AS v, count(*) AS n FROM {ORDERS_SQL} GROUP BY 1) ON v = {c}" for c in ("status", "price", "priority", "customer_id")))
def column_profile(spark, d):
    p = Profile(orders(spark, d).select("status", "price", "priority", "customer_id"))
    out = by_column(spark, [(c, p.stats[c]["filled"], p.distinct[c]["distinct"], p.distinct[c]["top"]) for c in p.fields], "name string, filled long, different long, top long")
    p.close()
    return out


@query("SELECT CAST(sum(cnt) AS BIGINT) AS cnt, value, col FROM (SELECT 'l_returnflag' AS col, l_returnflag AS value, 1 AS cnt FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), 1 FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, 1 FROM lineitem) GROUP BY value, col")
def value_frequencies(spark, d):
    return Profile(table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus")).frequencies.select("col", "value", "cnt")


@query(f"SELECT lower(trim(status)) AS token, count(*) AS n FROM {ORDERS_SQL} WHERE lower(trim(status)) IN ({listed(NULL_TOKENS)}) GROUP BY 1")
def sentinel_scan(spark, d):
    p = Profile(orders(spark, d).select("status"))
    return p.values("status").filter(X.is_sentinel(F.col("value"))).groupBy(X.token(F.col("value")).alias("token")).agg(F.sum("cnt").alias("n"))


@query(f"SELECT o_orderkey, CASE WHEN lower(trim(status)) IN ({listed(NULL_TOKENS)}) THEN NULL ELSE status END AS status FROM {ORDERS_SQL}")
def sentinel_replace(spark, d):
    return A.replace_sentinels_with_na(orders(spark, d).select("o_orderkey", "status"), ["status"])[0]


@query("SELECT 'priority' AS name, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0")
def whitespace_scan(spark, d):
    f = found(orders(spark, d).select("o_orderkey", "priority"), "ws")
    return by_column(spark, [(c, n) for x in f for c, n in x.evidence["counts"].items()], "name string, n long")


@query("SELECT p_partkey, p_name FROM part")
def strip_whitespace(spark, d):
    dirty = table(spark, d, "part").selectExpr("p_partkey", "concat('  ', replace(p_name, ' ', ' \\t '), '\\u00a0') AS p_name")
    return A.strip_whitespace(dirty)[0]


for _mode, _sql in {"lower": "lower(p_brand)", "upper": "upper(p_brand)", "capitalize": "concat(upper(left(p_brand, 1)), lower(substr(p_brand, 2)))", "title": "concat(upper(left(p_brand, 1)), lower(substr(p_brand, 2)))"}.items():

    def _case(spark, d, mode=_mode):
        return A.normalize_case(table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "[^A-Za-z]", "").alias("p_brand")), ["p_brand"], mode)[0]

    _case.__name__ = f"case_{_mode}"
    query(f"SELECT p_partkey, {_sql} AS p_brand FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS p_brand FROM part)")(_case)

_FLAG = "CASE l_linenumber % 4 WHEN 0 THEN ' YES' WHEN 1 THEN 'n' WHEN 2 THEN 'On' ELSE 'maybe' END"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN v IN ({listed(TRUE_TOKENS)}) THEN true WHEN v IN ({listed(FALSE_TOKENS)}) THEN false END AS flag FROM (SELECT l_orderkey, l_linenumber, lower(trim({_FLAG})) AS v FROM lineitem)")
def cast_boolean(spark, d):
    return A.cast_boolean(table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_FLAG} AS flag"), ["flag"])[0]


@query("SELECT 'answer' AS name, count(DISTINCT CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END) AS different FROM labels")
def bool_scan(spark, d):
    f = found(table(spark, d, "labels").selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'Yes' ELSE ' no' END AS answer"), "booltext")
    return by_column(spark, [(x.columns[0], x.evidence["distinct"]) for x in f], "name string, different long")


_MONEY = "concat('$', CAST(o_custkey % 900 + 100 AS VARCHAR(20)), ',', CAST(o_orderkey % 900 + 100 AS VARCHAR(20)), '.50')"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE ((o_custkey % 900 + 100) * 1000 + o_orderkey % 900 + 100) * 1.0::DOUBLE + 0.5::DOUBLE END AS amount FROM orders")
def cast_numeric(spark, d):
    return A.cast_numeric(table(spark, d, "orders").selectExpr("o_orderkey", f"CASE WHEN o_orderkey % 13 = 0 THEN 'a lot' ELSE {_MONEY} END AS amount"), ["amount"])[0]


@query("SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) / 100.0::DOUBLE AS part FROM orders")
def cast_numeric_percent(spark, d):
    return A.cast_numeric(table(spark, d, "orders").selectExpr("o_orderkey", "concat(CAST(o_orderkey % 101 AS VARCHAR(20)), ' %') AS part"), ["part"])[0]


@query("SELECT 'amount' AS name, count(*) AS n FROM orders WHERE o_orderkey % 13 <> 0")
def numeric_text_scan(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", f"CASE WHEN o_orderkey % 13 = 0 THEN 'a lot' ELSE {_MONEY} END AS amount")
    n = Profile(df).stats["amount"]["numeric"]
    return by_column(spark, [(x.columns[0], n) for x in found(df, "numtext")], "name string, n long")


for _name, _fmt, _first in (("cast_datetime_mdy", "MM/dd/yyyy", False), ("cast_datetime_dmy", "dd/MM/yyyy", True)):

    def _dates(spark, d, fmt=_fmt, first=_first):
        return A.cast_datetime(table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", fmt).alias("day")), ["day"], dayfirst=first)[0]

    _dates.__name__ = _name
    query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders")(_dates)


@query("SELECT 'day' AS name, max(day(o_orderdate)) > 12 AS first_above, max(month(o_orderdate)) > 12 AS second_above, count(*) AS n FROM orders")
def date_order_inference(spark, d):
    s = Profile(table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))).stats["day"]
    return by_column(spark, [("day", s["first_big"] > 0, s["second_big"] > 0, s["triples"])], "name string, first_above boolean, second_above boolean, n long")


@query("SELECT 'day' AS name, true AS dayfirst, false AS ambiguous")
def date_text_scan(spark, d):
    f = found(table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")), "dttext")
    return by_column(spark, [(x.columns[0], x.evidence["inferred_dayfirst"], x.evidence["ambiguous"]) for x in f], "name string, dayfirst boolean, ambiguous boolean")


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS who FROM events")
def coerce_type(spark, d):
    return A.coerce_consistent_type(table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 50 = 0 THEN 'none' ELSE CAST(user_id AS STRING) END AS who"), ["who"])[0]


_SPELT = "CASE o_orderkey % 10 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '-', ' ') WHEN 2 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END"
_BEST = f"""SELECT v, first_value(v) OVER (PARTITION BY regexp_replace(lower(v), '[^a-z0-9]', '', 'g') ORDER BY CASE WHEN trim(regexp_replace(v, ' +', ' ', 'g')) = v THEN 0 ELSE 1 END, n DESC,
 CASE WHEN regexp_matches(v, '^[A-Z]') AND upper(v) <> v THEN 0 ELSE 1 END, length(v), v) AS best FROM (SELECT {_SPELT} AS v, count(*) AS n FROM orders GROUP BY 1)"""


@query(f"SELECT v AS value, best AS canonical FROM ({_BEST}) WHERE v <> best")
def category_collisions(spark, d):
    return Profile(table(spark, d, "orders").selectExpr(f"{_SPELT} AS priority")).canonical(["priority"]).select("value", "canonical")


@query(f"SELECT o_orderkey, best AS priority FROM (SELECT o_orderkey, {_SPELT} AS spelt FROM orders) JOIN ({_BEST}) ON v = spelt")
def unify_categories(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", f"{_SPELT} AS priority")
    (f,) = found(df, "ambig")
    return A.unify_categories(df, **f.suggested_params)[0]


@query("SELECT value, n FROM (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1) WHERE n < 0.02 * (SELECT count(*) FROM part)")
def rare_scan(spark, d):
    p = Profile(table(spark, d, "part").select(F.col("p_size").cast("string")))
    return p.values("p_size").filter(F.col("cnt") < 0.02 * p.rows).select("value", F.col("cnt").alias("n"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_size) < 0.02 * count(*) OVER () THEN 'Other' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def group_rare(spark, d):
    return A.group_rare_categories(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size")), "size", 0.02)[0]


@query("SELECT 'kind' AS name, 'a' AS top, count(*) - count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) AS n FROM orders")
def dominant_scan(spark, d):
    df = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN 'b' ELSE 'a' END AS kind")
    p = Profile(df)
    n = p.distinct["kind"]["top"]
    p.close()
    return by_column(spark, [(x.columns[0], x.evidence["top"], n) for x in found(df, "dominant")], "name string, top string, n long")


@query("SELECT 'c_name' AS name, count(DISTINCT c_name) AS different FROM customer")
def high_cardinality(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["distinct"]) for x in found(table(spark, d, "customer"), "hicard")], "name string, different long")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name FROM {ORDERS_SQL} HAVING count(DISTINCT {c}) = 1" for c in _COLUMNS))
def constant_columns(spark, d):
    return by_column(spark, [(c,) for x in found(orders(spark, d), "const") for c in x.columns], "name string")


@query(f"SELECT 'customer_copy' AS name FROM {ORDERS_SQL} HAVING bool_and(customer_id IS NOT DISTINCT FROM customer_copy)")
def duplicate_columns(spark, d):
    return by_column(spark, [(c,) for x in found(orders(spark, d), "dupcol") for c in x.columns if not x.id.startswith("dupcoln")], "name string")


@query("SELECT 'empty' AS name, count(*) AS empty_rows FROM orders WHERE o_orderkey % 17 = 0")
def empty_scan(spark, d):
    f = scan(table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status", "CAST(NULL AS STRING) AS empty"))
    names = [c for x in f if x.id.startswith("emptycol") for c in x.columns]
    n = next(x.evidence["count"] for x in f if x.id.startswith("emptyrow"))
    return by_column(spark, [(c, n) for c in names], "name string, empty_rows long")


_TWICE = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0)"


def twice(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return df.union(df.filter("o_orderkey % 10 = 0"))


@query(f"SELECT count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus)) AS n FROM {_TWICE}")
def dup_rows(spark, d):
    return by_column(spark, [(x.evidence["count"],) for x in found(twice(spark, d), "duprow")], "n long")


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    def _dedupe(spark, d, keep=_keep):
        return A.drop_duplicate_rows(table(spark, d, "documents").select("doc_id", "lang", "text"), ["text"], keep, order="doc_id")[0].select("doc_id", "lang")

    _dedupe.__name__ = f"drop_duplicates_{_keep}"
    query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id {_dir}) AS rn FROM documents) WHERE rn = 1")(_dedupe)


@query("SELECT 'user_id' AS name, count(*) - count(DISTINCT user_id) AS n FROM events")
def key_uniqueness(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["repeats"]) for x in found(table(spark, d, "events").select("event_id", "user_id", "value"), "dupkey")], "name string, n long")


_NEAR = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '', 'g')"
_LOUD = "(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, concat(upper(text), ' !') FROM documents WHERE doc_id % 9 = 0 AND lang = 'en')"


@query(f"SELECT count(*) - count(DISTINCT {_NEAR}) - (count(*) - count(DISTINCT text)) AS n FROM {_LOUD}")
def near_dup(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select("text").union(docs.filter("doc_id % 9 = 0 AND lang = 'en'").select(F.concat(X.upper_each(F.col("text")), F.lit(" !"))))
    return by_column(spark, [(x.evidence["count"],) for x in found(df, "neardup")] or [(0,)], "n long")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_NEAR} ORDER BY doc_id) AS rn FROM {_LOUD}) WHERE rn = 1")
def drop_near_dup(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select("doc_id", "text").union(docs.filter("doc_id % 9 = 0 AND lang = 'en'").select(F.col("doc_id") + 1000000, F.concat(X.upper_each(F.col("text")), F.lit(" !"))))
    return A.drop_near_duplicate_rows(df, ["text"], order="doc_id")[0].select("doc_id")


# -- outliers and ranges -----------------------------------------------------------------------------------------------

_FENCE = {
    "iqr": "SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)",
    "zscore": "SELECT avg(value) - 3 * stddev_pop(value) AS lo, avg(value) + 3 * stddev_pop(value) AS hi FROM events",
    "mad": "SELECT m - 3 * 1.4826::DOUBLE * (SELECT quantile_cont(abs(value - m), 0.5) FROM events) AS lo, m + 3 * 1.4826::DOUBLE * (SELECT quantile_cont(abs(value - m), 0.5) FROM events) AS hi FROM (SELECT quantile_cont(value, 0.5) AS m FROM events)",
}
_METHOD = {
    "flag": "SELECT event_id, value, coalesce(value < lo OR value > hi, false) AS value__is_outlier FROM events, f",
    "clip": "SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, f",
    "to_nan": "SELECT event_id, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM events, f",
    "remove": "SELECT event_id, value FROM events, f WHERE NOT (value < lo OR value > hi)",
}
for _detector, _fence in _FENCE.items():
    for _method, _sql in _METHOD.items():

        def _outliers(spark, d, detector=_detector, method=_method):
            out = A.handle_outliers(table(spark, d, "events").select("event_id", "value"), ["value"], method, 3.0, detector)[0]
            return out.withColumn("value", F.round("value", 6)) if method == "clip" else out

        _outliers.__name__ = f"outliers_{_detector}_{_method}"
        query(f"WITH f AS ({_fence}) {_sql}")(_outliers)


@query("WITH f AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, f")
def winsorize(spark, d):
    return A.handle_outliers(table(spark, d, "events").select("event_id", "value"), ["value"], "winsorize")[0].withColumn("value", F.round("value", 6))


@query("WITH f AS (" + _FENCE["iqr"] + ") SELECT 'value' AS name, count(*) AS n FROM events, f WHERE value < lo OR value > hi")
def outlier_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["count"]) for x in found(table(spark, d, "events").select("event_id", "value"), "outlier")], "name string, n long")


@query("SELECT 'balance' AS name, count(*) AS n FROM customer WHERE c_acctbal < 0")
def negative_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["count"]) for x in found(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")), "neg")], "name string, n long")


for _mode, _sql in {"clip": "SELECT c_custkey, least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) AS c_acctbal FROM customer", "to_nan": "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer", "drop_rows": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0 OR c_acctbal > 5000)"}.items():

    def _range(spark, d, mode=_mode):
        return A.enforce_range(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0, 5000, mode)[0]

    _range.__name__ = f"enforce_range_{_mode}"
    query(_sql)(_range)


@query("SELECT 'age' AS name, count(*) AS n FROM part WHERE p_size * 4 > 120")
def age_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["count"]) for x in found(table(spark, d, "part").selectExpr("p_partkey", "p_size * 4 AS age"), "age")], "name string, n long")


@query("SELECT 'discount_rate' AS name, max(p_size * 3.0::DOUBLE) AS most FROM part")
def percent_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["max"]) for x in found(table(spark, d, "part").selectExpr("p_partkey", "p_size * 3 AS discount_rate"), "pct")], "name string, most double")


_OLD = "CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate - INTERVAL 150 YEAR ELSE o_orderdate END"


@query("SELECT 'day' AS name, count(*) AS ancient FROM orders WHERE o_orderkey % 20 = 0")
def date_window_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["pre1900"]) for x in found(table(spark, d, "orders").selectExpr("o_orderkey", f"{_OLD} AS day"), "baddate")], "name string, ancient long")


for _mode, _sql in {"to_nan": f"SELECT o_orderkey, CASE WHEN day < TIMESTAMP '1900-01-01' OR day > TIMESTAMP '1997-01-01' THEN NULL ELSE day END AS day FROM (SELECT o_orderkey, {_OLD} AS day FROM orders)", "drop_rows": f"SELECT o_orderkey, day FROM (SELECT o_orderkey, {_OLD} AS day FROM orders) WHERE NOT (day < TIMESTAMP '1900-01-01' OR day > TIMESTAMP '1997-01-01')"}.items():

    def _window(spark, d, mode=_mode):
        return A.enforce_date_range(table(spark, d, "orders").selectExpr("o_orderkey", f"{_OLD} AS day"), "day", "1900-01-01", "1997-01-01", mode)[0]

    _window.__name__ = f"enforce_date_range_{_mode}"
    query(_sql)(_window)


# -- filling -----------------------------------------------------------------------------------------------------------

_GAPS = "(SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS value, CASE WHEN event_id % 6 = 2 THEN NULL ELSE event_type END AS event_type FROM events)"
_FILLS = {
    "mean": "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value, event_type FROM g",
    "median": "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)), 6) AS value, event_type FROM g",
    "constant": "SELECT event_id, round(coalesce(value, -1.0::DOUBLE), 6) AS value, event_type FROM g",
    "mode": "SELECT event_id, round(value, 6) AS value, coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g",
    "ffill": "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS value, event_type FROM g",
    "bfill": "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING), 6) AS value, event_type FROM g",
    "drop_rows": "SELECT event_id, round(value, 6) AS value, event_type FROM g WHERE value IS NOT NULL",
    "interpolate": """SELECT event_id, round(coalesce(value, p.is + (q.is - p.is) * (pos - p.at) / (q.at - p.at), p.is, q.is), 6) AS value, event_type FROM (SELECT *, last_value(pt IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p, last_value(pt IGNORE NULLS) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS q FROM (SELECT *, CASE WHEN value IS NOT NULL THEN {'at': pos, 'is': value} END AS pt FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM g)))""",
}
for _how, _sql in _FILLS.items():

    def _fill(spark, d, how=_how):
        df = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS value", "CASE WHEN event_id % 6 = 2 THEN NULL ELSE event_type END AS event_type")
        return A.fill_missing(df, ["event_type" if how == "mode" else "value"], how, -1.0, order="event_id")[0].withColumn("value", F.round("value", 6))

    _fill.__name__ = f"fill_{_how}"
    query(f"WITH g AS {_GAPS} {_sql}")(_fill)


# -- structure ---------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, status, price, priority, same, customer_id, customer_copy FROM {ORDERS_SQL}")
def drop_high_missing(spark, d):
    return A.drop_high_missing_columns(orders(spark, d), 0.6)[0]


@query("SELECT o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 17 <> 0")
def drop_empty_rows(spark, d):
    return A.drop_empty_rows(table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price"))[0]


@query(f"SELECT o_orderkey, price FROM {ORDERS_SQL}")
def drop_columns(spark, d):
    return A.drop_columns(orders(spark, d), ["status", "priority", "mostly_null", "same", "customer_id", "customer_copy", "absent"])[0]


@query("SELECT r_regionkey AS id, r_name AS label FROM region")
def rename_columns(spark, d):
    return A.rename_columns(table(spark, d, "region"), {"r_regionkey": "id", "r_name": "label", "absent": "x"})[0]


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS nation_name_1 FROM nation")
def std_names(spark, d):
    return A.standardize_column_names(table(spark, d, "nation").toDF("NationKey", " Nation Name", "nation-name!"))[0]


@query("SELECT n_nationkey, n_name FROM nation")
def cast_category(spark, d):
    return A.cast_category(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name"])[0]


@query("SELECT n_nationkey, n_name FROM nation")
def no_action(spark, d):
    return A.none(table(spark, d, "nation").select("n_nationkey", "n_name"))[0]


@query("SELECT * FROM (VALUES ('padding', ' a'), ('capitals', 'B'), ('special characters', 'c-d'), ('spaces', 'e f'), ('placeholder', 'Unnamed: 0'), ('capitals', 'Unnamed: 0'), ('spaces', 'Unnamed: 0'), ('special characters', 'Unnamed: 0')) AS t(issue, name)")
def name_scan(spark, d):
    df = table(spark, d, "lineitem").toDF(" a", "B", "c-d", "e f", "Unnamed: 0", "g", "h", "i", "j", "k", "l")
    return by_column(spark, [(i, c) for x in found(df, "colnames") for c, issues in x.evidence["issues"].items() for i in issues], "issue string, name string")


# -- privacy and encoding ----------------------------------------------------------------------------------------------

_MAIL = "concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.org')"
_PEOPLE = (f"{_MAIL} AS mail", "concat('555-', CAST(1000000 + c_custkey AS VARCHAR(20))) AS phone", "concat('10.0.', CAST(c_custkey % 200 AS VARCHAR(20)), '.', CAST(c_custkey % 100 AS VARCHAR(20))) AS address")
for _mode, _sql in {"hash": f"left(sha256(concat('salt', {_MAIL})), 16)", "redact": "'[REDACTED]'", "partial": "'us***@example.org'"}.items():

    def _mask(spark, d, mode=_mode):
        return A.mask_pii(table(spark, d, "customer").selectExpr("c_custkey", f"{_MAIL} AS mail"), ["mail"], mode, "salt")[0]

    _mask.__name__ = f"mask_{_mode}"
    query(f"SELECT c_custkey, {_sql} AS mail FROM customer")(_mask)


@query("SELECT * FROM (VALUES ('mail', 'email'), ('phone', 'phone')) AS t(name, kind)")
def pii_scan(spark, d):
    return by_column(spark, [(x.columns[0], x.evidence["kind"]) for x in found(table(spark, d, "customer").selectExpr(*_PEOPLE), "pii")], "name string, kind string")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'café' WHEN 1 THEN 'plain' ELSE 'Ã' END AS word FROM nation")
def fix_encoding(spark, d):
    return A.fix_encoding(table(spark, d, "nation").selectExpr("n_nationkey", "CASE n_nationkey % 3 WHEN 0 THEN 'cafÃ©' WHEN 1 THEN 'plain' ELSE 'Ã' END AS word"), ["word"])[0]


@query("SELECT 'text' AS name, count(*) AS n FROM documents WHERE regexp_matches(text, 'Ã|â€|Â|ï»¿|�|Ð|Ñ')")
def mojibake_scan(spark, d):
    n = Profile(table(spark, d, "documents").select("text")).stats["text"]["mojibake"]
    return by_column(spark, [("text", n)], "name string, n long")


# -- sources and life cycle --------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL BY NAME SELECT c_custkey, c_acctbal, NULL::VARCHAR AS c_name FROM customer WHERE c_custkey % 2 = 1")
def union_by_name_sources(spark, d):
    c = table(spark, d, "customer")
    return union([c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), c.filter("c_custkey % 2 = 1").select("c_custkey", "c_acctbal")])


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS \"props.k\" FROM events")
def json_flatten(spark, d):
    return flatten(table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props")))


@query()
def findings_report(spark, d):
    c = Cleaner(spark, orders(spark, d))
    c.ingest()
    c.scan()
    return c.findings_table()


@query()
def plan_table(spark, d):
    df = orders(spark, d)
    return by_column(spark, [(p.finding_id, p.action, json.dumps(p.params, default=str), p.risk, p.order, p.rationale) for p in build_plan(df, scan(df))], "finding_id string, action string, params string, risk string, position int, rationale string")


@query()
def audit_trail(spark, d):
    c = Cleaner(spark, orders(spark, d))
    c.run()
    return c.audit()


_RECIPE = [
    ("replace_sentinels_with_na", {"columns": ["status"]}), ("strip_whitespace", {"columns": ["priority"]}), ("fill_missing", {"columns": ["price"], "strategy": "constant", "value": 0.0}),
    ("normalize_case", {"columns": ["priority"], "mode": "lower"}), ("drop_columns", {"columns": ["mostly_null", "same", "customer_copy"]}), ("rename_columns", {"mapping": {"customer_id": "customer"}}),
]


@query(f"SELECT o_orderkey, CASE WHEN lower(trim(status)) IN ({listed(NULL_TOKENS)}) THEN NULL ELSE status END AS status, coalesce(price, 0.0::DOUBLE) AS price, lower(trim(priority)) AS priority, customer_id AS customer FROM {ORDERS_SQL}")
def replay_recipe(spark, d):
    return replay(orders(spark, d), json.dumps(_RECIPE)).drop(RID)
