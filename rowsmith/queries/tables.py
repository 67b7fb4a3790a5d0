"""Queries for sources, sinks, views, profiles, preparation and metrics, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import display, split
from ..functions.text import NUMBER_PATTERN
from ..operators import encode, evaluate, impute, profile, view
from ..operators.models.voting import majority
from ..plans.prepare import Settings, fit_preparation, split_target
from ..session import scratch_path
from ..sources import csv, registry, sinks
from .common import fold_sql, holdout_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# -- planted tables --------------------------------------------------------------------------

NULL_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"
NULL_PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"


def orders_with_gaps(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
        F.expr(NULL_PRICE).alias("o_totalprice"), F.expr(NULL_PRIORITY).alias("o_orderpriority"),
    )


ORDERS_SQL = (
    f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, {NULL_PRICE} AS o_totalprice, "
    f"{NULL_PRIORITY} AS o_orderpriority FROM orders"
)

MIXED = {
    "event_id": "cast(event_id as string)",
    "mixed": "CASE WHEN event_id % 5 = 0 THEN 'Unit Down' WHEN event_id % 13 = 0 THEN '' ELSE '1_000.5' END",
    "gappy": "CASE WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN ' -1.5e3 ' ELSE cast(user_id as string) END",
    "odd": "CASE WHEN event_id % 4 = 0 THEN '1f' WHEN event_id % 4 = 1 THEN '0x10' ELSE 'nan' END",
    "clean": "CASE WHEN event_id % 2 = 0 THEN 'inf' ELSE '.5' END",
    "empty": "CASE WHEN event_id % 2 = 0 THEN '' ELSE NULL END",
    "event_type": "event_type",
    "value": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE '3.25' END",
}


def mixed_text(spark, sf):
    return table(spark, sf, "events").select(*[F.expr(e).alias(n) for n, e in MIXED.items()])


MIXED_SQL = "SELECT " + ", ".join(f"{e.replace('as string', 'AS VARCHAR')} AS {n}" for n, e in MIXED.items()) + " FROM events"
NUMBER_SQL = NUMBER_PATTERN.replace("(?i)", "")


def _per_column(make) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS column, {make(n)} FROM m" for n in MIXED)


def _strict_sql(n):
    return f"CASE WHEN bool_and(coalesce(regexp_matches(trim({n}), '{NUMBER_SQL}', 'i'), false)) THEN 'Numeric' ELSE 'Categorical' END"


def _lenient_sql(n):
    found = f"bool_and(CASE WHEN {n} IS NOT NULL AND trim({n}) <> '' THEN regexp_matches(trim({n}), '{NUMBER_SQL}', 'i') END)"
    return f"CASE WHEN {found} IS NULL THEN 'Unknown' WHEN {found} THEN 'Numeric' ELSE 'Categorical' END"


def _blank_sql(n):
    return f"count(*) FILTER (WHERE {n} IS NULL OR trim({n}) = '')::BIGINT"


# -- sources and sinks ---------------------------------------------------------------------------

CSV_CUSTOMERS = (
    "SELECT c_custkey, ' ' || c_name || ' ' AS c_name, 9000000000000000000 + c_custkey AS long_id, "
    "CASE c_custkey % 4 WHEN 0 THEN 'said \"' || c_name || '\", ok' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE 'a,b' END AS note, "
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS nation_key, "
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal, "
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS mktsegment FROM customer"
)


CSV_NOTE = (
    "CASE c_custkey % 4 WHEN 0 THEN concat('said \"', c_name, '\", ok') WHEN 1 THEN concat('two', chr(10), 'lines') ELSE 'a,b' END"
)


def _customer_csv(spark, sf):
    """The customer table as CSV files, with missing marks, quotes, line breaks and long ids planted and odd headers."""
    path = scratch_path(spark, "customers.csv")
    c = table(spark, sf, "customer")
    c.select(
        "c_custkey",
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias(" c_name "),
        (F.lit(9000000000000000000) + F.col("c_custkey")).alias("long_id"),
        F.expr(CSV_NOTE).alias("note"),
        F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_nationkey").cast("string")).alias("nation_key"),
        F.when(F.col("c_custkey") % 7 == 0, "null").otherwise(F.col("c_acctbal").cast("string")).alias("acctbal"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("mktsegment"),
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


@query(CSV_CUSTOMERS)
def csv_typed_read(spark, sf):
    return csv.read_csv(spark, _customer_csv(spark, sf)).drop(csv.ROW_ORDER)


@query(
    "SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, cast(9000000000000000000 + c_custkey AS VARCHAR) AS long_id, "
    "CASE c_custkey % 4 WHEN 0 THEN 'said \"' || c_name || '\", ok' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE 'a,b' END AS note, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE cast(c_nationkey AS VARCHAR) END AS nation_key, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE cast(c_acctbal AS VARCHAR) END AS acctbal, "
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS mktsegment FROM customer"
)
def csv_raw_read(spark, sf):
    return csv.read_raw(spark, _customer_csv(spark, sf)).drop(csv.ROW_ORDER)


@query(
    "WITH f AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' "
    "WHEN 2 THEN '.csv.txt' ELSE '.xlsx' END AS filename FROM customer) "
    "SELECT c_custkey, filename FROM f WHERE lower(filename) LIKE '%.csv'"
)
def csv_names_accepted(spark, sf):
    ending = F.expr("CASE c_custkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' WHEN 2 THEN '.csv.txt' ELSE '.xlsx' END")
    named = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", ending).alias("filename"))
    return named.where(csv.is_csv_name(F.col("filename")))


@query(
    "SELECT o_orderstatus, 'ana' AS \"user\", 'price model' AS model, '20240102030405' AS ts, "
    "count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"
)
def landed_upload(spark, sf):
    path = scratch_path(spark, "landing")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    sinks.land_upload(table(spark, sf, "orders"), path, "ana", "price model", at)
    rows = spark.read.option("basePath", path).schema(
        "o_orderstatus string, o_totalprice double, user string, model string, ts string"
    ).parquet(path)
    return rows.groupBy("o_orderstatus", "user", "model", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS o_orderpriority FROM orders "
    "UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"
)
def results_appended(spark, sf):
    """Rows appended before and after a column was added."""
    path = scratch_path(spark, "results")
    o = table(spark, sf, "orders")
    sinks.append_rows(o.select("o_orderkey", "o_orderstatus"), path)
    sinks.append_rows(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return sinks.read_appended(spark, path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "SELECT c_custkey, NULL::INTEGER AS c_nationkey FROM customer UNION ALL SELECT c_custkey, c_nationkey FROM customer"
)
def results_stacked(spark, sf):
    c = table(spark, sf, "customer")
    return sinks.stack_results(c.select("c_custkey"), c.select("c_nationkey", "c_custkey"))


@query(
    f"SELECT o_orderkey, to_json({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, "
    f"'o_orderpriority': o_orderpriority}})::VARCHAR AS record FROM ({ORDERS_SQL})"
)
def result_records(spark, sf):
    rows = orders_with_gaps(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sinks.as_records(rows, ["o_orderkey"])


@query(
    "SELECT o_orderkey, o_totalprice AS prediction, CASE o_orderkey % 3 WHEN 0 THEN 'a \"' || o_orderstatus || '\", b' "
    "WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE o_orderpriority END AS note, '[0.25,0.75]' AS probability FROM orders"
)
def results_csv_download(spark, sf):
    path = scratch_path(spark, "download.csv")
    o = table(spark, sf, "orders")
    sinks.download_csv(
        o.select("o_orderkey", F.col("o_totalprice").alias("prediction"),
                 F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('a \"', o_orderstatus, '\", b') "
                        "WHEN 1 THEN concat('two', chr(10), 'lines') ELSE o_orderpriority END").alias("note"),
                 F.array(F.lit(0.25), F.lit(0.75)).alias("probability")), path)
    return spark.read.schema("o_orderkey bigint, prediction double, note string, probability string").options(
        header=True, escape='"', multiLine=True
    ).csv(path)


# -- projections and views -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus AS \"order status\", o_totalprice AS \"2E1540_4:215FT001.PNT\" FROM orders")
def headers_cleaned(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return csv.clean_headers(o.toDF(" o_orderkey", "order status \r\n", "2E1540_4:215FT001.PNT\r\n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def features_without_target(spark, sf):
    return split_target(table(spark, sf, "orders"), "o_orderstatus")[0]


@query("SELECT o_orderstatus FROM orders")
def target_alone(spark, sf):
    return split_target(table(spark, sf, "orders"), "o_orderstatus")[1]


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS target FROM orders")
def features_beside_target(spark, sf):
    """Features and target side by side: columns of one frame, no join."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("target"))


@query(
    "SELECT 'o_orderstatus' AS column, count(DISTINCT o_orderstatus)::BIGINT AS n_values FROM orders "
    "UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::BIGINT FROM orders "
    "UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate)::BIGINT FROM orders"
)
def text_columns_found(spark, sf):
    o = table(spark, sf, "orders")
    names = encode.text_columns(o)
    codes = encode.category_codes(o, names, ["o_orderkey"])
    return codes.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 4")
def preview_rows(spark, sf):
    return view.preview(table(spark, sf, "orders"), ["o_orderkey"])


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
def third_page(spark, sf):
    return view.page(table(spark, sf, "orders"), ["o_orderkey"], 3)


@query("SELECT count(*)::BIGINT AS row_count, ceil(count(*) / 5.0)::BIGINT AS pages FROM orders")
def page_total(spark, sf):
    return view.page_count(table(spark, sf, "orders"))


@query(
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT AS row_number, "
    "ceil(row_number() OVER (ORDER BY o_totalprice, o_orderkey) / 5.0)::BIGINT AS page FROM orders"
)
def rows_with_pages(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return view.number_pages(o, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_number", "page")


@query(
    "SELECT o_orderkey, o_orderstatus AS prediction, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE (o_orderkey % 10) / 10e0 END AS probability FROM orders"
)
def predictions_with_probability(spark, sf):
    scored = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("prediction"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 10) / 10e0 END").alias("probability_1"),
    )
    return view.result_rows(scored, ["o_orderkey"])


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN printf('%.2f', round((o_orderkey % 64) / 64e0 * 100, 2)) "
    "WHEN 1 THEN printf('%.2f', round((o_orderkey % 1000) / 8e0, 2)) ELSE 'N/A' END AS shown FROM orders"
)
def headline_numbers(spark, sf):
    o = table(spark, sf, "orders")
    accuracy = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 64) / 64e0 END")
    rmse = F.expr("CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 1000) / 8e0 END")
    return o.select("o_orderkey", display.headline(accuracy, rmse).alias("shown"))


@query(
    "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS readable FROM events"
)
def time_stamps(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", display.stamp(F.col("ts")).alias("stamp"), display.readable(F.col("ts")).alias("readable")
    )


# -- profiles ---------------------------------------------------------------------------------------


@query(f"WITH m AS ({MIXED_SQL}) " + _per_column(lambda n: f"{_strict_sql(n)} AS data_type, {_blank_sql(n)} AS missing_data_count"))
def profile_strict(spark, sf):
    return profile.profile_columns(mixed_text(spark, sf), strict=True)


@query(f"WITH m AS ({MIXED_SQL}) " + _per_column(lambda n: f"{_lenient_sql(n)} AS data_type, {_blank_sql(n)} AS missing_data_count"))
def profile_lenient(spark, sf):
    return profile.profile_columns(mixed_text(spark, sf))


@query(f"WITH m AS ({MIXED_SQL}) " + _per_column(lambda n: f"{_blank_sql(n)} AS missing_data_count"))
def missing_text_cells(spark, sf):
    return profile.profile_columns(mixed_text(spark, sf)).select("column", "missing_data_count")


@query(
    f"WITH m AS ({ORDERS_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*)::BIGINT AS row_count, (count(*) - count({c}))::BIGINT AS missing_records FROM m"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    )
)
def column_analysis(spark, sf):
    return profile.analyse_columns(orders_with_gaps(spark, sf))


def _task_sql(make):
    return (
        f"WITH m AS ({MIXED_SQL}), p AS ("
        + _per_column(lambda n: f"{make(n)} AS data_type")
        + ") SELECT \"column\", data_type, CASE WHEN data_type = 'Numeric' THEN 'Regression' ELSE 'Classification' END AS task FROM p"
    )


@query(_task_sql(_lenient_sql))
def task_per_target(spark, sf):
    return profile.infer_tasks(mixed_text(spark, sf))


@query(_task_sql(_strict_sql))
def task_per_target_strict(spark, sf):
    return profile.infer_tasks(mixed_text(spark, sf), strict=True)


@query(
    f"WITH m AS ({MIXED_SQL}) SELECT count(*)::BIGINT AS n, {_lenient_sql('event_type')} AS found, "
    "'Classification' AS by_cells, 'Regression' AS by_override FROM m"
)
def task_overridden(spark, sf):
    m = mixed_text(spark, sf)
    return m.agg(
        F.count(F.lit(1)).alias("n"), profile.lenient_type("event_type").alias("found"),
        F.lit(profile.infer_task(m, "event_type")).alias("by_cells"),
        F.lit(profile.infer_task(m, "event_type", target_type=profile.NUMERIC)).alias("by_override"),
    )


@query(f"SELECT (count(*) - count(o_totalprice))::BIGINT AS missing_before, 0::BIGINT AS missing_after FROM ({ORDERS_SQL})")
def target_missing_count(spark, sf):
    return profile.missing_in_target(orders_with_gaps(spark, sf), "o_totalprice")


# -- preparation --------------------------------------------------------------------------------------

CODES_SQL = (
    "WITH g AS ({rows}), f AS (SELECT {column} AS value, min(o_orderkey) AS first, count(*) AS n FROM g "
    "WHERE {column} IS NOT NULL GROUP BY 1), "
    "c AS (SELECT cast(value AS VARCHAR) AS value, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS code, n::BIGINT AS rows FROM f) "
)
PRIORITY_CODES = CODES_SQL.format(rows=ORDERS_SQL, column="o_orderpriority")


@query(PRIORITY_CODES + "SELECT 'o_orderpriority' AS column, value, code, rows FROM c")
def category_codes(spark, sf):
    return encode.category_codes(orders_with_gaps(spark, sf), ["o_orderpriority"], ["o_orderkey"])


@query(
    CODES_SQL.format(rows="SELECT o_orderkey, cast(o_totalprice AS BIGINT) AS cents FROM orders", column="cents")
    + "SELECT 'cents' AS column, value, code, rows FROM c"
)
def category_codes_many_values(spark, sf):
    """A column with very many values: numbered by ranges, not by one window."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("cast(round(o_totalprice) as bigint)").alias("cents"))
    return encode.category_codes(o, ["cents"], ["o_orderkey"], window_values=0)


ORACLES["category_codes_many_values"] = ORACLES["category_codes_many_values"].replace(
    "cast(o_totalprice AS BIGINT)", "cast(round(o_totalprice) AS BIGINT)"
)


@query(
    PRIORITY_CODES + f"SELECT o_orderkey, coalesce(code, -1)::BIGINT AS code FROM ({ORDERS_SQL}) o "
    "LEFT JOIN c ON c.value = o.o_orderpriority"
)
def encoded_rows(spark, sf):
    o = orders_with_gaps(spark, sf)
    codes = encode.category_codes(o, ["o_orderpriority"], ["o_orderkey"])
    coded = encode.encode(o, codes, ["o_orderpriority"], encode.map_sizes(codes), {"o_orderpriority": "code"})
    return coded.select("o_orderkey", "code")


@query(f"SELECT o_orderkey, o_orderpriority AS again FROM ({ORDERS_SQL})")
def decoded_rows(spark, sf):
    o = orders_with_gaps(spark, sf)
    codes = encode.category_codes(o, ["o_orderpriority"], ["o_orderkey"])
    sizes = encode.map_sizes(codes)
    coded = encode.encode(o, codes, ["o_orderpriority"], sizes)
    back = encode.decode(coded, codes, "o_orderpriority", F.col("o_orderpriority_code"), "again", sizes["o_orderpriority"])
    return back.select("o_orderkey", "again")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_custkey % 500 AS VARCHAR) END AS again FROM orders")
def decoded_rows_many_values(spark, sf):
    """Decoded without a broadcast of the mapping: frequent codes and rows without one do not meet in a task."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_custkey % 500 AS string) END").alias("who"))
    codes = encode.category_codes(o, ["who"], ["o_orderkey"])
    large = encode.MapSize(encode.BROADCAST_VALUES + 1, 0)
    coded = encode.encode(o, codes, ["who"], {"who": large})
    return encode.decode(coded, codes, "who", F.col("who_code"), "again", large).select("o_orderkey", "again")


@query(
    CODES_SQL.format(rows="SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'", column="o_orderpriority")
    + "SELECT o_orderkey, coalesce(code, -1)::BIGINT AS code FROM orders o LEFT JOIN c ON c.value = o.o_orderpriority"
)
def unseen_categories(spark, sf):
    """Codes learned without one category, applied to the whole table."""
    o = table(spark, sf, "orders")
    codes = encode.category_codes(o.where("o_orderpriority <> '5-LOW'"), ["o_orderpriority"], ["o_orderkey"])
    coded = encode.encode(o, codes, ["o_orderpriority"], encode.map_sizes(codes), {"o_orderpriority": "code"})
    return coded.select("o_orderkey", "code")


MEANS_SQL = f"SELECT avg(o_totalprice) AS m FROM ({ORDERS_SQL})"


@query(
    f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM ({ORDERS_SQL}) "
    f"WHERE NOT {holdout_sql('o_orderkey')})), 4) AS filled FROM ({ORDERS_SQL})"
)
def mean_filled(spark, sf):
    """Means of the learning rows in the missing cells of all rows."""
    o = orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey")
    prep = fit_preparation(o, Settings("o_custkey", "o_orderkey", "Regression"))
    return prep.apply(o).select("o_orderkey", F.round(vector_to_array("features")[0], 4).alias("filled"))


@query(
    f"SELECT o_orderkey, round(coalesce(o_totalprice, ({MEANS_SQL})), 4) AS filled FROM ({ORDERS_SQL})"
)
def batch_mean_filled(spark, sf):
    o = orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice")
    filled = impute.fill_batch_means(o, ["o_totalprice"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("filled"))


@query(
    f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM ({ORDERS_SQL}))) AS target FROM ({ORDERS_SQL})"
)
def median_filled_target(spark, sf):
    o = orders_with_gaps(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("target"))
    return impute.fill_median(o, "target")[0]


@query(f"SELECT o_orderkey, {holdout_sql('o_orderkey')} AS held_out FROM orders")
def holdout_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", split.is_holdout(F.col("o_orderkey")).alias("held_out"))


@query(f"SELECT {fold_sql('o_orderkey', 10)}::INTEGER AS fold, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def fold_sizes(spark, sf):
    return table(spark, sf, "orders").groupBy(split.fold_number(F.col("o_orderkey")).alias("fold")).agg(
        F.count(F.lit(1)).alias("n")
    )


# -- metrics and ranking ----------------------------------------------------------------------------------

RULES = {"every 5th wrong": 5, "every 9th wrong": 9, "every 9th wrong again": 9, "every 3rd wrong": 3}


def class_predictions(spark, sf):
    """Three rule-made predictors in long form."""
    o = table(spark, sf, "orders")
    each = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("model"),
                 F.expr(f"CASE WHEN o_orderkey % {k} = 0 THEN 'F' ELSE o_orderstatus END").alias("prediction"))
        for i, (m, k) in enumerate(RULES.items())
    ])
    return o.select(F.col("o_orderstatus").alias("label"), F.inline(each))


CLASS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{m}' AS model, o_orderstatus AS label, "
    f"CASE WHEN o_orderkey % {k} = 0 THEN 'F' ELSE o_orderstatus END AS prediction FROM orders"
    for i, (m, k) in enumerate(RULES.items())
)


def value_predictions(spark, sf):
    o = table(spark, sf, "orders")
    each = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("model"),
                 F.expr(f"o_totalprice + CASE WHEN o_orderkey % {k} = 0 THEN 1000e0 ELSE -10e0 END").alias("prediction"))
        for i, (m, k) in enumerate(RULES.items())
    ])
    return o.select(F.col("o_totalprice").alias("label"), F.inline(each))


VALUE_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{m}' AS model, o_totalprice AS label, "
    f"o_totalprice + CASE WHEN o_orderkey % {k} = 0 THEN 1000e0 ELSE -10e0 END AS prediction FROM orders"
    for i, (m, k) in enumerate(RULES.items())
)
ACCURACY_SQL = "avg((label = prediction)::INTEGER)"
VALUE_SCORES = (
    "sqrt(avg((label - prediction) * (label - prediction))) AS rmse, avg(abs(label - prediction)) AS mae, "
    "1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) AS r2, count(*)::BIGINT AS n"
)


@query(f"SELECT model, round({ACCURACY_SQL}, 6) AS accuracy FROM ({CLASS_SQL}) GROUP BY model")
def accuracy_by_model(spark, sf):
    return class_predictions(spark, sf).groupBy("model").agg(
        F.round(evaluate.accuracy(F.col("label"), F.col("prediction")), 6).alias("accuracy")
    )


@query(
    f"WITH p AS ({CLASS_SQL}), k AS (SELECT model, label AS c FROM p UNION SELECT model, prediction FROM p), "
    "n AS (SELECT model, label, prediction, count(*) AS n FROM p GROUP BY ALL) "
    "SELECT a.model, a.c AS label, b.c AS prediction, coalesce(n.n, 0)::BIGINT AS n FROM k a JOIN k b ON a.model = b.model "
    "LEFT JOIN n ON n.model = a.model AND n.label = a.c AND n.prediction = b.c"
)
def confusion_cells(spark, sf):
    counts = evaluate.confusion_counts(class_predictions(spark, sf), ["model"])
    return evaluate.confusion_cells(counts, ["model"])


@query(
    f"WITH p AS ({CLASS_SQL}), k AS (SELECT model, label AS c FROM p UNION SELECT model, prediction FROM p), "
    "n AS (SELECT model, label, prediction, count(*) AS n FROM p GROUP BY ALL), "
    "f AS (SELECT a.model, a.c AS label, b.c AS prediction, coalesce(n.n, 0)::BIGINT AS n FROM k a JOIN k b ON a.model = b.model "
    "LEFT JOIN n ON n.model = a.model AND n.label = a.c AND n.prediction = b.c), "
    "r AS (SELECT model, label, '[' || string_agg(n::VARCHAR, ',' ORDER BY prediction) || ']' AS row FROM f GROUP BY ALL) "
    "SELECT model, '[' || string_agg(row, ',' ORDER BY label) || ']' AS matrix, "
    "string_agg(label, ',' ORDER BY label) AS classes FROM r GROUP BY model"
)
def confusion_matrices(spark, sf):
    counts = evaluate.confusion_counts(class_predictions(spark, sf), ["model"])
    matrix = evaluate.confusion_matrix(counts, ["model"])
    return matrix.select("model", F.to_json("matrix").alias("matrix"), F.array_join("classes", ",").alias("classes"))


REPORT_SQL = (
    f"WITH p AS ({CLASS_SQL}), k AS (SELECT model, label AS c FROM p UNION SELECT model, prediction FROM p), "
    "s AS (SELECT k.model, k.c, count(*) FILTER (WHERE p.label = k.c) AS support, "
    "count(*) FILTER (WHERE p.prediction = k.c) AS said, count(*) FILTER (WHERE p.label = k.c AND p.prediction = k.c) AS hit "
    "FROM k JOIN p ON p.model = k.model GROUP BY ALL), "
    "q AS (SELECT model, c, support, hit, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, "
    "CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall FROM s), "
    "f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q), "
    "u AS (SELECT model, c AS entry, precision, recall, f1, support FROM f "
    "UNION ALL SELECT model, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f GROUP BY model "
    "UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f GROUP BY model "
    "UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), sum(support) FROM f GROUP BY model) "
    "SELECT model, entry, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u"
)


@query(REPORT_SQL)
def classification_reports(spark, sf):
    counts = evaluate.confusion_counts(class_predictions(spark, sf), ["model"])
    report = evaluate.classification_report(counts, ["model"])
    return report.select("model", "entry", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    f"SELECT model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 8) AS r2, n FROM "
    f"(SELECT model, {VALUE_SCORES} FROM ({VALUE_SQL}) GROUP BY model)"
)
def regression_metrics(spark, sf):
    scores = evaluate.regression_scores(value_predictions(spark, sf), ["model"])
    return scores.select("model", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 8).alias("r2"), "n")


@query(
    f"SELECT row_number() OVER (ORDER BY accuracy DESC, position)::BIGINT AS rank, model, round(accuracy, 6) AS accuracy FROM "
    f"(SELECT model, position, {ACCURACY_SQL} AS accuracy FROM ({CLASS_SQL}) GROUP BY ALL)"
)
def accuracy_leaderboard(spark, sf):
    board = class_predictions(spark, sf).groupBy("model", "position").agg(
        evaluate.accuracy(F.col("label"), F.col("prediction")).alias("accuracy")
    )
    return evaluate.add_rank(board, "accuracy", True).select("rank", "model", F.round("accuracy", 6).alias("accuracy"))


@query(
    f"SELECT row_number() OVER (ORDER BY rmse, position)::BIGINT AS rank, model, round(rmse, 6) AS rmse FROM "
    f"(SELECT model, position, {VALUE_SCORES} FROM ({VALUE_SQL}) GROUP BY model, position)"
)
def rmse_leaderboard(spark, sf):
    board = evaluate.regression_scores(value_predictions(spark, sf), ["model", "position"])
    return evaluate.add_rank(board, "rmse", False).select("rank", "model", F.round("rmse", 6).alias("rmse"))


@query(
    f"WITH b AS (SELECT model, position, {ACCURACY_SQL} AS a FROM ({CLASS_SQL}) GROUP BY ALL) "
    "SELECT model AS model_name, round(a, 6) AS best_accuracy FROM b WHERE a > 0 ORDER BY a DESC, position LIMIT 1"
)
def best_classifier(spark, sf):
    board = class_predictions(spark, sf).groupBy("model", "position").agg(
        evaluate.accuracy(F.col("label"), F.col("prediction")).alias("accuracy")
    )
    best = evaluate.best_model(board, "accuracy", True)
    return best.select("model_name", F.round("best_accuracy", 6).alias("best_accuracy"))


@query(
    f"WITH b AS (SELECT model, position, {VALUE_SCORES} FROM ({VALUE_SQL}) GROUP BY model, position) "
    "SELECT model AS model_name, round(rmse, 6) AS best_rmse FROM b ORDER BY rmse, position LIMIT 1"
)
def best_regressor(spark, sf):
    board = evaluate.regression_scores(value_predictions(spark, sf), ["model", "position"])
    best = evaluate.best_model(board, "rmse", False)
    return best.select("model_name", F.round("best_rmse", 6).alias("best_rmse"))


@query(
    "WITH s AS (SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS l, (o_totalprice % 1000) + "
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 300e0 ELSE 0e0 END AS s FROM orders), "
    "r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s) "
    "SELECT round((sum(r) FILTER (WHERE l) - count(*) FILTER (WHERE l) * (count(*) FILTER (WHERE l) + 1) / 2.0) "
    "/ (count(*) FILTER (WHERE l) * count(*) FILTER (WHERE NOT l)), 6) AS auc, count(*)::BIGINT AS n FROM r"
)
def area_under_roc(spark, sf):
    o = table(spark, sf, "orders")
    label = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")
    scored = o.select(label.alias("label"), (F.col("o_totalprice") % 1000 + label * 300).alias("probability_1"))
    auc = evaluate.roc_auc(scored)
    return scored.agg(F.round(F.lit(auc), 6).alias("auc"), F.count(F.lit(1)).alias("n"))


VOTES = ["o_orderkey % 3", "o_orderkey % 5 % 3", "o_custkey % 3"]


@query(
    "WITH v AS (SELECT o_orderkey, " + ", ".join(f"({v})::DOUBLE AS v{i}" for i, v in enumerate(VOTES)) + " FROM orders), "
    "l AS (SELECT o_orderkey, unnest([v0, v1, v2]) AS v FROM v), c AS (SELECT o_orderkey, v, count(*) AS n FROM l GROUP BY ALL) "
    "SELECT o_orderkey, arg_min(v, -n * 10 + v) AS vote FROM c GROUP BY 1"
)
def majority_vote(spark, sf):
    """Three rule-made members; ties go to the smallest class."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", majority([F.expr(v).cast("double") for v in VOTES], 3).alias("vote"))


# -- registry listings ---------------------------------------------------------------------------------------

AS_MODELS = (
    "SELECT c_mktsegment AS \"user\", 'project ' || cast(c_nationkey % 7 AS VARCHAR) AS project, "
    "'model ' || cast(c_custkey % 11 AS VARCHAR) AS model_name, cast(c_custkey % 3 AS VARCHAR) AS run_id FROM customer"
)


def registered(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("user"),
        F.concat(F.lit("project "), (F.col("c_nationkey") % 7).cast("string")).alias("project"),
        F.concat(F.lit("model "), (F.col("c_custkey") % 11).cast("string")).alias("model_name"),
        (F.col("c_custkey") % 3).cast("string").alias("run_id"), "c_custkey", "c_acctbal",
    )


@query(
    f"WITH r AS ({AS_MODELS}), d AS (SELECT o_orderpriority AS \"user\", count(*) AS deployments FROM orders GROUP BY 1 "
    "UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY 1), "
    "m AS (SELECT \"user\", count(DISTINCT (project, model_name, run_id)) AS models, count(DISTINCT project) AS projects FROM r GROUP BY 1) "
    "SELECT coalesce(d.\"user\", m.\"user\") AS \"user\", coalesce(deployments, 0)::BIGINT AS deployments, "
    "coalesce(models, 0)::BIGINT AS models, coalesce(projects, 0)::BIGINT AS projects FROM d FULL JOIN m ON d.\"user\" = m.\"user\""
)
def registry_counts(spark, sf):
    deployed = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("username")).unionByName(
        table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("username"))
    )
    return registry.counts_by_user(deployed, registered(spark, sf))


@query(
    "SELECT c_custkey, 'model ' || cast(c_custkey % 11 AS VARCHAR) || '_' || c_mktsegment AS endpoint_name, "
    "'2024-05-06 07:08:09' AS date_of_deployment, 'model ' || cast(c_custkey % 11 AS VARCHAR) || '.pkl' AS model_file, "
    "CASE WHEN c_acctbal > 0 THEN 'Active' ELSE 'Inactive' END AS api_status FROM customer"
)
def deployment_records(spark, sf):
    """Deployment records appended as JSON and read back."""
    path = scratch_path(spark, "deployments")
    r = registered(spark, sf)
    link = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("/"), "model_name"))
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    made = r.select("c_custkey", *[
        c.alias(n) for n, c in registry.deployment_columns(F.col("user"), F.col("model_name"), link, at).items()
    ])
    made.write.mode("append").json(path)
    return spark.read.schema(made.schema).json(path)


@query(
    "WITH f AS (SELECT 'model ' || cast(c_custkey % 11 AS VARCHAR) || CASE c_custkey % 4 WHEN 0 THEN '.pkl' "
    "WHEN 1 THEN '.csv' WHEN 2 THEN '.pkl.bak' ELSE '.v2.pkl' END AS filename FROM customer) "
    "SELECT DISTINCT regexp_replace(filename, '\\.pkl$', '') AS name, filename FROM f WHERE filename LIKE '%.pkl'"
)
def model_names(spark, sf):
    ending = F.expr("CASE c_custkey % 4 WHEN 0 THEN '.pkl' WHEN 1 THEN '.csv' WHEN 2 THEN '.pkl.bak' ELSE '.v2.pkl' END")
    files = registered(spark, sf).select(F.concat("model_name", ending).alias("filename"))
    return registry.list_models(files)


@query(f"SELECT DISTINCT \"user\", project FROM ({AS_MODELS}) WHERE \"user\" = 'MACHINERY'")
def project_names(spark, sf):
    return registry.list_projects(registered(spark, sf), "MACHINERY")


@query(
    f"WITH r AS ({AS_MODELS}), w AS (SELECT c_custkey, c_mktsegment AS \"user\", "
    "'project ' || cast(c_custkey % 9 AS VARCHAR) AS project FROM customer) "
    "SELECT \"user\", project, c_custkey FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.\"user\" = w.\"user\" AND r.project = w.project)"
)
def project_names_free(spark, sf):
    wanted = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("user"),
        F.concat(F.lit("project "), (F.col("c_custkey") % 9).cast("string")).alias("project"), "c_custkey",
    )
    return registry.unused_projects(wanted, registered(spark, sf))


@query(
    "SELECT \"user\", project, model_name, run_id, path FROM (SELECT c_mktsegment AS \"user\", "
    "'project ' || cast(c_nationkey % 7 AS VARCHAR) AS project, 'model ' || cast(c_custkey % 11 AS VARCHAR) AS model_name, "
    "cast(c_custkey % 3 AS VARCHAR) AS run_id, c_name AS path, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 7, "
    "c_custkey % 11 ORDER BY c_custkey DESC) AS n FROM customer) WHERE n = 1"
)
def newest_models(spark, sf):
    rows = registered(spark, sf).withColumns({
        "task": F.lit("Regression"), "target": F.lit("y"),
        "path": F.format_string("Customer#%09d", F.col("c_custkey")),
        "created_at": F.timestamp_seconds("c_custkey"),
    })
    return registry.latest(rows).select("user", "project", "model_name", "run_id", "path")
