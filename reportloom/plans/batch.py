"""The batch run as queries: feeds written out of whole tables, taken in, judged and built.

Feeds are dropped the way Spark writes them, as folders of part files. One run meets every
problem a source can have, one is stopped by a red match contract, and one is clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.functions import metrics as m
from reportloom.operators import governance
from reportloom.operators.report_query import json_safe, stable_order
from reportloom.plans.run import RunRecord, run
from reportloom.plans.trade import table
from reportloom.sources.discovery import discover, list_files
from reportloom.sources.layers import Layers, catalogue, shared_folder
from reportloom.spec import Dimension, Field, Join, Report, ReportModel, Source, Wide

ORDER_FIELDS = (
    Field("Order", "order_key", "integer", required=True, unique=True),
    Field("Customer", "cust_key", "integer"),
    Field("Status", "status", enum=("F", "O")),
    Field("Date", "order_date", "date"),
    Field("Total", "total", "decimal", range=(0, 400000), default=0),
)
CUSTOMER_FIELDS = (
    Field("Customer", "cust_key", "integer", required=True),
    Field("Segment", "segment"),
    Field("Nation", "nation_key", "integer"),
)
ORDER_DROP = Source("order_drop", ORDER_FIELDS, patterns=("orders_*.csv", "*.csv"))
CUSTOMER_DROP = Source("customer_drop", CUSTOMER_FIELDS, patterns=("customers*.csv",))


def shop(name: str, *further: Source) -> ReportModel:
    return ReportModel(
        name,
        (ORDER_DROP, CUSTOMER_DROP, *further),
        Wide(
            "order_wide",
            "order_drop",
            (Join("customer_drop", "cust_key", "cust_key", ("segment", "nation_key")),),
            drop=("status",),
        ),
        (Dimension("quarter", "order_date", "time", "quarter"), Dimension("segment", "segment")),
        (m.total("total", "total"), m.row_count("orders"), m.distinct_count("customers", "cust_key")),
        (
            Report("segment_quarter", "segment", ("total", "orders", "customers"), time_dim="quarter"),
            Report("segment_total", "segment", ("customers", "total"), base="segment_quarter"),
        ),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order"),
        F.col("o_custkey").alias("Customer"),
        F.col("o_orderstatus").alias("Status"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("Total"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_nationkey").alias("Nation"),
    )


def drop(df: DataFrame, inbox: str, name: str, encoding: str = "UTF-8") -> None:
    df.write.option("header", True).option("encoding", encoding).csv(f"{inbox}/{name}")


TROUBLED = (
    Source("renamed", (Field("Nation", "name"),), patterns=("nation*.csv",)),
    Source("header_only", (Field("Part", "part"),), patterns=("parts*.csv",), problems={"empty_file": "yellow"}),
    Source("all_dropped", (Field("Region", "region", required=True),), patterns=("region*.csv",)),
    Source("undecodable", (Field("Supplier", "supplier"),), patterns=("suppliers*.csv",)),
    Source("absent", (Field("Line", "line"),), patterns=("lines*.csv", "line_items*.csv")),
    Source("crashing", (Field("Order", "order"),), patterns=("orders_*.csv",), clean=("unknown_step",)),
)


def troubled_inbox(spark: SparkSession, sf_dir: str) -> str:
    """Two drops of orders, customers without a header, and one of each further trouble."""
    inbox = shared_folder(spark, "inbox")
    drop(orders(spark, sf_dir).where("Order % 2 = 0"), inbox, "orders_1.csv")
    drop(customers(spark, sf_dir), inbox, "customers.csv")
    drop(table(spark, sf_dir, "nation").select(F.col("n_name").alias("Country")), inbox, "nation.csv")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("Part"))
    drop(parts.where("Part is null"), inbox, "parts.csv")
    nothing = F.lit(None).cast("string").alias("Region")
    drop(table(spark, sf_dir, "region").select(nothing, "r_name"), inbox, "region.csv")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("店 "), "s_name").alias("Supplier"))
    drop(suppliers, inbox, "suppliers.csv", "UTF-16")
    drop(orders(spark, sf_dir), inbox, "orders_2.csv")
    return inbox


def done(spark: SparkSession, model: ReportModel, inbox: str) -> tuple[RunRecord, Layers]:
    root = shared_folder(spark, "batch")
    return run(spark, model, inbox, root, "run-1"), Layers(spark, root)


def batch_problems(spark, sf_dir):
    """Ledger of a run whose feeds are missing, unreadable, renamed, empty or doubled."""
    _, layers = done(spark, shop("troubled", *TROUBLED), troubled_inbox(spark, sf_dir))
    return layers.ledger().select("source", "field", "rule", "level", "cnt", "sample")


def batch_stopped(spark, sf_dir):
    """Node states of a run that a repeated customer key stops before the wide table."""
    inbox = shared_folder(spark, "inbox")
    twice = customers(spark, sf_dir)
    drop(orders(spark, sf_dir), inbox, "orders_1.csv")
    drop(twice.unionByName(twice.where("Nation = 3")), inbox, "customers.csv")
    _, layers = done(spark, shop("stopped"), inbox)
    light = layers.runs().select(
        F.lit("run").alias("node"), "status", F.lit(0).cast("bigint").alias("failures")
    )
    return layers.nodes().select("node", "status", "failures").unionByName(light)


def clean_run(spark: SparkSession, sf_dir: str) -> Layers:
    inbox = shared_folder(spark, "inbox")
    drop(orders(spark, sf_dir), inbox, "orders_1.csv")
    drop(customers(spark, sf_dir), inbox, "customers.csv")
    return done(spark, shop("clean"), inbox)[1]


def batch_report(spark, sf_dir):
    """The stored second layer of a clean run, in its stable order."""
    return json_safe(stable_order(clean_run(spark, sf_dir).read("marts", "segment_total"), ["segment"]))


def batch_catalogue(spark, sf_dir):
    """Columns and types of the tables of a clean run; the wide table lacks what it drops."""
    layers = clean_run(spark, sf_dir)
    names = (("raw", "order_drop"), ("intermediate", "order_wide"), ("marts", "segment_quarter"))
    return catalogue(spark, {n: layers.read(*n) for n in names}).drop("position")


def batch_missing(spark, sf_dir):
    """Declared sources that the listing of an inbox has nothing for."""
    model = shop("troubled", *TROUBLED)
    found = discover(list_files(spark, troubled_inbox(spark, sf_dir)), model.sources.values())
    declared = spark.createDataFrame([(name,) for name in model.sources], "source string")
    return governance.missing_sources(declared, found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (batch_problems, batch_stopped, batch_report, batch_catalogue, batch_missing)
}

# The tables of the clean run as they are stored.
_RAW = "order_key bigint, cust_key bigint, status string, order_date date, total decimal(18,4)"
_WIDE = "order_key bigint, cust_key bigint, order_date date, total decimal(18,4), segment string, nation_key bigint"
_MART = "quarter date, segment string, total decimal(28,4), orders bigint, customers bigint"


def _columns(layer: str, name: str, columns: str, provenance: bool = False) -> str:
    pairs = [c.rsplit(" ", 1) if "decimal" not in c else c.split(" ", 1) for c in columns.split(", ")]
    pairs += [["_source_file", "string"], ["_loaded_at", "timestamp"]] * provenance
    return ", ".join(f"('{layer}', '{name}', '{c}', '{t}')" for c, t in pairs)


ORACLES = {
    "batch_problems": """
WITH fixed(source, field, rule, level, cnt, sample) AS (VALUES
  ('order_drop', '-', 'multi_match', 'yellow', 0, 'took orders_2.csv, ignored orders_1.csv'),
  ('crashing', '-', 'multi_match', 'yellow', 0, 'took orders_2.csv, ignored orders_1.csv'),
  ('crashing', '-', 'ingest_crashed', 'red', 0, 'SpecError: unknown cleaning step unknown_step'),
  ('renamed', '-', 'header_changed', 'red', 0, 'missing [''Nation'']'),
  ('header_only', '-', 'empty_file', 'yellow', 0, 'no data rows'),
  ('all_dropped', '-', 'empty_after_clean', 'red', 0, 'no rows left'),
  ('undecodable', '-', 'read_failed', 'red', 0, 'none of the encodings [''utf-8-sig''] fits'),
  ('absent', '-', 'file_missing', 'red', 0, 'nothing fits (''lines*.csv'', ''line_items*.csv'')')
), o AS (
  SELECT o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders
), broken AS (
  SELECT 'order_drop' AS source, 'status' AS field, 'enum' AS rule, 'yellow' AS level, count(*) AS cnt,
         array_to_string(list_slice(list_sort(list(DISTINCT status)), 1, 5), ', ') AS sample
  FROM o WHERE status NOT IN ('F', 'O') HAVING count(*) > 0
  UNION ALL
  SELECT 'order_drop', 'total', 'range', 'yellow', count(*),
         array_to_string(list_slice(list_sort(list(DISTINCT CAST(total AS VARCHAR))), 1, 3), ', ')
  FROM o WHERE total NOT BETWEEN 0 AND 400000 HAVING count(*) > 0
)
SELECT * FROM fixed UNION ALL SELECT * FROM broken""",
    "batch_stopped": """
WITH o AS (
  SELECT count_if(o_orderstatus NOT IN ('F', 'O')) AS statuses,
         count_if(CAST(o_totalprice AS DECIMAL(18,2)) NOT BETWEEN 0 AND 400000) AS totals FROM orders
), d AS (SELECT count(DISTINCT c_custkey) AS twice FROM customer WHERE c_nationkey = 3)
SELECT 'raw.order_drop' AS node, 'success' AS status,
       CAST((statuses > 0) AS BIGINT) + CAST((totals > 0) AS BIGINT) AS failures FROM o
UNION ALL SELECT 'raw.customer_drop', 'success', 0
UNION ALL SELECT 'test.not_null_order_drop_order_key', 'success', 0
UNION ALL SELECT 'test.unique_order_drop_order_key', 'success', 0
UNION ALL SELECT 'test.accepted_values_order_drop_status', CASE WHEN statuses > 0 THEN 'warn' ELSE 'success' END, statuses FROM o
UNION ALL SELECT 'test.range_order_drop_total', CASE WHEN totals > 0 THEN 'warn' ELSE 'success' END, totals FROM o
UNION ALL SELECT 'test.not_null_customer_drop_cust_key', 'success', 0
UNION ALL SELECT 'test.match_customer_drop_fanout', CASE WHEN twice > 0 THEN 'fail' ELSE 'success' END, twice FROM d
UNION ALL SELECT 'intermediate.order_wide', 'skipped', 0
UNION ALL SELECT 'marts.segment_quarter', 'skipped', 0
UNION ALL SELECT 'marts.segment_total', 'skipped', 0
UNION ALL SELECT 'run', 'red', 0""",
    "batch_report": """
SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS customers,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "batch_catalogue": f"""
SELECT * FROM (VALUES {_columns('raw', 'order_drop', _RAW, True)},
  {_columns('intermediate', 'order_wide', _WIDE)},
  {_columns('marts', 'segment_quarter', _MART)}) AS t(layer, table_name, column_name, type)""",
    "batch_missing": "SELECT 'absent' AS source",
}
