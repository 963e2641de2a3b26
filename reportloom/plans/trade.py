"""Report models over the trade tables: sales by customer geography, and a ladder of
reports over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.functions import metrics as m
from reportloom.operators.cleaning import select_declared
from reportloom.operators.staging import stage
from reportloom.operators.wide import widen
from reportloom.spec import Dimension, Field, Join, Report, ReportModel, Source, Wide

LINEITEM = Source(
    "lineitem",
    (
        Field("l_orderkey", "order_key", "integer", required=True),
        Field("l_partkey", "part_key", "integer"),
        Field("l_suppkey", "supp_key", "integer"),
        Field("l_linenumber", "line_no", "integer"),
        Field("l_quantity", "quantity", "decimal", range=(1, 40)),
        Field("l_extendedprice", "price", "decimal"),
        Field("l_discount", "discount", "decimal", default=0),
        Field("l_tax", "tax", "decimal"),
        Field("l_returnflag", "return_flag", enum=("A", "N")),
        Field("l_linestatus", "line_status"),
        Field("l_shipdate", "ship_date", "date", required=True),
    ),
)
ORDERS = Source(
    "orders",
    (
        Field("o_orderkey", "order_key", "integer", required=True, unique=True),
        Field("o_custkey", "cust_key", "integer"),
        Field("o_orderstatus", "order_status"),
        Field("o_orderpriority", "priority"),
        Field("o_orderdate", "order_date", "date"),
        Field("o_totalprice", "order_total", "decimal"),
    ),
)
CUSTOMER = Source(
    "customer",
    (
        Field("c_custkey", "cust_key", "integer", required=True, unique=True),
        Field("c_name", "customer_name"),
        Field("c_nationkey", "nation_key", "integer"),
        Field("c_mktsegment", "segment"),
    ),
)
NATION = Source(
    "nation",
    (
        Field("n_nationkey", "nation_key", "integer", required=True, unique=True),
        Field("n_name", "nation_name"),
        Field("n_regionkey", "region_key", "integer"),
    ),
)
REGION = Source(
    "region",
    (
        Field("r_regionkey", "region_key", "integer", required=True, unique=True),
        Field("r_name", "region_name"),
    ),
)
PART = Source(
    "part",
    (
        Field("p_partkey", "part_key", "integer", required=True, unique=True),
        Field("p_brand", "brand"),
        Field("p_type", "part_type"),
    ),
)

DERIVED = (
    ("net_amount", "round(price * (1 - discount), 2)"),
    ("discount_amount", "round(price * discount, 2)"),
    ("tax_amount", "round(price * tax, 2)"),
    ("returned_amount", "case when return_flag = 'R' then net_amount else 0 end"),
)
GEOGRAPHY = (
    Join("orders", "order_key", "order_key", ("cust_key", "order_status", "priority")),
    Join("customer", "cust_key", "cust_key", ("nation_key", "segment", "customer_name")),
    Join("nation", "nation_key", "nation_key", ("region_key", "nation_name")),
    Join("region", "region_key", "region_key", ("region_name",)),
)
METRICS = (
    m.total("revenue", "net_amount"),
    m.total("gross", "price"),
    m.total("discounts", "discount_amount"),
    m.total("taxes", "tax_amount"),
    m.total("returned", "returned_amount"),
    m.total("units", "quantity"),
    m.row_count("line_count"),
    m.distinct_count("order_count", "order_key"),
    m.distinct_count(
        "returned_orders", "order_key", "return_flag = 'R'", ("return_flag",)
    ),
    m.difference("kept_revenue", ("net_amount",), ("returned_amount",)),
    m.ratio("net_rate", ("net_amount",), ("price",)),
    m.per_distinct("revenue_per_order", "net_amount", "order_key"),
    m.per_distinct(
        "revenue_per_returned_order",
        "net_amount",
        "order_key",
        "return_flag = 'R'",
        ("return_flag",),
    ),
    m.minimum("lowest_price", "price"),
    m.maximum("highest_price", "price"),
    m.average("mean_quantity", "quantity"),
    m.derived("deductions", add=("returned", "taxes")),
    m.derived("contribution", add=("revenue",), sub=("deductions",)),
    m.ratio(
        "contribution_rate",
        ("net_amount",),
        ("price",),
        over_minus=("returned_amount", "tax_amount"),
    ),
    m.expression(
        "large_line_share",
        "round(cast(sum(case when quantity > 25 and not return_flag in ('R') "
        "then coalesce(abs(-net_amount), 0) else 0 end) as double) "
        "/ nullif(cast(sum(net_amount) as double), 0), 4)",
        ("quantity", "return_flag", "net_amount"),
        ratio=False,
    ),
)
MONTH = Dimension("month", "ship_date", "time", "month")

SALES = ReportModel(
    "sales",
    (LINEITEM, ORDERS, CUSTOMER, NATION, REGION),
    Wide("sales_wide", "lineitem", GEOGRAPHY, DERIVED, drop=("supp_key",)),
    (
        MONTH,
        Dimension("week", "ship_date", "time", "week"),
        Dimension("quarter", "ship_date", "time", "quarter"),
        Dimension("year", "ship_date", "time", "year"),
        Dimension("region", "region_name"),
        Dimension("nation", "nation_name"),
        Dimension("segment", "segment"),
        Dimension("priority", "priority"),
        Dimension("customer", "customer_name"),
        Dimension("flag", "return_flag"),
    ),
    METRICS,
    (
        Report(
            "region_month",
            "region",
            ("revenue", "gross", "net_rate"),
            time_dim="month",
            filters=("segment", "nation"),
        ),
        Report("monthly_kpi", "month", ("revenue", "gross", "net_rate", "line_count")),
        Report(
            "full_months",
            "month",
            ("revenue", "line_count"),
            full_period_only=True,
        ),
        Report("region_week", "region", ("revenue",), time_dim="week"),
        Report("region_quarter", "region", ("revenue",), time_dim="quarter"),
        Report("region_year", "region", ("revenue",), time_dim="year"),
        Report("nation_orders", "nation", ("order_count", "line_count"), time_dim="year"),
        Report("nation_returns", "nation", ("order_count", "returned_orders"), filters=("segment",)),
        Report(
            "nation_per_order",
            "nation",
            ("revenue", "revenue_per_order", "revenue_per_returned_order"),
        ),
        Report("priority_kept", "priority", ("kept_revenue", "returned"), time_dim="month"),
        Report(
            "segment_prices",
            "segment",
            ("lowest_price", "highest_price", "mean_quantity"),
            time_dim="month",
        ),
        Report("flag_shares", "flag", ("revenue", "large_line_share"), time_dim="month"),
        Report("customer_rank", "customer", ("revenue", "units")),
        Report(
            "month_contribution", "month", ("deductions", "contribution", "contribution_rate")
        ),
    ),
)

LADDER = ReportModel(
    "ladder",
    (LINEITEM, PART),
    Wide(
        "parts_wide",
        "lineitem",
        (Join("part", "part_key", "part_key", ("brand", "part_type")),),
        DERIVED,
    ),
    (MONTH, Dimension("part", "part_key"), Dimension("brand", "brand")),
    METRICS,
    (
        Report(
            "part_month",
            "part",
            ("revenue", "discounts"),
            time_dim="month",
            rollup=("brand",),
        ),
        Report(
            "brand_month",
            "brand",
            ("revenue", "contribution", "contribution_rate"),
            time_dim="month",
            base="part_month",
        ),
        Report(
            "month_total",
            "month",
            ("deductions", "contribution", "contribution_rate"),
            base="brand_month",
        ),
    ),
)

# Orders are counted at every level: exactly by keys and by bitmaps, and by sketches.
ORDER_LADDER = ReportModel(
    "order_ladder",
    LADDER.sources.values(),
    LADDER.wide,
    tuple(LADDER.dimensions.values()),
    (
        *METRICS,
        m.distinct_count("order_numbers", "order_key", state="bitmap"),
        m.distinct_count("orders_about", "order_key", state="sketch"),
    ),
    (
        Report("part_orders", "part", ("revenue", "order_count"), time_dim="month", rollup=("brand",)),
        Report(
            "brand_orders",
            "brand",
            ("revenue", "order_count", "returned_orders"),
            time_dim="month",
            base="part_orders",
        ),
        Report(
            "month_orders",
            "month",
            ("order_count", "order_numbers", "returned_orders", "revenue", "orders_about"),
            base="brand_orders",
        ),
    ),
)

STATUS = ReportModel(
    "status",
    (LINEITEM,),
    Wide(
        "status_wide",
        "lineitem",
        derived=(
            ("open_gross", "case when line_status = 'O' then price else 0 end"),
            ("returned_units", "case when return_flag = 'R' then quantity else 0 end"),
        ),
    ),
    (MONTH, Dimension("status", "line_status")),
    (m.total("open_gross_total", "open_gross"), m.total("returned_unit_total", "returned_units")),
    (
        Report(
            "status_month",
            "status",
            ("open_gross_total", "returned_unit_total"),
            time_dim="month",
        ),
    ),
)

MODELS = {model.name: model for model in (SALES, LADDER, ORDER_LADDER, STATUS)}


# Declared rather than inferred, which saves a job per table before any query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def staged_table(spark: SparkSession, sf_dir: str, source: Source) -> DataFrame:
    return stage(select_declared(table(spark, sf_dir, source.name), source), source)


def staged_tables(spark: SparkSession, sf_dir: str, model: ReportModel) -> dict[str, DataFrame]:
    return {s.name: staged_table(spark, sf_dir, s) for s in model.sources.values()}


def wide_table(
    spark: SparkSession, sf_dir: str, model: ReportModel = SALES, key: str | None = None
) -> DataFrame:
    """The wide table, or with a report's key what that report needs of it."""
    wide = model.narrowed(key) if key else model.wide
    return widen(staged_tables(spark, sf_dir, model), wide)
