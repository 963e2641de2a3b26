"""Every operator as a query over the driver tables.

Each function takes (spark, sf_dir) and returns a DataFrame. Amounts leave as
doubles and dates as text, so that any engine's answer can be compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.functions.scalars import percent, ten_thousands
from reportloom.operators import cleaning, compare, contracts, governance, inclusion, periods
from reportloom.operators import problems, profiling, recon, report_query, staging, wide as wide_ops
from reportloom.operators.marts import build_mart, build_stack
from reportloom.operators.membership import STORED, membership
from reportloom.operators.report_query import json_safe, query_report
from reportloom.plans import batch
from reportloom.plans.feeds import EVENT_FEED, LINE_FEED, event_feed, line_feed
from reportloom.plans.trade import (
    CUSTOMER,
    LADDER,
    LINEITEM,
    ORDER_LADDER,
    ORDERS,
    SALES,
    STATUS,
    staged_table,
    staged_tables,
    table,
    wide_table,
)
from reportloom.sources.csv import choose_encoding, examine, scan_text_table, whole_rows
from reportloom.sources.discovery import discover, list_files
from reportloom.sources.layers import Layers, export_report, shared_folder
from reportloom.spec import Field, Join, Source, Wide
from reportloom.streaming.inbox import StreamedInbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(batch.QUERIES)
AS_OF = dt.date(1998, 6, 15)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- sources and sinks -------------------------------------------------------
@query
def discovered_row_counts(spark, sf_dir):
    """Feeds found by ordered file patterns, with the rows of the chosen files."""
    sources = [
        Source("orders", (), patterns=("orders_*.csv", "orders*.parquet")),
        Source("customer", (), patterns=("customer.parquet", "*.parquet")),
        Source("shipments", (), patterns=("shipments*.csv", "lineitem.*")),
        Source("returns", (), patterns=("returns_*.csv",)),
    ]
    found = discover(list_files(spark, sf_dir), sources).where("chosen")
    counts = [
        spark.read.parquet(hit["path"]).agg(
            F.lit(hit["source"]).alias("source"),
            F.lit(hit["file"]).alias("file"),
            F.count(F.lit(1)).alias("rows"),
        )
        for hit in found.collect()
    ]
    return reduce(DataFrame.unionByName, counts)


ORDER_FEED = Source(
    "order_feed",
    (
        Field("单据号", "order_key", "integer", required=True, unique=True),
        Field("状态", "status", required=True, enum=("F", "O", "P"), level="red"),
        Field("优先级", "priority"),
        Field("日期", "order_date", "date"),
        Field("金额", "amount", "decimal", range=(0, 400000), default=0),
    ),
)


@query
def csv_ingest(spark, sf_dir):
    """Orders dropped as CSV text, read back, cleaned, checked, stored and staged."""
    inbox = shared_folder(spark, "inbox")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("单据号"),
        F.concat(F.lit("　"), "o_orderstatus", F.lit(" ")).alias(" 状态"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("优先级 "),
        F.col("o_orderdate").cast("date").alias("日期"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")).alias(
            "金额"
        ),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(inbox)
    facts = examine(spark, inbox)
    encoding = choose_encoding(spark, inbox, ("utf-8-sig", "gbk"), facts)
    feed = whole_rows(scan_text_table(spark, inbox, encoding, facts.open_quotes))
    declared = cleaning.select_declared(cleaning.clean(feed, ORDER_FEED.clean), ORDER_FEED)
    layers = Layers(spark, shared_folder(spark, "layers"))
    raw = layers.replace(contracts.accept(declared, ORDER_FEED), "raw", ORDER_FEED.name)
    named = raw.where(F.col("_source_file").isNotNull() & F.col("_loaded_at").isNotNull())
    return json_safe(
        staging.stage(named, ORDER_FEED)
        .groupBy("status", "priority")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("amount").alias("amount"),
            F.min("order_date").alias("first_day"),
            F.max("order_date").alias("last_day"),
        )
    )


@query
def csv_quoted_breaks(spark, sf_dir):
    """Documents dropped as CSV text whose cells hold line ends and quotes, read back."""
    inbox = shared_folder(spark, "inbox")
    table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit('"'), F.coalesce("source", F.lit("")), F.lit('",\n'), F.coalesce("text", F.lit(""))).alias("note"),
        "lang",
    ).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(inbox)
    facts = examine(spark, inbox)
    feed = whole_rows(scan_text_table(spark, inbox, "UTF-8", facts.open_quotes))
    return feed.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        F.length("note").cast("bigint").alias("chars"),
        (F.size(F.split("note", "\n")).cast("bigint") - 1).alias("line_ends"),
        F.md5("note").alias("digest"),
    )


@query
def skip_first_rows(spark, sf_dir):
    """A table without its first hundred rows."""
    rest = cleaning.skip_first_rows(table(spark, sf_dir, "orders"), 100)
    return rest.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").cast("bigint").alias("key_sum")
    )


@query
def report_export(spark, sf_dir):
    """A queried report exported with a note and read back."""
    path = shared_folder(spark, "export")
    export_report(region_month_report(spark, sf_dir), path, note="last run was red")
    back = spark.read.option("header", True).csv(path)
    return back.select(
        "note",
        "month",
        "region",
        *[F.col(c).cast("double").alias(c) for c in ("revenue", "gross", "net_rate")],
    )


# -- cleaning and staging ----------------------------------------------------
@query
def clean_strip(spark, sf_dir):
    """Padded headers and cells cleaned, rows without a segment dropped."""
    untidy = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" key "),
        F.concat(F.lit("\t　"), "c_name", F.lit("  ")).alias("name  "),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" 　 "))
        .otherwise(F.concat(F.lit(" "), "c_mktsegment"))
        .alias("segment"),
    )
    steps = ("trim_columns", "strip_strings", {"drop_rows_if": {"col": "segment", "op": "is_null"}})
    return cleaning.clean(untidy, steps)


def declared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cleaning.clean(line_feed(spark, sf_dir), LINE_FEED.clean)
    return cleaning.select_declared(feed, LINE_FEED)


def declared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cleaning.clean(event_feed(spark, sf_dir), EVENT_FEED.clean)
    return cleaning.select_declared(feed, EVENT_FEED)


@query
def typed_staging(spark, sf_dir):
    """The untidy line feed after contract, typing, defaults and required filter."""
    accepted = contracts.accept(declared_lines(spark, sf_dir), LINE_FEED)
    return json_safe(
        staging.stage(accepted, LINE_FEED)
        .groupBy("entry_type")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("quantity").cast("bigint").alias("quantity"),
            F.sum("price").alias("price"),
            F.sum("discount").alias("discount"),
            F.min("ship_date").alias("first_day"),
            F.max("ship_date").alias("last_day"),
            F.count("price").alias("priced_rows"),
        )
    )


# -- contracts ---------------------------------------------------------------
def one_rule(source: Source, field: str, rule: str) -> Source:
    """A source whose only contract is one rule of one field."""
    f = source.field(field)
    bare = replace(f, required=False, unique=False, range=None, enum=None, format=None)
    kept = {
        "type": bare,
        "required": replace(bare, type="string", required=True),
        "unique": replace(bare, type="string", unique=True),
        "enum": replace(bare, type="string", enum=f.enum),
        "format": replace(bare, type="string", format=f.format),
        "range": replace(bare, range=f.range),
    }[rule]
    return replace(source, fields=(kept,))


def rule_query(field: str, rule: str) -> Query:
    def run(spark, sf_dir):
        found = contracts.violations(declared_lines(spark, sf_dir), one_rule(LINE_FEED, field, rule))
        return found.where(F.col("rule") == rule)

    return run


for _field, _rule in (
    ("quantity", "type"),
    ("doc_no", "required"),
    ("quantity", "range"),
    ("entry_type", "enum"),
    ("doc_no", "format"),
    ("line_key", "unique"),
):
    QUERIES[f"contract_{_rule}"] = rule_query(_field, _rule)


@query
def contract_ledger(spark, sf_dir):
    """All violations of two feeds, in the layout of the ledger."""
    found = contracts.violations(declared_lines(spark, sf_dir), LINE_FEED).unionByName(
        contracts.violations(declared_events(spark, sf_dir), EVENT_FEED)
    )
    return contracts.ledger_rows(found, "run-1").drop("ts")


@query
def stream_ledger(spark, sf_dir):
    """Violations of all events, dropped into an inbox in two halves and taken in by starts
    of a stream; the start in between finds nothing new."""
    source = replace(EVENT_FEED, patterns=("part-*.csv",))
    inbox = shared_folder(spark, "inbox")
    stream = StreamedInbox(spark, [source], inbox, shared_folder(spark, "stream"))
    events = event_feed(spark, sf_dir)
    for half in (0, 1):
        part = events.where(F.col("Event").cast("bigint") % 2 == half)
        part.write.mode("append").option("header", True).option("escape", '"').csv(inbox)
        stream.start()
        stream.start()
    return stream.ledger().select("batch_id", "source", "field", "rule", "level", "cnt", "sample")


@query
def staging_tests(spark, sf_dir):
    """Declared tests of the staged tables with their failures."""
    lines = staging.staging_tests(staged_table(spark, sf_dir, LINEITEM), LINEITEM)
    by_order = Source("lines_by_order", (Field("l_orderkey", "order_key", "integer", unique=True),))
    keys = staging.stage(
        cleaning.select_declared(table(spark, sf_dir, "lineitem"), by_order), by_order
    )
    return lines.unionByName(staging.staging_tests(keys, by_order))


def feed_statistics(declared: DataFrame, source: Source) -> DataFrame:
    return declared.agg(*contracts.row_statistics(source.fields)).withColumnRenamed(
        "rows", "raw_rows"
    )


def ratio_problem(rule: str) -> Query:
    def run(spark, sf_dir):
        statistics = feed_statistics(declared_lines(spark, sf_dir), LINE_FEED)
        return problems.table_problems(statistics, LINE_FEED).where(F.col("rule") == rule)

    return run


for _rule in ("row_drop_ratio", "type_coerce_ratio"):
    QUERIES[_rule] = ratio_problem(_rule)


@query
def empty_feeds(spark, sf_dir):
    """A feed without rows and a feed that keeps none."""
    events = declared_events(spark, sf_dir)
    none = events.where(F.col("amount").cast("double") < 0)
    useless = events.withColumn("user_id", F.nullif("user_id", "user_id"))
    parts = [
        problems.table_problems(feed_statistics(feed, EVENT_FEED), EVENT_FEED)
        for feed in (none, useless)
    ]
    return parts[0].unionByName(parts[1])


# -- wide table and match contracts ------------------------------------------
@query
def ledger_union(spark, sf_dir):
    """Orders, lines and events stacked into one ledger."""
    orders = staged_table(spark, sf_dir, ORDERS).select(
        "order_key",
        F.col("order_date").alias("doc_date"),
        F.col("cust_key").alias("party"),
        F.col("order_total").alias("amount"),
    )
    lines = staged_table(spark, sf_dir, LINEITEM).select(
        "order_key",
        "line_no",
        F.col("ship_date").alias("doc_date"),
        F.col("price").alias("amount"),
        "quantity",
    )
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("doc_date"),
        F.col("user_id").alias("party"),
        F.col("value").cast("decimal(18,4)").alias("amount"),
    )
    stacked = wide_ops.union_feeds(
        {"order": orders, "line": lines, "event": events},
        ("doc_date", "party", "amount", "quantity"),
        {"order": ("order_key",), "line": ("order_key", "line_no"), "event": ("event_id",)},
    )
    return json_safe(
        stacked.groupBy("entry_type", F.trunc("doc_date", "month").alias("month")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("amount").alias("amount"),
            F.count("party").alias("with_party"),
            F.sum("quantity").alias("quantity"),
            F.min("doc_no").alias("first_doc"),
            F.max("doc_no").alias("last_doc"),
        )
    )


def geography_totals(df: DataFrame) -> DataFrame:
    return json_safe(
        df.groupBy("nation_name", "region_name", "segment", "order_status").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("net_amount").alias("net_amount"),
            F.sum("discount_amount").alias("discount_amount"),
            F.sum("tax_amount").alias("tax_amount"),
            F.sum("returned_amount").alias("returned_amount"),
        )
    )


@query
def wide_left(spark, sf_dir):
    """The wide table by chained left joins with derived columns."""
    return geography_totals(wide_table(spark, sf_dir))


@query
def wide_spread(spark, sf_dir):
    """The same wide table with its first two joins salted against hot keys."""
    joins = tuple(
        replace(j, spread=4, spread_by=("line_no", "ship_date"))
        if j.table in ("orders", "customer")
        else j
        for j in SALES.wide.joins
    )
    tables = staged_tables(spark, sf_dir, SALES)
    return geography_totals(wide_ops.widen(tables, replace(SALES.wide, joins=joins)))


def building_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_table(spark, sf_dir, CUSTOMER).where(F.col("segment") == "BUILDING")


@query
def wide_how_kinds(spark, sf_dir):
    """Orders joined to the customers of one segment in all four ways."""
    orders = staged_table(spark, sf_dir, ORDERS)
    customers = building_customers(spark, sf_dir)
    parts = []
    for how in ("left", "inner", "right", "full"):
        join = Join("customer", "cust_key", "cust_key", ("segment", "customer_name"), how=how)
        parts.append(
            wide_ops.attach(orders, customers, join).agg(
                F.lit(how).alias("how"),
                F.count(F.lit(1)).alias("rows"),
                F.count("order_key").alias("with_order"),
                F.count("customer_name").alias("with_customer"),
                F.sum("order_total").alias("order_total"),
            )
        )
    return json_safe(reduce(DataFrame.unionByName, parts))


@query
def match_fanout(spark, sf_dir):
    """Order keys that would multiply rows if lines were joined as a dimension."""
    keys = wide_ops.fanout_keys(staged_table(spark, sf_dir, LINEITEM), "order_key")
    return keys.select("order_key", F.col("__n").alias("n"))


@query
def match_null(spark, sf_dir):
    """Customer keys of orders that are unknown in a one-segment dimension."""
    return wide_ops.unmatched_keys(
        staged_table(spark, sf_dir, ORDERS),
        "cust_key",
        building_customers(spark, sf_dir),
        "cust_key",
    )


@query
def match_orphan(spark, sf_dir):
    """Orders that no line refers to."""
    return wide_ops.orphan_keys(
        staged_table(spark, sf_dir, ORDERS),
        "order_key",
        staged_table(spark, sf_dir, LINEITEM),
        "order_key",
    )


BROKEN_WIDE = Wide(
    "broken_wide",
    "orders",
    (
        Join("lineitem", "order_key", "order_key", ("quantity",), fanout="yellow"),
        Join(
            "customer",
            "cust_key",
            "cust_key",
            ("segment",),
            null_match="red",
            orphan_right="yellow",
        ),
    ),
)


@query
def match_contracts(spark, sf_dir):
    """Ledger rows of a wide table that breaks several match contracts."""
    tables = {
        "orders": staged_table(spark, sf_dir, ORDERS),
        "lineitem": staged_table(spark, sf_dir, LINEITEM),
        "customer": building_customers(spark, sf_dir),
    }
    found = wide_ops.match_violations(wide_ops.widen(tables, BROKEN_WIDE), tables, BROKEN_WIDE)
    return contracts.ledger_rows(found, "run-1").drop("ts")


# -- reports -----------------------------------------------------------------
def sales_mart(spark: SparkSession, sf_dir: str, key: str, as_of=None) -> DataFrame:
    return build_mart(SALES, key, wide_table(spark, sf_dir, SALES, key), as_of)


def sales_report(key: str, as_of=None, **options) -> Query:
    def run(spark, sf_dir):
        mart = sales_mart(spark, sf_dir, key, as_of)
        return json_safe(query_report(SALES, key, mart, **options))

    return run


QUERIES |= {
    "region_month_report": sales_report("region_month"),
    "monthly_kpi_report": sales_report("monthly_kpi"),
    "full_period_only": sales_report("full_months", as_of=AS_OF),
    "limit_clamped": sales_report("region_month", limit=0),
    "grain_week": sales_report("region_week"),
    "grain_quarter": sales_report("region_quarter"),
    "grain_year": sales_report("region_year"),
    "mart_count_distinct": sales_report("nation_orders"),
    "mart_cond_distinct": sales_report("nation_returns"),
    "mart_ratio_distinct": sales_report("nation_per_order"),
    "mart_diff": sales_report("priority_kept"),
    "mart_minmaxavg": sales_report("segment_prices"),
    "mart_expression": sales_report("flag_shares"),
    "derive_ladder": sales_report("month_contribution"),
}
region_month_report = QUERIES["region_month_report"]


@query
def mart_cond_sum(spark, sf_dir):
    """Conditional sums through derived columns."""
    df = wide_ops.widen({"lineitem": staged_table(spark, sf_dir, LINEITEM)}, STATUS.wide)
    return json_safe(build_mart(STATUS, "status_month", df))


def ladder_layer(key: str) -> Query:
    def run(spark, sf_dir):
        return json_safe(build_stack(LADDER, key, wide_table(spark, sf_dir, LADDER, key)))

    return run


QUERIES |= {
    "layer_l1": ladder_layer("part_month"),
    "layer_l2": ladder_layer("brand_month"),
    "layer_l3": ladder_layer("month_total"),
}


@query
def layer_distinct(spark, sf_dir):
    """Distinct orders in the third layer of a report, from the states of those below."""
    wide = wide_table(spark, sf_dir, ORDER_LADDER)
    top = build_stack(ORDER_LADDER, "month_orders", wide)
    # An estimate differs between engines; it is shown only as near or not.
    near = F.abs(F.col("orders_about") - F.col("order_count")) <= 0.1 * F.col("order_count")
    return json_safe(top.withColumn("near", near).drop("orders_about"))


@query
def layer_recon(spark, sf_dir):
    """Differences between a tampered brand report and the part report below it."""
    parent = build_stack(LADDER, "part_month", wide_table(spark, sf_dir, LADDER))
    child = build_mart(LADDER, "brand_month", parent)
    tampered = child.withColumn(
        "revenue",
        F.when(F.col("brand") == "Brand#7", F.col("revenue") + 1).otherwise(F.col("revenue")),
    ).where(F.col("brand") != "Brand#9")
    return json_safe(recon.reconcile(LADDER, "brand_month", parent, tampered))


@query
def conserve_total(spark, sf_dir):
    """Totals of the top layer against the wide table."""
    df = wide_table(spark, sf_dir, LADDER)
    return recon.conserve_totals(LADDER, "month_total", build_stack(LADDER, "month_total", df), df)


# -- report queries ----------------------------------------------------------
def filtered(filters: dict, key: str = "region_month") -> Query:
    def run(spark, sf_dir):
        df = wide_table(spark, sf_dir)
        mart = build_mart(SALES, key, df)
        return json_safe(query_report(SALES, key, mart, df, filters))

    return run


QUERIES |= {
    "filter_own_dim": filtered({"region": "ASIA"}),
    "filter_period": filtered({"month": "1998-03-01"}),
    "filter_group_membership": filtered({"nation": "NATION_3"}),
    "filter_bad_value": filtered({"region": "ATLANTIS' or 1=1", "segment": "NONE"}),
}


@query
def filter_options(spark, sf_dir):
    df = wide_table(spark, sf_dir)
    mart = build_mart(SALES, "region_month", df)
    return report_query.filter_options(SALES, "region_month", mart, df)


@query
def filter_stored_pairs(spark, sf_dir):
    """A report and the pairs of its groups and filter values, stored, and answered by two
    filters that the report does not show; the wide table is read only to store them."""
    df = wide_table(spark, sf_dir)
    layers = Layers(spark, shared_folder(spark, "pairs"))
    mart = layers.replace(build_mart(SALES, "region_month", df), "marts", "region_month")
    pairs = layers.replace(
        membership(SALES, "region_month", df), "marts", STORED.format("region_month")
    )
    filters = {"nation": "NATION_3", "segment": "BUILDING"}
    return json_safe(query_report(SALES, "region_month", mart, filters=filters, members=pairs))


@query
def all_options(spark, sf_dir):
    """Options of three reports merged."""
    df = wide_table(spark, sf_dir)
    keys = ("region_month", "nation_returns", "segment_prices")
    return report_query.all_options(
        [report_query.filter_options(SALES, k, build_mart(SALES, k, df), df) for k in keys]
    )


@query
def slice_segment(spark, sf_dir):
    """A report over a slice of the wide table: figures of one segment only."""
    part = wide_table(spark, sf_dir).where(F.col("segment") == "BUILDING")
    return json_safe(query_report(SALES, "region_month", build_mart(SALES, "region_month", part)))


# The regions that the chart declares.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query
def pivot_month_region(spark, sf_dir):
    """Revenue per month, a column per declared region."""
    mart = sales_mart(spark, sf_dir, "region_month")
    return json_safe(report_query.pivot_report(mart, "month", "region", "revenue", list(REGIONS)))


@query
def display_scale(spark, sf_dir):
    """Figures as shown on a chart: tens of thousands and percent."""
    mart = sales_mart(spark, sf_dir, "region_month")
    return json_safe(
        mart.select(
            "month",
            "region",
            ten_thousands(F.col("revenue")).alias("revenue_10k"),
            percent(F.col("net_rate")).alias("net_percent"),
        )
    )


# -- periods -----------------------------------------------------------------
@query
def latest_previous(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "monthly_kpi")
    cards = {"revenue": False, "line_count": False, "net_rate": True}
    return json_safe(periods.latest_and_previous(mart, "month", cards))


@query
def period_over_period(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "region_month")
    changes = {"revenue": False, "net_rate": True}
    return json_safe(periods.period_over_period(mart, "month", ["region"], changes))


@query
def period_over_period_rollup(spark, sf_dir):
    """Change per month of a report with several dimensions."""
    mart = build_stack(LADDER, "part_month", wide_table(spark, sf_dir, LADDER))
    dims = [d for d in LADDER.group_dims("part_month") if d != "month"]
    return json_safe(periods.period_over_period(mart, "month", dims, {"revenue": False}))


@query
def topn_customers(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "customer_rank")
    return json_safe(periods.top_rows(mart, "revenue", ["customer"]))


# -- scalar functions --------------------------------------------------------
@query
def scalar_functions(spark, sf_dir):
    """The expression vocabulary as derived columns over all lines."""
    derived = (
        ("r", "round(price * discount, 1)"),
        ("n", "nullif(line_status, 'F')"),
        ("c", "coalesce(nullif(tax, 0), 0.01)"),
        ("k", "cast(quantity as bigint)"),
        ("q", "cast(date_trunc('quarter', ship_date) as date)"),
        ("a", "abs(price - 50000)"),
        ("w", "case when quantity < 10 then 'few' when quantity >= 40 then 'many' else 'some' end"),
        (
            "b",
            "return_flag in ('A', 'R') and not (tax = 0 or discount > 0.05) and true "
            "or (quantity <= 2 and false)",
        ),
        ("t", "trim(cast(order_key as string))"),
        ("u", "-price + price / 4"),
    )
    df = wide_ops.widen(
        {"lineitem": staged_table(spark, sf_dir, LINEITEM)},
        Wide("scalars", "lineitem", derived=derived),
    )
    return json_safe(
        df.groupBy("w", "q").agg(
            F.sum("r").alias("r"),
            F.count("n").alias("n"),
            F.sum("c").alias("c"),
            F.sum("k").alias("k"),
            F.sum("a").alias("a"),
            F.count_if("b").alias("b"),
            F.max("t").alias("t"),
            F.sum(F.col("u").cast("decimal(18,6)")).alias("u"),
        )
    )


# -- governance --------------------------------------------------------------
def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after two runs: the events first, then the lines."""
    events = contracts.violations(declared_events(spark, sf_dir), EVENT_FEED)
    lines = contracts.violations(declared_lines(spark, sf_dir), LINE_FEED)
    return contracts.ledger_rows(events, "run-1").unionByName(
        contracts.ledger_rows(lines, "run-2")
    )


@query
def pending_queue(spark, sf_dir):
    return governance.pending_queue(two_runs(spark, sf_dir))


@query
def severity_summary(spark, sf_dir):
    return governance.severity_summary(two_runs(spark, sf_dir))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as nodes of runs, one run per user."""
    length = (F.round(F.col("value") * 100).cast("bigint") * 10).alias("ms")
    status = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), "error")
        .when((F.col("event_type") == "signup") & (F.col("value") > 120), "warn")
        .otherwise("success")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("node"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        F.timestamp_add("MILLISECOND", length, F.col("ts")).alias("ended_at"),
    )


@query
def traffic_light(spark, sf_dir):
    return governance.traffic_light(event_nodes(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return governance.status_counts(event_nodes(spark, sf_dir))


@query
def run_timeline(spark, sf_dir):
    return governance.run_timeline(event_nodes(spark, sf_dir))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as runs, one instance per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instance"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.when(F.col("value") > 40, "red").otherwise("green").alias("status"),
    )


@query
def run_history(spark, sf_dir):
    kept = governance.run_history(event_runs(spark, sf_dir))
    return kept.select("instance", "run_id", "status", "place")


@query
def stale_instances(spark, sf_dir):
    return governance.stale_instances(event_runs(spark, sf_dir))


@query
def missing_sources(spark, sf_dir):
    """Declared feeds (event types) for which nothing large was found."""
    events = table(spark, sf_dir, "events")
    declared = events.select(F.col("event_type").alias("source")).distinct()
    found = events.where(F.col("value") > 365).select(F.col("event_type").alias("source"))
    return governance.missing_sources(declared, found)


# -- profiling ---------------------------------------------------------------
def flat_profile(profiles: DataFrame) -> DataFrame:
    """Lists as text, for comparison."""
    return profiles.withColumns(
        {
            "samples": F.array_join("samples", "|"),
            "likely_enum": F.array_join("likely_enum", "|"),
        }
    )


@query
def profile_columns(spark, sf_dir):
    names = ("customer", "orders", "part", "events")
    tables = {n: table(spark, sf_dir, n) for n in names}
    return flat_profile(profiling.profile_tables(tables))


@query
def infer_types(spark, sf_dir):
    """Types and enums found in the untidy line feed, where everything is text."""
    return flat_profile(profiling.profile(declared_lines(spark, sf_dir)))


def named_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = staged_tables(spark, sf_dir, SALES)
    tables["sales_lines"] = tables.pop("lineitem")
    return tables


@query
def join_suggest(spark, sf_dir):
    tables = named_tables(spark, sf_dir)
    entities = profiling.guess_entities(profiling.table_sizes(tables))
    return profiling.suggest_joins(profiling.profile_tables(tables), entities)


KEY_COLUMNS = (
    ("sales_lines", "order_key"),
    ("sales_lines", "part_key"),
    ("orders", "order_key"),
    ("orders", "cust_key"),
    ("customer", "cust_key"),
    ("customer", "nation_key"),
    ("nation", "nation_key"),
    ("nation", "region_key"),
    ("region", "region_key"),
)


@query
def key_inclusions(spark, sf_dir):
    """How far the values of each key column are contained in each other one."""
    return inclusion.inclusions(named_tables(spark, sf_dir), KEY_COLUMNS)


@query
def join_containment(spark, sf_dir):
    """Suggested joins with the share of the fact's keys that the dimension has."""
    found = inclusion.inclusions(named_tables(spark, sf_dir), KEY_COLUMNS)
    return inclusion.with_containment(join_suggest(spark, sf_dir), found)


@query
def guess_entities(spark, sf_dir):
    return profiling.guess_entities(profiling.table_sizes(named_tables(spark, sf_dir)))


@query
def profile_summary(spark, sf_dir):
    names = ("region", "nation", "supplier", "customer")
    sizes = profiling.table_sizes({n: table(spark, sf_dir, n) for n in names})
    return profiling.profile_summary(profiling.guess_entities(sizes))


# -- comparison --------------------------------------------------------------
@query
def diff_keyed(spark, sf_dir):
    """A report against a copy with one kind of damage per region and year."""
    expected = sales_mart(spark, sf_dir, "region_month").select(
        "month", "region", "revenue", "net_rate"
    )
    year, region = F.year("month"), F.col("region")
    damaged = expected.select(
        "month",
        "region",
        F.when((region == "AMERICA") & (year == 1997), None)
        .when((region == "AMERICA") & (year == 1996), F.col("revenue") + 0.5)
        .otherwise(F.col("revenue"))
        .alias("revenue"),
        F.when((region == "AMERICA") & (year == 1995), F.col("net_rate") * 100)
        .otherwise(F.col("net_rate"))
        .alias("net_rate"),
    )
    kept = damaged.where(~((region == "ASIA") & (year == 1998)))
    strange = damaged.where((region == "AFRICA") & (year == 1999)).withColumn(
        "region", F.lit(None).cast("string")
    )
    twice = damaged.where((region == "EUROPE") & (year == 2000))
    keys = ["month", "region"]
    actual = kept.unionByName(strange).unionByName(twice).withColumn("note", F.lit(1))
    # One expected key occurs twice, and a metric is missing from the answer.
    expected = expected.unionByName(expected.where((region == "ASIA") & (year == 1997)))
    expected = expected.withColumn("gross", F.col("revenue"))
    found = compare.keyed_diff(
        compare.month_keys(expected, keys), compare.month_keys(actual, keys), keys, ("net_rate",)
    )
    return found.withColumns({c: F.col(c).cast("double") for c in ("expected", "actual")})


@query
def diff_multiset(spark, sf_dir):
    """Line keys that occur more than once, found by comparing with distinct keys."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return compare.multiset_diff(keys, keys.distinct())


@query
def diff_pruned(spark, sf_dir):
    """Lines against a copy with another quantity in every order that ends with 777, by
    the buckets of rows that differ."""
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(*names)
    changed = F.col("l_orderkey") % 1000 == 777
    quantity = F.when(changed, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    copy = lines.withColumn("l_quantity", quantity.cast(lines.schema["l_quantity"].dataType))
    return compare.multiset_diff(*compare.pruned(lines, copy))
