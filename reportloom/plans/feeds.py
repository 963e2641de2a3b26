"""Untidy text feeds derived from whole driver tables.

The tables themselves are clean, so these projections write their rows the way a
file drop would: everything is text, and values that meet a condition are missing,
padded, mistyped or out of range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.plans.trade import table
from reportloom.spec import Field, Source

LINE_FEED = Source(
    "line_feed",
    (
        Field("Line", "line_key", unique=True),
        Field("Document", "doc_no", required=True, format=r"L\d+"),
        Field("Entry", "entry_type", enum=("A", "N", "R")),
        Field("Shipped", "ship_date", "date", required=True),
        Field("Quantity", "quantity", "integer", range=(1, 40)),
        Field("Price", "price", "decimal", level="pending"),
        Field("Discount", "discount", "decimal", range=(0, 0.09), default=0),
    ),
    problems={
        "row_drop_ratio": {"max": 0.005, "level": "yellow"},
        "type_coerce_ratio": {"max": 0.03, "level": "red"},
    },
)

EVENT_FEED = Source(
    "event_feed",
    (
        Field("Event", "event_id", "integer", required=True, unique=True),
        Field("User", "user_id", "integer", required=True),
        Field("Kind", "event_type", enum=("click", "view", "purchase"), level="red"),
        Field("Amount", "amount", "decimal", range=(0, 150)),
        Field("Properties", "props", format=r'\{"k": [1-9]'),
    ),
    problems={"empty_file": "yellow", "empty_after_clean": "yellow"},
)

# The line feed as one SQL projection of `lineitem`.
LINE_COLUMNS = {
    "Line": "concat(l_orderkey, '-', l_linenumber)",
    "Document": """case when l_tax = 0.08 and l_linenumber = 7 then null
        when l_tax = 0.0 and l_linenumber = 1 then concat('X', l_orderkey)
        else concat('L', l_orderkey) end""",
    "Entry": """case when l_quantity = 50 then ' Z'
        else concat('  ', l_returnflag, '\u3000') end""",
    "Shipped": """case when l_linenumber = 6 and l_tax = 0.04 then 'soon'
        when l_linenumber = 5 then {slashed}
        else cast(cast(l_shipdate as date) as string) end""",
    "Quantity": """case when l_discount = 0.1 and l_tax = 0.0 then 'N/A'
        when l_discount = 0.1 then concat(cast(l_quantity as int), '.5')
        else cast(cast(l_quantity as int) as string) end""",
    "Price": """case when l_quantity = 1 then concat('$', cast(l_extendedprice as decimal(18,2)))
        else cast(cast(l_extendedprice as decimal(18,2)) as string) end""",
    "Discount": """case when l_discount = 0.0 then ''
        else cast(cast(l_discount as decimal(4,2)) as string) end""",
}


def line_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slashed = "date_format(l_shipdate, 'yyyy/M/d')"
    return table(spark, sf_dir, "lineitem").select(
        *[
            F.expr(text.replace("{slashed}", slashed)).alias(f" {name} ")
            for name, text in LINE_COLUMNS.items()
        ]
    )


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("Event"),
        F.col("user_id").cast("string").alias("User"),
        F.col("event_type").alias("Kind"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("Amount"),
        F.col("props").alias("Properties"),
    )
