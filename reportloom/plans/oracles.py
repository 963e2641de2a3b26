"""DuckDB statements that give the same answers as the catalogue's queries.

They are written from the meaning of each query, with whole tables as input.
"""

from __future__ import annotations

from reportloom.plans import batch

WHITE = "' ' || chr(9) || chr(12288)"

LINES = """lines AS (
  SELECT l_orderkey AS order_key, l_partkey AS part_key, l_linenumber AS line_no,
    CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS price,
    COALESCE(CAST(l_discount AS DECIMAL(18,4)), 0) AS discount,
    CAST(l_tax AS DECIMAL(18,4)) AS tax, trim(l_returnflag) AS return_flag,
    trim(l_linestatus) AS line_status, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL)"""

AMOUNTS = f"""{LINES}, amounts AS (
  SELECT *, CASE WHEN return_flag = 'R' THEN net_amount ELSE 0 END AS returned_amount
  FROM (SELECT *, round(price * (1 - discount), 2) AS net_amount,
      round(price * discount, 2) AS discount_amount, round(price * tax, 2) AS tax_amount
    FROM lines))"""

WIDE = f"""{AMOUNTS}, wide AS (
  SELECT a.*, date_trunc('month', ship_date) AS m, o_orderstatus AS order_status,
    o_orderpriority AS priority, c_mktsegment AS segment, c_name AS customer,
    n_name AS nation, r_name AS region
  FROM amounts a
  LEFT JOIN orders ON order_key = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

PARTS = f"""{AMOUNTS}, wide AS (
  SELECT a.*, date_trunc('month', ship_date) AS m, p_brand AS brand
  FROM amounts a LEFT JOIN part ON part_key = p_partkey)"""

FEED = f"""dirty AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS line_key,
    CASE WHEN l_tax = 0.08 AND l_linenumber = 7 THEN NULL
      WHEN l_tax = 0.0 AND l_linenumber = 1 THEN concat('X', l_orderkey)
      ELSE concat('L', l_orderkey) END AS doc_no,
    CASE WHEN l_quantity = 50 THEN ' Z'
      ELSE concat('  ', l_returnflag, chr(12288)) END AS entry_type,
    CASE WHEN l_linenumber = 6 AND l_tax = 0.04 THEN 'soon'
      WHEN l_linenumber = 5 THEN strftime(l_shipdate, '%Y/%-m/%-d')
      ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS ship_date,
    CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN 'N/A'
      WHEN l_discount = 0.1 THEN concat(CAST(l_quantity AS INT), '.5')
      ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity,
    CASE WHEN l_quantity = 1 THEN concat('$', CAST(l_extendedprice AS DECIMAL(18,2)))
      ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    CASE WHEN l_discount = 0.0 THEN ''
      ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) END AS discount
  FROM lineitem),
feed AS (
  SELECT line_key, doc_no, NULLIF(trim(entry_type, {WHITE}), '') AS entry_type, ship_date,
    quantity, price, NULLIF(discount, '') AS discount FROM dirty),
events_feed AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
    CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount, props FROM events)"""

DATE_TEXT = "TRY_CAST(replace({c}, '/', '-') AS DATE)"
NUMBER_TEXT = "TRY_CAST({c} AS DECIMAL(38,18))"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def ratio(top: str, bottom: str, digits: int = 4) -> str:
    return f"round(CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0), {digits})"


def amount(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


NET_RATE = ratio("sum(net_amount)", "sum(price)")

# The sales report per month and region, before order and limit.
REGION_MONTH = f"""{WIDE}, report AS (
  SELECT {day('m')} AS month, region, {amount('sum(net_amount)')} AS revenue,
    {amount('sum(price)')} AS gross, {NET_RATE} AS net_rate
  FROM wide GROUP BY m, region)"""


def newest_first(select: str, time: str, second: str, limit: int | None = None) -> str:
    page = f" LIMIT {limit}" if limit else ""
    return f"{select} ORDER BY {time} DESC NULLS LAST, {second} ASC NULLS LAST{page}"


REGION_MONTH_REPORT = newest_first(
    f"WITH {REGION_MONTH} SELECT * FROM report", "month", "region"
)


# -- contracts ---------------------------------------------------------------
def broken_rows(
    feed: str, source: str, field: str, rule: str, level: str, condition: str, keep: int = 3
) -> str:
    sample = (
        "'empty in a required column, rows dropped'"
        if rule == "required"
        else f"array_to_string(list_slice(list_sort(list(DISTINCT {field})), 1, {keep}), ', ')"
    )
    return (
        f"SELECT '{source}' AS source, '{field}' AS field, '{rule}' AS rule, "
        f"'{level}' AS level, count(*) AS cnt, {sample} AS sample "
        f"FROM {feed} WHERE {condition} HAVING count(*) > 0"
    )


def repeated(feed: str, source: str, field: str) -> str:
    return (
        f"SELECT '{source}' AS source, '{field}' AS field, 'unique' AS rule, 'red' AS level, "
        f"CAST(sum(n) AS BIGINT) AS cnt, "
        f"array_to_string(list_slice(list_sort(list(v)), 1, 3), ', ') AS sample "
        f"FROM (SELECT {field} AS v, count(*) AS n FROM {feed} GROUP BY 1 HAVING count(*) > 1) "
        f"HAVING sum(n) > 0"
    )


def line_rule(field: str, rule: str, condition: str, level: str = "yellow", keep: int = 3) -> str:
    return broken_rows("feed", "line_feed", field, rule, level, condition, keep)


def unparsed(field: str, kind: str) -> str:
    parsed = (DATE_TEXT if kind == "date" else NUMBER_TEXT).format(c=field)
    return f"{field} IS NOT NULL AND {parsed} IS NULL"


def outside(field: str, low: float, high: float) -> str:
    return f"{NUMBER_TEXT.format(c=field)} NOT BETWEEN {low} AND {high}"


LINE_RULES = {
    "contract_type": line_rule("quantity", "type", unparsed("quantity", "number")),
    "contract_required": line_rule("doc_no", "required", "doc_no IS NULL"),
    "contract_range": line_rule("quantity", "range", outside("quantity", 1, 40)),
    "contract_enum": line_rule(
        "entry_type", "enum", "entry_type NOT IN ('A', 'N', 'R')", keep=5
    ),
    "contract_format": line_rule(
        "doc_no", "format", "NOT regexp_matches(doc_no, '^(?:L\\d+)')"
    ),
    "contract_unique": repeated("feed", "line_feed", "line_key"),
}
ALL_LINE_RULES = [
    *LINE_RULES.values(),
    line_rule("ship_date", "type", unparsed("ship_date", "date")),
    line_rule("price", "type", unparsed("price", "number"), "pending"),
    line_rule("discount", "range", outside("discount", 0, 0.09)),
]


def event_rules(table: str) -> list[str]:
    rules = (
        ("event_type", "enum", "red", "event_type NOT IN ('click', 'view', 'purchase')", 5),
        ("amount", "range", "yellow", outside("amount", 0, 150), 3),
        ("props", "format", "yellow", """NOT regexp_matches(props, '^(?:\\{"k": [1-9])')""", 3),
    )
    return [broken_rows(table, "event_feed", *rule) for rule in rules]


ALL_EVENT_RULES = event_rules("events_feed")
LEDGER_COLUMNS = "source, field, rule, level, cnt, sample"


def stacked(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def ledger(run: str, parts: list[str]) -> str:
    return f"SELECT '{run}' AS run_id, {LEDGER_COLUMNS} FROM ({stacked(parts)})"


TWO_RUNS = f"""{FEED}, ledger AS (
  {ledger('run-1', ALL_EVENT_RULES)} UNION ALL {ledger('run-2', ALL_LINE_RULES)})"""


def feed_problem(rule: str, level: str, dropped: str, limit: float) -> str:
    return f"""WITH {FEED}, s AS (
      SELECT count(*) AS n, count_if({dropped}) AS d FROM feed)
    SELECT 'line_feed' AS source, '-' AS field, '{rule}' AS rule, '{level}' AS level,
      CAST(0 AS BIGINT) AS cnt, concat(d, ' of ', n) AS sample
    FROM s WHERE d / n > {limit}"""


LINE_TEST_COUNTS = {
    ("lineitem", "order_key", "not_null", "error"): "order_key IS NULL",
    ("lineitem", "quantity", "range", "warn"): "quantity < 1 OR quantity > 40",
    ("lineitem", "return_flag", "accepted_values", "warn"): "return_flag NOT IN ('A', 'N')",
    ("lineitem", "ship_date", "not_null", "error"): "ship_date IS NULL",
}


# -- profiles ----------------------------------------------------------------
def column_profile(relation: str, column: str, table: str | None = None) -> str:
    """Profile of one column, written column by column."""
    named = f"'{table}' AS table_name, " if table else ""
    number = NUMBER_TEXT.format(c="replace(v, ',', '')")
    date = (
        r"CASE WHEN regexp_matches(v, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}') THEN "
        + DATE_TEXT.format(c="v")
        + " END"
    )
    return f"""SELECT {named}'{column}' AS column_name, type, rows,
      round(CAST(rows - nn AS DOUBLE) / rows * 100, 1) AS null_pct, distinct_count,
      distinct_count = nn AND nn > 0 AND (type <> 'string' OR nn >= 3) AS likely_key,
      array_to_string([v[:30] for v in list_slice(vals, 1, 3)], '|') AS samples,
      CASE WHEN type = 'string' AND distinct_count BETWEEN 1 AND 12
        THEN array_to_string(vals, '|') END AS likely_enum,
      CASE WHEN type = 'decimal' THEN round(CAST(low AS DOUBLE), 4) END AS min_value,
      CASE WHEN type = 'decimal' THEN round(CAST(high AS DOUBLE), 4) END AS max_value
    FROM (SELECT *, CASE WHEN numbers / nn > 0.9 THEN 'decimal'
        WHEN dates / nn > 0.9 THEN 'date' ELSE 'string' END AS type
      FROM (SELECT count(*) AS rows, count(v) AS nn, count(DISTINCT v) AS distinct_count,
          count({number}) AS numbers, count({date}) AS dates, min({number}) AS low,
          max({number}) AS high, list_sort(list(DISTINCT v)) AS vals
        FROM (SELECT NULLIF(trim(CAST("{column}" AS VARCHAR)), '') AS v FROM {relation})))"""


PROFILED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": (
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    ),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
FEED_COLUMNS = (
    "line_key",
    "doc_no",
    "entry_type",
    "ship_date",
    "quantity",
    "price",
    "discount",
)

NODES = """nodes AS (
  SELECT user_id AS run_id, event_id AS node,
    CASE WHEN event_type = 'error' AND value > 150 THEN 'error'
      WHEN event_type = 'signup' AND value > 120 THEN 'warn' ELSE 'success' END AS status,
    ts AS started_at,
    ts + to_milliseconds(CAST(round(value * 100) AS BIGINT) * 10) AS ended_at
  FROM events)"""
RUNS = """runs AS (
  SELECT event_type AS instance, event_id AS run_id, ts AS started_at,
    CASE WHEN value > 40 THEN 'red' ELSE 'green' END AS status,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place
  FROM events)"""


def seconds(start: str, end: str) -> str:
    micros = f"greatest(date_diff('microsecond', {start}, {end}), 0)"
    return f"CAST(({micros} + 500) // 1000 AS DOUBLE) / 1000.0"


def ladder(dims: str, metrics: str, groups: str) -> str:
    return f"WITH {PARTS} SELECT {dims}, {metrics} FROM wide GROUP BY {groups}"


CARRIED = ", ".join(
    f"{amount(f'sum({c})')} AS {c}"
    for c in ("net_amount", "price", "returned_amount", "tax_amount")
)
DEDUCTIONS = amount("sum(returned_amount) + sum(tax_amount)")
CONTRIBUTION = amount("sum(net_amount) - (sum(returned_amount) + sum(tax_amount))")
CONTRIBUTION_RATE = ratio(
    "sum(net_amount) - sum(returned_amount) - sum(tax_amount)", "sum(price)"
)
TOTALS = (
    "CAST(count(*) AS BIGINT) AS rows, "
    + ", ".join(
        f"{amount(f'sum({c})')} AS {c}"
        for c in ("net_amount", "discount_amount", "tax_amount", "returned_amount")
    )
)
GEOGRAPHY_TOTALS = f"""WITH {WIDE}
  SELECT nation AS nation_name, region AS region_name, segment, order_status, {TOTALS}
  FROM wide GROUP BY ALL"""

JOIN_KINDS = "WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') " + " UNION ALL ".join(
    f"""SELECT '{how}' AS how, count(*) AS rows, count(o_orderkey) AS with_order,
      count(c_name) AS with_customer,
      {amount('sum(CAST(o_totalprice AS DECIMAL(18,4)))')} AS order_total
    FROM orders {how} JOIN c ON o_custkey = c_custkey"""
    for how in ("left", "inner", "right", "full")
)

MATCH_PARTS = [
    """SELECT 'broken_wide' AS source, 'order_key' AS field, 'fanout' AS rule,
      'yellow' AS level, count(*) AS cnt,
      concat('lineitem: ', count(*), ' keys, first ', min(k)) AS sample
    FROM (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
    """SELECT 'broken_wide', 'order_key', 'null_match', 'yellow', count(*),
      concat('lineitem: ', count(*), ' keys, first ', min(CAST(o_orderkey AS VARCHAR)))
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    """SELECT 'broken_wide', 'cust_key', 'null_match', 'red', count(*),
      concat('customer: ', count(*), ' keys, first ', min(CAST(k AS VARCHAR)))
    FROM (SELECT DISTINCT o_custkey AS k FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""",
    """SELECT 'broken_wide', 'cust_key', 'orphan_right', 'yellow', count(*),
      concat('customer: ', count(*), ' keys, first ', min(CAST(c_custkey AS VARCHAR)))
    FROM customer WHERE c_mktsegment = 'BUILDING'
      AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
]

DAMAGE = f"""{REGION_MONTH}, e AS (
  SELECT month[:7] AS month, region, revenue, net_rate, CAST(month[:4] AS INT) AS y FROM report),
d AS (
  SELECT month, region, y,
    CASE WHEN region = 'AMERICA' AND y = 1997 THEN NULL
      WHEN region = 'AMERICA' AND y = 1996 THEN revenue + 0.5 ELSE revenue END AS revenue,
    CASE WHEN region = 'AMERICA' AND y = 1995 THEN net_rate * 100 ELSE net_rate END AS net_rate
  FROM e)"""
KEYED_DIFF = f"""WITH {DAMAGE}
  SELECT month, region, 'missing_key' AS kind, '-' AS "column", NULL::DOUBLE AS expected,
    NULL::DOUBLE AS actual, NULL::DOUBLE AS diff FROM e WHERE region = 'ASIA' AND y = 1998
  UNION ALL SELECT month, NULL, 'extra_key', '-', NULL, NULL, NULL
  FROM d WHERE region = 'AFRICA' AND y = 1999
  UNION ALL SELECT month, region, 'inflation', '-', NULL, NULL, NULL
  FROM d WHERE region = 'EUROPE' AND y = 2000
  UNION ALL SELECT e.month, e.region, 'null_mismatch', 'revenue', e.revenue, NULL, NULL
  FROM e WHERE region = 'AMERICA' AND y = 1997
  UNION ALL SELECT e.month, e.region, 'value', 'revenue', e.revenue, d.revenue, 0.5
  FROM e JOIN d USING (month, region) WHERE region = 'AMERICA' AND e.y = 1996
  UNION ALL SELECT e.month, e.region, 'percent_literal', 'net_rate', e.net_rate, d.net_rate,
    round(d.net_rate - e.net_rate, 6)
  FROM e JOIN d USING (month, region) WHERE region = 'AMERICA' AND e.y = 1995
  UNION ALL SELECT month, region, 'repeated_key', '-', NULL, NULL, NULL
  FROM e WHERE region = 'ASIA' AND y = 1997
  UNION ALL SELECT NULL, NULL, 'missing_column', 'gross', NULL, NULL, NULL
  UNION ALL SELECT NULL, NULL, 'extra_column', 'note', NULL, NULL, NULL"""

OPTIONS = {
    "region": "SELECT DISTINCT 'region' AS dimension, region AS value FROM wide",
    "month": f"SELECT DISTINCT 'month' AS dimension, {day('m')} AS value FROM wide",
    "segment": "SELECT DISTINCT 'segment' AS dimension, segment AS value FROM wide",
    "nation": "SELECT DISTINCT 'nation' AS dimension, nation AS value FROM wide",
}


def options(names: tuple[str, ...]) -> str:
    union = " UNION ".join(OPTIONS[n] for n in names)
    return f"WITH {WIDE} SELECT * FROM ({union}) WHERE value IS NOT NULL"


def report(dims: str, metrics: str, groups: str, order: str = "") -> str:
    tail = f" ORDER BY {order}" if order else ""
    return f"WITH {WIDE} SELECT {dims}, {metrics} FROM wide GROUP BY {groups}{tail}"


def grain(name: str) -> str:
    return report(
        f"{day(f'date_trunc({chr(39)}{name}{chr(39)}, ship_date)')} AS {name}, region",
        f"{amount('sum(net_amount)')} AS revenue",
        f"date_trunc('{name}', ship_date), region",
        f"{name} DESC, region",
    )


INCLUDED = """v AS (
  SELECT DISTINCT t, c, v FROM (
    SELECT 'sales_lines' AS t, 'order_key' AS c, l_orderkey AS v FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL
    UNION ALL SELECT 'sales_lines', 'part_key', l_partkey FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL
    UNION ALL SELECT 'orders', 'order_key', o_orderkey FROM orders
    UNION ALL SELECT 'orders', 'cust_key', o_custkey FROM orders WHERE o_orderkey IS NOT NULL
    UNION ALL SELECT 'customer', 'cust_key', c_custkey FROM customer
    UNION ALL SELECT 'customer', 'nation_key', c_nationkey FROM customer WHERE c_custkey IS NOT NULL
    UNION ALL SELECT 'nation', 'nation_key', n_nationkey FROM nation
    UNION ALL SELECT 'nation', 'region_key', n_regionkey FROM nation WHERE n_nationkey IS NOT NULL
    UNION ALL SELECT 'region', 'region_key', r_regionkey FROM region) WHERE v IS NOT NULL
), sizes AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c
), included AS (
  SELECT a.t AS table_name, a.c AS column_name, b.t AS in_table, b.c AS in_column,
    any_value(n) AS distinct_values, count(*) AS shared, round(count(*) / any_value(n), 4) AS ratio
  FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c)
  JOIN sizes s ON s.t = a.t AND s.c = a.c GROUP BY 1, 2, 3, 4)"""

ORACLES: dict[str, str] = {
    "key_inclusions": f"WITH {INCLUDED} SELECT * FROM included",
    "join_containment": f"""WITH {INCLUDED}
      SELECT 'orders' AS fact, 'cust_key' AS column_name, 'customer' AS dim, ratio FROM included
      WHERE table_name = 'orders' AND column_name = 'cust_key' AND in_table = 'customer'
        AND in_column = 'cust_key'
        AND (SELECT count(DISTINCT c_custkey) = count(*) FROM customer)""",
    **batch.ORACLES,
    "discovered_row_counts": """
      SELECT 'orders' AS source, 'orders.parquet' AS file, count(*) AS rows FROM orders
      UNION ALL SELECT 'customer', 'customer.parquet', count(*) FROM customer
      UNION ALL SELECT 'shipments', 'lineitem.parquet', count(*) FROM lineitem""",
    "csv_ingest": f"""
      SELECT o_orderstatus AS status, NULLIF(o_orderpriority, '5-LOW') AS priority,
        count(*) AS orders,
        {amount("sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) "
                "ELSE 0 END)")} AS amount,
        {day('min(o_orderdate)')} AS first_day, {day('max(o_orderdate)')} AS last_day
      FROM orders GROUP BY 1, 2""",
    "csv_quoted_breaks": """
      SELECT doc_id, NULLIF(lang, '') AS lang, length(note) AS chars,
        length(note) - length(replace(note, chr(10), '')) AS line_ends, md5(note) AS digest
      FROM (SELECT doc_id, lang,
        concat('"', coalesce(source, ''), '",', chr(10), coalesce(text, '')) AS note
        FROM documents)""",
    "skip_first_rows": """
      SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
      FROM (SELECT o_orderkey FROM orders OFFSET 100)""",
    "report_export": f"SELECT 'last run was red' AS note, * FROM ({REGION_MONTH_REPORT})",
    "clean_strip": """
      SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment
      FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "typed_staging": f"""WITH {FEED}, s AS (
      SELECT entry_type, {DATE_TEXT.format(c='ship_date')} AS d,
        CAST(round_even(TRY_CAST(quantity AS DECIMAL(18,4)), 0) AS BIGINT) AS q,
        TRY_CAST(price AS DECIMAL(18,4)) AS p,
        COALESCE(TRY_CAST(discount AS DECIMAL(18,4)), 0) AS disc
      FROM feed WHERE doc_no IS NOT NULL AND ship_date IS NOT NULL)
      SELECT entry_type, count(*) AS rows, CAST(sum(q) AS BIGINT) AS quantity,
        {amount('sum(p)')} AS price, {amount('sum(disc)')} AS discount,
        {day('min(d)')} AS first_day, {day('max(d)')} AS last_day, count(p) AS priced_rows
      FROM s WHERE d IS NOT NULL GROUP BY entry_type""",
    **{name: f"WITH {FEED} {text}" for name, text in LINE_RULES.items()},
    "contract_ledger": f"WITH {FEED} {ledger('run-1', ALL_LINE_RULES + ALL_EVENT_RULES)}",
    "stream_ledger": f"WITH {FEED}, halves AS (SELECT * FROM events_feed), "
    + ", ".join(f"half{i} AS (SELECT * FROM halves WHERE CAST(event_id AS BIGINT) % 2 = {i})" for i in (0, 1))
    + " UNION ALL ".join(
        f"{'' if i else ' '}SELECT CAST({i} AS BIGINT) AS batch_id, {LEDGER_COLUMNS} "
        f"FROM ({stacked(event_rules(f'half{i}'))})"
        for i in (0, 1)
    ),
    "staging_tests": f"WITH {LINES} "
    + stacked(
        [
            f"SELECT '{s}' AS source, '{f}' AS field, '{t}' AS test, '{v}' AS severity, "
            f"count_if({condition}) AS failures FROM lines"
            for (s, f, t, v), condition in LINE_TEST_COUNTS.items()
        ]
        + [
            "SELECT 'lines_by_order', 'order_key', 'unique', 'error', count(*) "
            "FROM (SELECT 1 FROM lines GROUP BY order_key HAVING count(*) > 1)"
        ]
    ),
    "row_drop_ratio": feed_problem("row_drop_ratio", "yellow", "doc_no IS NULL", 0.005),
    "type_coerce_ratio": f"""WITH {FEED}, s AS (
      SELECT count(*) AS n, count_if({unparsed('quantity', 'number')})
        + count_if({unparsed('ship_date', 'date')}) + count_if({unparsed('price', 'number')}) AS d
      FROM feed)
      SELECT 'line_feed' AS source, '-' AS field, 'type_coerce_ratio' AS rule, 'red' AS level,
        CAST(0 AS BIGINT) AS cnt, concat(d, ' of ', n) AS sample FROM s WHERE d / n > 0.03""",
    "empty_feeds": """
      SELECT 'event_feed' AS source, '-' AS field, 'empty_file' AS rule, 'yellow' AS level,
        CAST(0 AS BIGINT) AS cnt, 'no data rows' AS sample
      FROM events WHERE value < 0 HAVING count(*) = 0
      UNION ALL SELECT 'event_feed', '-', 'empty_after_clean', 'yellow', 0,
        concat('no rows left of ', count(*))
      FROM events HAVING count(*) > 0 AND count(NULLIF(user_id, user_id)) = 0""",
    "ledger_union": f"""WITH {LINES}, stacked AS (
      SELECT 'order' AS entry_type, CAST(o_orderkey AS VARCHAR) AS doc_no,
        CAST(o_orderdate AS DATE) AS d, o_custkey AS party,
        CAST(o_totalprice AS DECIMAL(18,4)) AS amount, NULL::DECIMAL(18,4) AS quantity FROM orders
      UNION ALL SELECT 'line', concat(order_key, '-', line_no), ship_date, NULL, price, quantity
      FROM lines
      UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), CAST(ts AS DATE), user_id,
        CAST(value AS DECIMAL(18,4)), NULL FROM events)
      SELECT entry_type, {day("date_trunc('month', d)")} AS month, count(*) AS rows,
        {amount('sum(amount)')} AS amount, count(party) AS with_party,
        {amount('sum(quantity)')} AS quantity, min(doc_no) AS first_doc, max(doc_no) AS last_doc
      FROM stacked GROUP BY entry_type, date_trunc('month', d)""",
    "wide_left": GEOGRAPHY_TOTALS,
    "wide_spread": GEOGRAPHY_TOTALS,
    "wide_how_kinds": JOIN_KINDS,
    "match_fanout": """
      SELECT l_orderkey AS order_key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
    "match_null": """
      SELECT DISTINCT o_custkey AS cust_key FROM orders WHERE o_custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "match_orphan": """
      SELECT o_orderkey AS order_key FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "match_contracts": f"""
      SELECT 'run-1' AS run_id, {LEDGER_COLUMNS} FROM ({stacked(MATCH_PARTS)}) WHERE cnt > 0""",
    "region_month_report": REGION_MONTH_REPORT,
    "monthly_kpi_report": report(
        f"{day('m')} AS month",
        f"{amount('sum(net_amount)')} AS revenue, {amount('sum(price)')} AS gross, "
        f"{NET_RATE} AS net_rate, count(*) AS line_count",
        "m",
        "month DESC",
    ),
    "full_period_only": f"""WITH {WIDE}
      SELECT {day('m')} AS month, {amount('sum(net_amount)')} AS revenue, count(*) AS line_count
      FROM wide WHERE date_trunc('month', ship_date) < DATE '1998-06-01' GROUP BY m
      ORDER BY month DESC""",
    "limit_clamped": newest_first(
        f"WITH {REGION_MONTH} SELECT * FROM report", "month", "region", 1
    ),
    "grain_week": grain("week"),
    "grain_quarter": grain("quarter"),
    "grain_year": grain("year"),
    "mart_count_distinct": report(
        f"{day(f'date_trunc({chr(39)}year{chr(39)}, ship_date)')} AS year, nation",
        "count(DISTINCT order_key) AS order_count, count(*) AS line_count",
        "date_trunc('year', ship_date), nation",
        "year DESC, nation",
    ),
    "mart_cond_distinct": report(
        "nation",
        "count(DISTINCT order_key) AS order_count, "
        "count(DISTINCT CASE WHEN return_flag = 'R' THEN order_key END) AS returned_orders",
        "nation",
    ),
    "mart_ratio_distinct": report(
        "nation",
        f"{amount('sum(net_amount)')} AS revenue, "
        f"{ratio('sum(net_amount)', 'count(DISTINCT order_key)', 2)} AS revenue_per_order, "
        + ratio(
            "sum(net_amount)",
            "count(DISTINCT CASE WHEN return_flag = 'R' THEN order_key END)",
            2,
        )
        + " AS revenue_per_returned_order",
        "nation",
    ),
    "mart_diff": report(
        f"{day('m')} AS month, priority",
        f"{amount('sum(net_amount) - sum(returned_amount)')} AS kept_revenue, "
        f"{amount('sum(returned_amount)')} AS returned",
        "m, priority",
        "month DESC, priority",
    ),
    "mart_minmaxavg": report(
        f"{day('m')} AS month, segment",
        f"{amount('min(price)')} AS lowest_price, {amount('max(price)')} AS highest_price, "
        f"{ratio('sum(quantity)', 'count(quantity)')} AS mean_quantity",
        "m, segment",
        "month DESC, segment",
    ),
    "mart_expression": report(
        f"{day('m')} AS month, return_flag AS flag",
        f"{amount('sum(net_amount)')} AS revenue, "
        + ratio(
            "sum(CASE WHEN quantity > 25 AND NOT return_flag IN ('R') "
            "THEN COALESCE(abs(-net_amount), 0) ELSE 0 END)",
            "sum(net_amount)",
        )
        + " AS large_line_share",
        "m, return_flag",
        "month DESC, flag",
    ),
    "derive_ladder": report(
        f"{day('m')} AS month",
        f"{DEDUCTIONS} AS deductions, {CONTRIBUTION} AS contribution, "
        f"{CONTRIBUTION_RATE} AS contribution_rate",
        "m",
        "month DESC",
    ),
    "mart_cond_sum": f"""WITH {LINES}
      SELECT {day("date_trunc('month', ship_date)")} AS month, line_status AS status,
        {amount("sum(CASE WHEN line_status = 'O' THEN price ELSE 0 END)")} AS open_gross_total,
        {amount("sum(CASE WHEN return_flag = 'R' THEN quantity ELSE 0 END)")}
          AS returned_unit_total
      FROM lines GROUP BY date_trunc('month', ship_date), line_status""",
    "layer_l1": ladder(
        f"{day('m')} AS month, part_key AS part, brand",
        f"{amount('sum(net_amount)')} AS revenue, "
        f"{amount('sum(discount_amount)')} AS discounts, {CARRIED}",
        "m, part_key, brand",
    ),
    "layer_l2": ladder(
        f"{day('m')} AS month, brand",
        f"{amount('sum(net_amount)')} AS revenue, {CONTRIBUTION} AS contribution, "
        f"{CONTRIBUTION_RATE} AS contribution_rate, {CARRIED}",
        "m, brand",
    ),
    "layer_l3": ladder(
        f"{day('m')} AS month",
        f"{DEDUCTIONS} AS deductions, {CONTRIBUTION} AS contribution, "
        f"{CONTRIBUTION_RATE} AS contribution_rate",
        "m",
    ),
    "layer_distinct": ladder(
        f"{day('m')} AS month",
        "count(DISTINCT order_key) AS order_count, count(DISTINCT order_key) AS order_numbers, "
        "count(DISTINCT CASE WHEN return_flag = 'R' THEN order_key END) AS returned_orders, "
        f"{amount('sum(net_amount)')} AS revenue, true AS near",
        "m",
    ),
    "layer_recon": f"""WITH {PARTS}, b AS (
      SELECT m, brand, {amount('sum(net_amount)')} AS revenue, {CONTRIBUTION} AS contribution
      FROM wide GROUP BY m, brand)
      SELECT 'revenue' AS metric, {day('m')} AS month, brand, revenue AS parent_value,
        revenue + 1 AS child_value FROM b WHERE brand = 'Brand#7'
      UNION ALL SELECT 'revenue', {day('m')}, brand, revenue, NULL
      FROM b WHERE brand = 'Brand#9' AND abs(revenue) > 0.01
      UNION ALL SELECT 'contribution', {day('m')}, brand, contribution, NULL
      FROM b WHERE brand = 'Brand#9' AND abs(contribution) > 0.01""",
    "conserve_total": f"""WITH {PARTS}, t AS (
      SELECT {DEDUCTIONS} AS deductions, {CONTRIBUTION} AS contribution FROM wide)
      SELECT 'deductions' AS metric, deductions AS mart_total, deductions AS source_total,
        true AS ok FROM t
      UNION ALL SELECT 'contribution', contribution, contribution, true FROM t""",
    "filter_own_dim": f"WITH {REGION_MONTH} SELECT * FROM report WHERE region = 'ASIA'",
    "filter_period": f"WITH {REGION_MONTH} SELECT * FROM report WHERE month = '1998-03-01'",
    "filter_group_membership": f"""WITH {REGION_MONTH} SELECT * FROM report
      WHERE region IN (SELECT region FROM wide WHERE nation = 'NATION_3')""",
    "filter_stored_pairs": f"""WITH {REGION_MONTH} SELECT * FROM report
      WHERE region IN (SELECT region FROM wide WHERE nation = 'NATION_3')
        AND region IN (SELECT region FROM wide WHERE segment = 'BUILDING')""",
    "filter_bad_value": f"WITH {REGION_MONTH} SELECT * FROM report",
    "filter_options": options(("region", "month", "segment", "nation")),
    "all_options": options(("region", "month", "segment", "nation")),
    "slice_segment": newest_first(
        f"""WITH {WIDE} SELECT {day('m')} AS month, region,
          {amount('sum(net_amount)')} AS revenue, {amount('sum(price)')} AS gross,
          {NET_RATE} AS net_rate
        FROM wide WHERE segment = 'BUILDING' GROUP BY m, region""",
        "month",
        "region",
    ),
    "pivot_month_region": f"""WITH {REGION_MONTH} SELECT month,
      max(CASE WHEN region = 'AFRICA' THEN revenue END) AS "AFRICA",
      max(CASE WHEN region = 'AMERICA' THEN revenue END) AS "AMERICA",
      max(CASE WHEN region = 'ASIA' THEN revenue END) AS "ASIA",
      max(CASE WHEN region = 'EUROPE' THEN revenue END) AS "EUROPE",
      max(CASE WHEN region = 'MIDDLE EAST' THEN revenue END) AS "MIDDLE EAST"
      FROM report GROUP BY month""",
    "display_scale": f"""WITH {REGION_MONTH} SELECT month, region,
      round(revenue / 10000.0::DOUBLE, 1) AS revenue_10k,
      round(net_rate * 100.0::DOUBLE, 1) AS net_percent FROM report""",
    "latest_previous": f"""WITH {WIDE}, k AS (
      SELECT {day('m')} AS month, {amount('sum(net_amount)')} AS revenue,
        {amount('count(*)')} AS line_count, {NET_RATE} AS net_rate FROM wide GROUP BY m),
      c AS (SELECT * FROM k ORDER BY month DESC LIMIT 1),
      p AS (SELECT * FROM k ORDER BY month DESC LIMIT 1 OFFSET 1)
      SELECT 'revenue' AS metric, c.month AS period, c.revenue AS current_value,
        p.revenue AS previous_value, c.revenue / p.revenue - 1.0 AS change
      FROM c LEFT JOIN p ON true
      UNION ALL SELECT 'line_count', c.month, c.line_count, p.line_count,
        c.line_count / p.line_count - 1.0 FROM c LEFT JOIN p ON true
      UNION ALL SELECT 'net_rate', c.month, c.net_rate, p.net_rate, c.net_rate - p.net_rate
      FROM c LEFT JOIN p ON true""",
    "period_over_period": f"""WITH {REGION_MONTH}, h AS (
      SELECT month, region, revenue, net_rate,
        lag(revenue) OVER (PARTITION BY region ORDER BY month) AS revenue_prev,
        lag(net_rate) OVER (PARTITION BY region ORDER BY month) AS net_rate_prev FROM report)
      SELECT month, region, revenue, revenue_prev,
        revenue / NULLIF(revenue_prev, 0) - 1.0 AS revenue_change, net_rate, net_rate_prev,
        net_rate - NULLIF(net_rate_prev, 0) AS net_rate_change FROM h""",
    "period_over_period_rollup": (
        "SELECT month, part, brand, revenue, prev AS revenue_prev, "
        "revenue / NULLIF(prev, 0) - 1.0 AS revenue_change FROM ("
        "SELECT *, lag(revenue) OVER (PARTITION BY part, brand ORDER BY month) AS prev FROM ("
        + ladder(
            f"{day('m')} AS month, part_key AS part, brand",
            f"{amount('sum(net_amount)')} AS revenue",
            "m, part_key, brand",
        )
        + "))"
    ),
    "topn_customers": f"""WITH {WIDE} SELECT customer, {amount('sum(net_amount)')} AS revenue,
      {amount('sum(quantity)')} AS units FROM wide GROUP BY customer
      ORDER BY sum(net_amount) DESC NULLS LAST, customer LIMIT 15""",
    "scalar_functions": f"""WITH {LINES}, x AS (
      SELECT *, CASE WHEN quantity < 10 THEN 'few' WHEN quantity >= 40 THEN 'many'
        ELSE 'some' END AS w FROM lines)
      SELECT w, {day("date_trunc('quarter', ship_date)")} AS q,
        {amount('sum(round(price * discount, 1))')} AS r,
        count(NULLIF(line_status, 'F')) AS n, {amount('sum(COALESCE(NULLIF(tax, 0), 0.01))')} AS c,
        CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) AS k, {amount('sum(abs(price - 50000))')} AS a,
        count_if(return_flag IN ('A', 'R') AND NOT (tax = 0 OR discount > 0.05)) AS b,
        max(trim(CAST(order_key AS VARCHAR))) AS t,
        {amount('sum(price) * -0.75')} AS u
      FROM x GROUP BY w, date_trunc('quarter', ship_date)""",
    "pending_queue": f"""WITH {TWO_RUNS} SELECT run_id, {LEDGER_COLUMNS} FROM ledger
      WHERE run_id = 'run-2' ORDER BY source, field, rule""",
    "severity_summary": f"""WITH {TWO_RUNS} SELECT run_id, level, count(*) AS violations
      FROM ledger GROUP BY run_id, level""",
    "traffic_light": f"""WITH {NODES} SELECT run_id,
      CASE WHEN bool_or(status = 'error') THEN 'red' WHEN bool_or(status = 'warn') THEN 'yellow'
        ELSE 'green' END AS light FROM nodes GROUP BY run_id""",
    "status_counts": f"""WITH {NODES} SELECT run_id, status, count(*) AS nodes
      FROM nodes GROUP BY run_id, status""",
    "run_timeline": f"""WITH {NODES}, b AS (
      SELECT run_id, min(started_at) AS f, max(ended_at) AS l FROM nodes GROUP BY run_id)
      SELECT run_id, node, {seconds('f', 'started_at')} AS offset_s,
        {seconds('started_at', 'ended_at')} AS duration_s, {seconds('f', 'l')} AS total_s
      FROM nodes JOIN b USING (run_id)""",
    "run_history": f"""WITH {RUNS} SELECT instance, run_id, status,
      CAST(place AS INT) AS place FROM runs WHERE place <= 60""",
    "stale_instances": f"""WITH {RUNS} SELECT instance, run_id, status = 'red' AS stale
      FROM runs WHERE place = 1""",
    "missing_sources": """
      SELECT DISTINCT event_type AS source FROM events
      WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 365)""",
    "profile_columns": stacked(
        [column_profile(t, c, t) for t, columns in PROFILED.items() for c in columns]
    ),
    "infer_types": f"WITH {FEED} "
    + stacked([column_profile("feed", c) for c in FEED_COLUMNS]),
    "join_suggest": """
      SELECT 'orders' AS fact, 'cust_key' AS column_name, 'customer' AS dim FROM customer
      HAVING count(DISTINCT c_custkey) = count(*)""",
    "guess_entities": """
      SELECT 'sales_lines' AS table_name, count(*) AS rows, 'fact' AS entity FROM lineitem
      UNION ALL SELECT 'orders', count(*), 'fact' FROM orders
      UNION ALL SELECT 'customer', count(*), 'dim' FROM customer
      UNION ALL SELECT 'nation', count(*), 'dim' FROM nation
      UNION ALL SELECT 'region', count(*), 'dim' FROM region""",
    "profile_summary": """
      SELECT CAST(4 AS BIGINT) AS files, CAST(1 AS BIGINT) AS facts, CAST(3 AS BIGINT) AS dims,
        (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)
        + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS total_rows""",
    "diff_keyed": KEYED_DIFF,
    "diff_multiset": """
      SELECT l_orderkey, l_linenumber, count(*) AS left_rows, CAST(1 AS BIGINT) AS right_rows
      FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "diff_pruned": """
      WITH b AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 1 AS l, 0 AS r FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey,
          CASE WHEN l_orderkey % 1000 = 777 THEN l_quantity + 1 ELSE l_quantity END, 0, 1
        FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
        CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows
      FROM b GROUP BY 1, 2, 3, 4 HAVING sum(l) <> sum(r)""",
}
