"""A small retail company: its model, its files, and its figures worked out by hand
in plain Python. The files break the contracts in known places."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from reportloom.functions import metrics as m
from reportloom.spec import Dimension, Field, Join, Report, ReportModel, Source, Wide

RED = {p: "red" for p in ("file_missing", "header_changed", "empty_file", "empty_after_clean")}


def source(name, pattern, *fields):
    return Source(name, fields, patterns=(pattern,), encodings=("utf-8-sig", "gbk"), problems=RED)


SOURCES = (
    source(
        "fact_ledger",
        "台账_*.csv",
        Field("事项类型", "entry_type", required=True, enum=("销售", "采购", "采购退货", "期末库存")),
        Field("单据号", "doc_no", required=True),
        Field("单据日期", "doc_date", "date", required=True),
        Field("门店编码", "store_code", required=True),
        Field("商品编码", "product_code", required=True),
        Field("供应商编码", "supplier_code"),
        Field("渠道", "channel", enum=("门店", "电商")),
        Field("数量", "quantity", "integer", range=(1, 999)),
        Field("单价", "unit_price", "decimal"),
        Field("折扣率", "discount_rate", "decimal", range=(0, 1), default=0),
        Field("期末数量", "ending_qty", "integer", range=(0, 1000000)),
    ),
    source(
        "stock_snapshot",
        "库存快照_*.csv",
        Field("快照月份", "snap_month"),
        Field("快照日期", "snap_date", "date", required=True),
        Field("门店编码", "store_code", required=True),
        Field("商品编码", "product_code", required=True),
        Field("期末数量", "ending_qty", "integer", required=True, range=(0, 100000)),
    ),
    source(
        "stores",
        "门店_*.csv",
        Field("门店编码", "store_code", required=True),
        Field("门店名称", "store_name"),
        Field("城市", "city"),
        Field("大区", "region_name", enum=("华东", "华北", "华南")),
        Field("开业日期", "open_date", "date"),
    ),
    source(
        "products",
        "商品_*.csv",
        Field("商品编码", "product_code", required=True),
        Field("商品名称", "product_name"),
        Field("品类", "category", enum=("食品", "百货", "日化")),
        Field("单位", "unit"),
        Field("标准成本", "std_cost", "decimal"),
    ),
    source(
        "suppliers",
        "供应商_*.csv",
        Field("供应商编码", "supplier_code", required=True),
        Field("供应商名称", "supplier_name"),
        Field("结算方式", "settle_type", enum=("月结30", "月结60", "现结")),
    ),
)


def join(table, key, *columns):
    return Join(table, key, key, columns, fanout="yellow")


MODEL = ReportModel(
    "retail",
    SOURCES,
    Wide(
        "wide_ledger",
        "fact_ledger",
        (
            join("stores", "store_code", "store_name", "city", "region_name"),
            join("products", "product_code", "product_name", "category", "std_cost"),
            join("suppliers", "supplier_code", "supplier_name"),
        ),
        (
            (
                "sales_net",
                "case when entry_type = '销售' "
                "then round(quantity * unit_price * (1 - discount_rate), 2) else 0 end",
            ),
            (
                "gross_profit",
                "case when entry_type = '销售' then round(quantity * unit_price "
                "* (1 - discount_rate) - quantity * std_cost, 2) else 0 end",
            ),
            (
                "purchase_amt",
                "case when entry_type = '采购' then round(quantity * unit_price, 2) else 0 end",
            ),
        ),
    ),
    (
        Dimension("月份", "doc_date", "time", "month"),
        Dimension("大区", "region_name"),
        Dimension("城市", "city"),
        Dimension("品类", "category"),
        Dimension("供应商", "supplier_name"),
    ),
    (
        m.total("销售额", "sales_net"),
        m.total("毛利", "gross_profit"),
        m.total("采购额", "purchase_amt"),
        m.ratio("毛利率", ("gross_profit",), ("sales_net",)),
    ),
    (
        Report("monthly_kpi", "月份", ("销售额", "毛利", "毛利率"), full_period_only=True),
        Report("region_month", "大区", ("销售额", "毛利"), time_dim="月份", filters=("城市",)),
        Report("category_month", "品类", ("销售额", "毛利率"), time_dim="月份"),
        Report("supplier_rank", "供应商", ("采购额",)),
    ),
)

SMALL = ReportModel(
    "small",
    tuple(s for s in SOURCES if s.name in ("stores", "products", "suppliers")),
    Wide("products_wide", "products"),
    (Dimension("品类", "category"),),
    (m.row_count("商品数"),),
    (Report("category_size", "品类", ("商品数",)),),
)

STORES = [
    ("S01", "一店", "上海", "华东", "2020-01-01"),
    ("S02", "二店", "北京", "华北", "2020/3/5"),
    ("S03", "三店", "广州", "华南", "2021-06-01"),
    ("S04", "四店", "杭州", "华东", ""),
    ("S05", "五店", "苏州", "华东", "2022-01-01"),
    ("S05", "五店二号", "苏州", "华东", "2023-01-01"),
]
PRODUCTS = [
    (f"P{i:02d}", f"商品{i}", ("食品", "百货", "日化")[i % 3], "件", f"{5 + i}.25")
    for i in range(1, 12)
] + [("P12", "商品12", "生鲜", "件", "9.5")]
SUPPLIERS = [(f"SUP-{i}", f"供应商{i}", ("月结30", "月结60", "现结")[i % 3]) for i in range(1, 6)]
SNAPSHOTS = [
    ("2026-08", "2026-08-31", f"S0{1 + i % 5}", f"P{1 + i % 11:02d}", str(10 * i)) for i in range(20)
] + [("2026-08", "2026-08-31", "S01", "P01", "-5")]


def ledger() -> list[list[str]]:
    """Fifty ledger rows: 29 sales, 12 purchases, 4 returns, 5 stock rows."""

    def sale(i, store=None, channel=None, price=None, doc=None):
        discount = "" if i % 5 == 0 else ("0.1" if i % 2 else "0.05")
        return [
            "销售",
            f" SZ-{i:03d}　" if doc is None else doc,
            f"2026-{7 + i % 2:02d}-{1 + i:02d}",
            store or f"S0{1 + i % 4}",
            f"P{1 + i % 11:02d}",
            "",
            channel or ("门店" if i % 3 else "电商"),
            str(1 + i),
            price or f"{10 + i}.5",
            discount,
            "",
        ]

    def purchase(i, quantity=None, doc=None, supplier=None):
        return [
            "采购",
            f"PO-{i:03d}" if doc is None else doc,
            f"2026-{7 + i % 2:02d}-{10 + i}",
            f"S0{1 + i % 4}",
            f"P{1 + i % 11:02d}",
            supplier or f"SUP-{1 + i % 5}",
            "",
            quantity or str(20 + i),
            f"{6 + i}.125",
            "",
            "",
        ]

    out = [sale(i) for i in range(21)]
    out += [sale(i, store="S05") for i in range(21, 24)]
    out += [sale(i, channel="团购") for i in range(24, 27)]
    out += [sale(27, price="N/A"), sale(28, doc="")]
    out += [purchase(i) for i in range(8)]
    out += [purchase(8, quantity="2000"), purchase(9, quantity="0")]
    out += [purchase(10, doc="　 "), purchase(11, supplier="SUP-999")]
    for i in range(4):
        row = purchase(i)
        out.append(["采购退货", f"RT-{i}", *row[2:]])
    for i in range(5):
        store = f"S0{1 + i}"
        out.append(
            ["期末库存", f"QM-{i}", "2026-08-31", store, f"P0{1 + i}", "", "", "", "", "", "7"]
        )
    return out


def csv_text(header: list[str], rows) -> str:
    return "\n".join(",".join(r) for r in [header, *rows]) + "\n"


def write_files(folder) -> None:
    data = {
        "台账_202608.csv": (SOURCES[0], ledger()),
        "库存快照_202608.csv": (SOURCES[1], SNAPSHOTS),
        "门店_202608.csv": (SOURCES[2], STORES),
        "商品_202608.csv": (SOURCES[3], PRODUCTS),
        "供应商_202608.csv": (SOURCES[4], SUPPLIERS),
    }
    for name, (spec, rows) in data.items():
        text = csv_text([f.header for f in spec.fields], rows)
        (folder / name).write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))


EXPECTED_LEDGER = [
    ("fact_ledger", "channel", "enum", "yellow", 3),
    ("fact_ledger", "doc_no", "required", "yellow", 2),
    ("fact_ledger", "quantity", "range", "yellow", 2),
    ("fact_ledger", "unit_price", "type", "yellow", 1),
    ("products", "category", "enum", "yellow", 1),
    ("stock_snapshot", "ending_qty", "range", "yellow", 1),
    ("wide_ledger", "store_code", "fanout", "yellow", 1),
    ("wide_ledger", "supplier_code", "null_match", "yellow", 1),
]
EXPECTED_ROWS = {
    "fact_ledger": 48,
    "stock_snapshot": 21,
    "stores": 6,
    "products": 12,
    "suppliers": 5,
}


def money(value: Decimal) -> Decimal:
    return value.quantize(Decimal("0.01"), ROUND_HALF_UP)


def expected_region_month() -> dict:
    """Sales and profit per (month, region), computed row by row."""
    stores = defaultdict(list)
    for s in STORES:
        stores[s[0]].append(s[3])
    cost = {p[0]: Decimal(p[4]) for p in PRODUCTS}
    out: dict = {}
    for row in ledger():
        if not row[1].strip():
            continue
        kind, day, store, product = row[0], row[2], row[3], row[4]
        for region in stores[store]:
            key = (dt.date.fromisoformat(day).replace(day=1), region)
            sums = out.setdefault(key, [Decimal(0), Decimal(0)])
            if kind != "销售" or row[8] == "N/A":
                continue
            quantity, price = Decimal(row[7]), Decimal(row[8])
            net = quantity * price * (1 - Decimal(row[9] or "0"))
            sums[0] += money(net)
            sums[1] += money(net - quantity * cost[product])
    return {k: tuple(v) for k, v in out.items()}
