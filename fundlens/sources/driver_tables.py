"""Maps the driver's tables onto the domain tables.

One work per order that has lines; its line is the smallest by line number. ``WORKS_SQL`` states
the same mapping for the SQL checks. All dimension joins are left joins, so the number of works
does not depend on which columns are asked for, and a dimension is only joined when one of its
columns is wanted.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.numbers import MONEY
from fundlens.session import materialise

_CUSTOMER_COLUMNS = {
    "state", "nodal_district", "mp_name", "constituency", "implementing_agency_name", "work_name",
}
_PART_COLUMNS = {"work_category", "work_name"}
_SUPPLIER_COLUMNS = {"implementing_district", "vendor_name"}
WORK_COLUMNS = (
    "order_key", "unique_work_number", "state", "nodal_district", "implementing_district",
    "mp_name", "constituency", "work_category", "work_name", "sanction_amount",
    "date_of_receipt_of_work_proposal_from_mp", "date_of_administrative_approval",
    "implementing_agency_name", "vendor_id", "vendor_name", "work_status",
    "physical_progress_pct", "financial_progress_pct", "is_anomaly", "anomaly_type",
)
# Injected defect names, by order key modulo 5.
ANOMALY_TYPES = (
    "cost_overrun", "ghost_project_progress_mismatch", "duplicate_work", "split_invoicing",
    "fund_dumping_year_end",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_number(key: Column) -> Column:
    return F.concat(F.lit("W"), F.lpad(key.cast("string"), 8, "0"))


def vendor_number(key: Column) -> Column:
    return F.concat(F.lit("V"), F.lpad(key.cast("string"), 5, "0"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 25 nations and 5 regions at every scale, so broadcasting them is bounded.
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return F.broadcast(
        nation.join(
            F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left"
        ).select("n_nationkey", "n_name", "r_name")
    )


_LINE_COLUMNS = (
    "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
)
_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def shared_lines():
    """Within it, works asked for again are built from one stored table of first lines.

    For queries that read the works several times: the lines are scanned and shuffled once, and
    every later reading takes only its columns from the stored table.
    """
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with lines, each with its first line."""
    held = _shared.get()
    if held is not None and sf_dir in held:
        return held[sf_dir]
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct(*_LINE_COLUMNS)).alias("line"))
        .select("l_orderkey", "line.*")
    )
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == orders.o_orderkey)
    if held is not None:
        joined = held[sf_dir] = materialise(
            joined.select(
                "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus",
                *[c for c in _LINE_COLUMNS if c not in ("l_linenumber", "l_extendedprice")],
            ),
            "first-lines",
        )
    return joined


def works(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The works table, restricted to ``columns`` (all when none are named)."""
    wanted = columns or WORK_COLUMNS
    need = set(wanted)
    df = _first_lines(spark, sf_dir)
    if need & _CUSTOMER_COLUMNS:
        customer = table(spark, sf_dir, "customer").select(
            "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
        )
        df = df.join(customer, df.o_custkey == customer.c_custkey, "left")
        if need & {"state", "nodal_district", "implementing_agency_name", "work_name"}:
            place = _places(spark, sf_dir)
            df = df.join(place, df.c_nationkey == place.n_nationkey, "left")
    if need & _PART_COLUMNS:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        df = df.join(part, df.l_partkey == part.p_partkey, "left")
    if need & _SUPPLIER_COLUMNS:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey, "left")
        if "implementing_district" in need:
            place = _places(spark, sf_dir).select(
                F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name")
            )
            df = df.join(F.broadcast(place), df.s_nationkey == F.col("sn_key"), "left")

    anomaly = F.col("l_returnflag") == "R"
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ANOMALY_TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int")
    )
    expressions = {
        "order_key": lambda: F.col("o_orderkey"),
        "unique_work_number": lambda: work_number(F.col("o_orderkey")),
        "state": lambda: F.col("r_name"),
        "nodal_district": lambda: F.col("n_name"),
        "implementing_district": lambda: F.col("sn_name"),
        "mp_name": lambda: F.col("c_name"),
        "constituency": lambda: F.col("c_mktsegment"),
        "work_category": lambda: F.col("p_type"),
        "work_name": lambda: F.concat(
            F.col("p_name"), F.lit(" works in "), F.col("n_name"), F.lit(" ward "),
            (F.col("o_orderkey") % 20).cast("string"),
        ),
        "sanction_amount": lambda: F.col("o_totalprice").cast(MONEY),
        "date_of_receipt_of_work_proposal_from_mp": lambda: F.to_date("o_orderdate"),
        "date_of_administrative_approval": lambda: F.to_date("l_shipdate"),
        "implementing_agency_name": lambda: F.concat_ws(
            "/", F.col("n_name"), F.col("o_orderpriority")
        ),
        "vendor_id": lambda: vendor_number(F.col("l_suppkey")),
        "vendor_name": lambda: F.col("s_name"),
        "work_status": lambda: F.when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "O", "Work in Progress")
        .otherwise("Stalled"),
        "physical_progress_pct": lambda: F.rint(F.col("l_discount") * 100) * 10,
        "financial_progress_pct": lambda: F.rint(F.col("l_tax") * 100) * F.lit(12.5),
        "is_anomaly": lambda: anomaly,
        "anomaly_type": lambda: F.when(anomaly, kind).otherwise(""),
    }
    return df.select([expressions[c]().alias(c) for c in wanted])


WORKS_SQL = f"""works AS (
  SELECT o_orderkey AS order_key, 'W' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS unique_work_number,
    r_name AS state, cn.n_name AS nodal_district, sn.n_name AS implementing_district,
    c_name AS mp_name, c_mktsegment AS constituency, p_type AS work_category,
    p_name || ' works in ' || cn.n_name || ' ward ' || CAST(o_orderkey % 20 AS VARCHAR) AS work_name,
    CAST(o_totalprice AS DECIMAL(18,2)) AS sanction_amount,
    CAST(o_orderdate AS DATE) AS date_of_receipt_of_work_proposal_from_mp,
    CAST(l_shipdate AS DATE) AS date_of_administrative_approval,
    cn.n_name || '/' || o_orderpriority AS implementing_agency_name,
    'V' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS vendor_id, s_name AS vendor_name,
    CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Work in Progress' ELSE 'Stalled' END AS work_status,
    round_even(l_discount * 100, 0) * 10 AS physical_progress_pct,
    round_even(l_tax * 100, 0) * CAST(12.5 AS DOUBLE) AS financial_progress_pct,
    l_returnflag = 'R' AS is_anomaly,
    CASE WHEN l_returnflag = 'R' THEN
      list_extract([{', '.join(repr(k) for k in ANOMALY_TYPES)}], CAST(o_orderkey % 5 + 1 AS BIGINT))
    ELSE '' END AS anomaly_type
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
          l_suppkey, l_partkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_returnflag) AS pick
        FROM lineitem) WHERE pick = 1)
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region ON cn.n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor master: suppliers, every tenth one a hub."""
    supplier = table(spark, sf_dir, "supplier")
    place = _places(spark, sf_dir)
    return supplier.join(place, supplier.s_nationkey == place.n_nationkey, "left").select(
        vendor_number(F.col("s_suppkey")).alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        (F.col("s_suppkey") % 10 == 0).alias("is_hub"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("district"),
    )


VENDORS_SQL = """vendors AS (
  SELECT 'V' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS vendor_id, s_name AS vendor_name,
    s_suppkey % 10 = 0 AS is_hub, r_name AS state, n_name AS district
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def mp_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member master: customers; the allocation is missing for every fourth one."""
    customer = table(spark, sf_dir, "customer")
    place = _places(spark, sf_dir)
    allocation = F.when(
        F.col("c_custkey") % 4 != 0, (F.lit(1000000) + F.col("c_custkey") % 50 * 100000)
    ).cast(MONEY)
    return customer.join(place, customer.c_nationkey == place.n_nationkey, "left").select(
        F.col("r_name").alias("state"),
        F.col("c_name").alias("mp_name"),
        F.col("c_mktsegment").alias("constituency"),
        F.col("n_name").alias("district"),
        allocation.alias("allocated_amount"),
    )


MP_MASTER_SQL = """mp_master AS (
  SELECT r_name AS state, c_name AS mp_name, c_mktsegment AS constituency, n_name AS district,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST(1000000 + c_custkey % 50 * 100000 AS DECIMAL(18,2)) END AS allocated_amount
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        work_number(F.col("l_orderkey")).alias("unique_work_number"),
        F.to_date("l_shipdate").alias("payment_date"),
        F.col("l_extendedprice").cast(MONEY).alias("payment_amount"),
        F.when(F.col("l_linestatus") == "F", "FINAL").otherwise("INSTALMENT").alias("payment_type"),
        vendor_number(F.col("l_suppkey")).alias("vendor_id"),
        F.concat_ws("-", work_number(F.col("l_orderkey")), "l_linenumber", "l_partkey", "l_suppkey").alias("payment_id"),
    )


PAYMENTS_SQL = """payments AS (
  SELECT 'W' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS unique_work_number,
    CAST(l_shipdate AS DATE) AS payment_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_amount,
    CASE WHEN l_linestatus = 'F' THEN 'FINAL' ELSE 'INSTALMENT' END AS payment_type,
    'V' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS vendor_id,
    concat_ws('-', 'W' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0'), l_linenumber, l_partkey, l_suppkey) AS payment_id
  FROM lineitem
)"""
