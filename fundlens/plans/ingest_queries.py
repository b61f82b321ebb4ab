"""File reading, harmonising, normalising, validating, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.dates import normalize_date as parse_date
from fundlens.functions.money import normalize_currency as parse_currency
from fundlens.functions.numbers import CRORE, LAKH, round_even
from fundlens.operators import harmonise as hz
from fundlens.operators import pairing as pr
from fundlens.operators import retrieval as rt
from fundlens.operators import store as st
from fundlens.operators import validation as va
from fundlens.plans import ingest as ing
from fundlens.plans.common import works_sql
from fundlens.plans.registry import query
from fundlens.session import scratch_path
from fundlens.sources import driver_tables as dt
from fundlens.sources import tables as tb
from fundlens.sources.readers import read_raw, typed_works

APPROVED = "date_of_administrative_approval"
AS_OF = "2001-01-01"


def messy_works(spark: SparkSession, sf: str) -> DataFrame:
    """Works as a careless office would type them; the key decides what is wrong."""
    w = dt.works(
        spark, sf, "order_key", "unique_work_number", "state", "nodal_district", "work_category",
        "sanction_amount", APPROVED, "vendor_id", "vendor_name", "physical_progress_pct", "financial_progress_pct",
    )
    k = F.col("order_key")
    amount = F.col("sanction_amount")
    plain = amount.cast("string")
    money = (
        F.when(k % 5 == 0, F.concat(F.lit("Rs. "), F.format_number(amount, 2), F.lit("/-")))
        .when(k % 5 == 1, F.concat(F.lit("₹ "), (amount / 100000).cast("decimal(18,7)").cast("string"), F.lit(" Lakhs")))
        .when(k % 5 == 2, F.concat(F.lit("INR "), plain))
        .when(k % 5 == 3, F.concat((amount / 10000000).cast("decimal(18,9)").cast("string"), F.lit(" Cr")))
        .otherwise(plain)
    )
    day = F.col(APPROVED)
    dates = F.element_at(
        F.array(
            F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "d-MMM-yyyy"),
            F.date_format(day, "MMMM d, yyyy"), F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"),
            F.lit("Pending Approval"),
        ),
        (k % 6 + 1).cast("int"),
    )
    return w.select(
        F.when(k % 17 == 0, "  ").otherwise(F.col("unique_work_number")).alias("Work_Code"),
        F.col("state").alias("State_Name"),
        F.col("nodal_district").alias("District"),
        F.col("work_category").alias("Category"),
        F.when(k % 19 == 0, F.lit("N/A")).when(k % 23 == 0, F.concat(F.lit("-"), plain)).otherwise(money).alias("Amount_Rs"),
        dates.alias("Approval_Date"),
        F.when(k % 4 == 0, "").otherwise(F.col("vendor_id")).alias("Vendor_ID"),
        F.concat(F.col("vendor_name"), F.when(k % 3 == 0, " ").otherwise("")).alias("Contractor_Name"),
        F.concat(F.col("physical_progress_pct").cast("string"), F.lit(" %")).alias("phys_pct"),
        F.when(k % 29 == 0, "140").when(k % 31 == 0, "unknown").otherwise(F.col("financial_progress_pct").cast("string")).alias("fin_pct"),
        F.col("unique_work_number").alias("Extra_Field_Gov"),
    )


_AMOUNT = "CASE WHEN order_key % 19 = 0 THEN NULL WHEN order_key % 23 = 0 THEN -CAST(sanction_amount AS DOUBLE) ELSE CAST(sanction_amount AS DOUBLE) END"
_DATE = "CASE WHEN order_key % 6 < 5 THEN date_of_administrative_approval END"
_FIN = "CASE WHEN order_key % 29 = 0 THEN 140.0 WHEN order_key % 31 = 0 THEN NULL ELSE financial_progress_pct END"
_MESSY = f"""messy AS (SELECT *, {_AMOUNT} AS amount, {_DATE} AS day, {_FIN} AS fin, order_key % 17 = 0 AS no_id FROM works),
judged AS (SELECT *, no_id OR amount IS NULL OR amount <= 0 OR coalesce(fin > 100, FALSE) AS bad FROM messy)"""


def _csv(spark: SparkSession, sf: str, fmt: str = "csv") -> DataFrame:
    """The messy works written to and read back from text files."""
    path = scratch_path(spark, f"messy.{fmt}")
    writer = messy_works(spark, sf).write
    if fmt == "jsonl":
        writer.json(path)
    else:
        writer.option("header", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    return read_raw(spark, path, fmt, with_row_id=True)


@query(works_sql("SELECT unique_work_number AS extra, state, CASE WHEN order_key % 19 = 0 THEN 'N/A' ELSE 'x' END AS amount FROM works"))
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    raw = _csv(spark, sf)
    return raw.select(
        F.col("Extra_Field_Gov").alias("extra"), F.col("State_Name").alias("state"),
        F.when(F.col("Amount_Rs") == "N/A", "N/A").otherwise("x").alias("amount"),
    )


@query(works_sql("SELECT unique_work_number AS extra, vendor_name || CASE WHEN order_key % 3 = 0 THEN ' ' ELSE '' END AS vendor FROM works"))
def read_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _csv(spark, sf, "jsonl").select(F.col("Extra_Field_Gov").alias("extra"), F.col("Contractor_Name").alias("vendor"))


@query(works_sql("SELECT unique_work_number AS extra, nodal_district AS district FROM works"))
def read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _csv(spark, sf, "tsv").select(F.col("Extra_Field_Gov").alias("extra"), F.col("District").alias("district"))


@query(works_sql("""SELECT unique_work_number, CAST(sanction_amount AS DOUBLE) AS sanction_amount, CASE WHEN order_key % 3 = 0 THEN 0 ELSE physical_progress_pct END AS physical_progress_pct, is_anomaly FROM works"""))
def typed_works_load(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "unique_work_number", "sanction_amount", "physical_progress_pct", "is_anomaly")
    text = w.select(
        "unique_work_number",
        F.concat(F.lit(" "), F.col("sanction_amount").cast("string"), F.lit(" rupees")).alias("sanction_amount"),
        F.when(F.col("order_key") % 3 == 0, "n.a.").otherwise(F.concat(F.col("physical_progress_pct").cast("string"), F.lit("%"))).alias("physical_progress_pct"),
        F.when(F.col("is_anomaly"), "1").otherwise("0").alias("is_anomaly"),
    )
    return typed_works(text).withColumn("sanction_amount", F.col("sanction_amount").cast("double"))


@query(works_sql("SELECT unique_work_number AS extra_field_gov, state, nodal_district, work_category, vendor_name || CASE WHEN order_key % 3 = 0 THEN ' ' ELSE '' END AS vendor_name FROM works"))
def harmonise_columns(spark: SparkSession, sf: str) -> DataFrame:
    return hz.harmonise_columns(messy_works(spark, sf)).select(
        F.col("Extra_Field_Gov").alias("extra_field_gov"), "state", "nodal_district", "work_category", "vendor_name"
    )


@query(works_sql("SELECT unique_work_number, round_even(amount * 100, 0) / 100 AS amount FROM messy", _MESSY))
def normalize_currency(spark: SparkSession, sf: str) -> DataFrame:
    m = messy_works(spark, sf)
    return m.select(
        F.col("Extra_Field_Gov").alias("unique_work_number"), round_even(parse_currency(F.col("Amount_Rs")), 2).alias("amount")
    )


@query(works_sql("SELECT unique_work_number, day FROM messy", _MESSY))
def normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    m = messy_works(spark, sf)
    return m.select(F.col("Extra_Field_Gov").alias("unique_work_number"), parse_date(F.col("Approval_Date")).alias("day"))


@query(works_sql("""SELECT unique_work_number, coalesce(CAST(day AS VARCHAR), 'Pending Approval') AS approval, physical_progress_pct AS physical FROM messy""", _MESSY))
def normalise_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = hz.normalise_rows(hz.harmonise_columns(messy_works(spark, sf)))
    return rows.select(
        F.col("Extra_Field_Gov").alias("unique_work_number"), F.col(APPROVED).alias("approval"),
        F.col("physical_progress_pct").cast("double").alias("physical"),
    )


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = hz.normalise_rows(hz.harmonise_columns(messy_works(spark, sf)))
    return va.validate_rows(rows, AS_OF, keep=("Extra_Field_Gov",))


@query(works_sql("""SELECT unique_work_number, CASE WHEN bad THEN 'bad' ELSE 'ok' END AS verdict,
  CAST(no_id AS INTEGER) + CASE WHEN amount IS NULL OR amount <= 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(fin > 100, FALSE) THEN 1 ELSE 0 END AS errors FROM judged""", _MESSY))
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select(
        F.col("Extra_Field_Gov").alias("unique_work_number"),
        F.when(F.size("errors") > 0, "bad").otherwise("ok").alias("verdict"), F.size("errors").alias("errors"),
    )


@query(works_sql("""SELECT total_rows, valid_count, total_rows - valid_count AS quarantined_count, warning_count, round_even(valid_count / total_rows * 100.0 * 100, 0) / 100 AS valid_rate_pct,
  round_even((total_rows - valid_count) / total_rows * 100.0 * 100, 0) / 100 AS quarantine_rate_pct FROM (
  SELECT CAST(count(*) AS DOUBLE) AS total_rows, CAST(count(*) FILTER (NOT bad) AS DOUBLE) AS valid_count,
    count(*) FILTER (NOT bad AND day > DATE '2001-01-01') + count(*) FILTER (NOT bad AND physical_progress_pct <= 5 AND fin >= 50) AS warning_count FROM judged)""", _MESSY))
def validation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return va.batch_stats(_checked(spark, sf))


@query(works_sql("""SELECT unique_work_number, 'FUTURE_APPROVAL' AS warning FROM judged WHERE NOT bad AND day > DATE '2001-01-01'
UNION ALL SELECT unique_work_number, 'POSSIBLE_GHOST_WORK' FROM judged WHERE NOT bad AND physical_progress_pct <= 5 AND fin >= 50""", _MESSY))
def quality_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select(
        F.col("Extra_Field_Gov").alias("unique_work_number"), F.explode("warnings").alias("warning")
    )


@query(works_sql("""SELECT unique_work_number FROM judged WHERE bad""", _MESSY))
def quarantine_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects written to the quarantine of two tasks; one task is read back."""
    path = scratch_path(spark, "quarantine")
    done = ing.ingest_frame(_csv(spark, sf), "task-a", AS_OF)
    tb.write_quarantine(done.rejects, path)
    tb.write_quarantine(done.rejects.withColumn("task_id", F.lit("task-b")), path)
    back = tb.read_quarantine(spark, path, "task-a")
    return back.select(F.get_json_object("original_row", "$.Extra_Field_Gov").alias("unique_work_number"))


@query(works_sql("""SELECT 'run-1' AS task_id, count(*) AS total_rows, count(*) FILTER (NOT bad) AS valid_count, count(*) FILTER (bad) AS quarantined_count, 'completed_with_warnings' AS status,
  count(*) FILTER (NOT bad) AS added, 0 AS updated, count(*) FILTER (NOT bad) AS total_works FROM judged""", _MESSY))
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Files to clean tables, end to end, with place repair against the member master."""
    path = scratch_path(spark, "messy.csv")
    messy_works(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    report = ing.ingest_file(
        spark, path, scratch_path(spark, "works"), scratch_path(spark, "quarantine"), "run-1", AS_OF,
        mp_master=dt.mp_master(spark, sf), fmt="csv",
    )
    return report.select("task_id", "total_rows", "valid_count", "quarantined_count", "status", "added", "updated", "total_works")


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All works as stored and every payment's work as incoming, keys repeating. A third of the stored
    numbers and half of the incoming ones are of another series, so that rows are kept and added."""
    w = dt.works(spark, sf, "order_key", "unique_work_number", "state", "sanction_amount")
    existing = w.withColumns({"note": F.lit("old"), "unique_work_number": F.concat("unique_work_number", F.when(F.col("order_key") % 3 == 0, "/old").otherwise(""))}).drop("order_key")
    line = dt.table(spark, sf, "lineitem")
    incoming = line.select(
        F.concat(dt.work_number(F.col("l_orderkey")), F.when(F.col("l_orderkey") % 2 == 1, "/new").otherwise("")).alias("unique_work_number"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("sanction_amount"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("state"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice").alias("pos"),
    )
    return existing, incoming


_UPSERT = """incoming AS (SELECT * FROM (SELECT 'W' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || CASE WHEN l_orderkey % 2 = 1 THEN '/new' ELSE '' END AS unique_work_number, CAST(l_extendedprice AS DECIMAL(18,2)) AS sanction_amount, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS state,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC, l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1),
merged AS (SELECT coalesce(n.unique_work_number, o.unique_work_number) AS unique_work_number, CASE WHEN n.unique_work_number IS NULL THEN o.state ELSE n.state END AS state,
    CAST(CASE WHEN n.unique_work_number IS NULL THEN o.sanction_amount ELSE n.sanction_amount END AS DOUBLE) AS sanction_amount, o.note,
    CASE WHEN n.unique_work_number IS NULL THEN 'kept' WHEN o.unique_work_number IS NULL THEN 'added' ELSE 'updated' END AS origin
  FROM (SELECT unique_work_number || CASE WHEN order_key % 3 = 0 THEN '/old' ELSE '' END AS unique_work_number, state, sanction_amount, 'old' AS note FROM works) o FULL JOIN incoming n USING (unique_work_number))"""


@query(works_sql("SELECT * FROM merged", _UPSERT))
def upsert_works(spark: SparkSession, sf: str) -> DataFrame:
    existing, incoming = _batches(spark, sf)
    merged = st.upsert(existing, incoming, F.col("pos")).withColumnRenamed("_origin", "origin")
    return merged.drop("pos").withColumn("sanction_amount", F.col("sanction_amount").cast("double"))


@query(works_sql("SELECT count(*) FILTER (origin = 'added') AS added, count(*) FILTER (origin = 'updated') AS updated, count(*) AS total_works FROM merged", _UPSERT))
def upsert_report(spark: SparkSession, sf: str) -> DataFrame:
    existing, incoming = _batches(spark, sf)
    return st.upsert_report(st.upsert(existing, incoming, F.col("pos")))


@query(works_sql("""SELECT unique_work_number, CASE WHEN order_key % 4 <> 0 AND order_key % 100 >= 50 THEN vendor_id ELSE coalesce(known.id, printf('V_AUTO_%05d', auto.n)) END AS vendor_id FROM works
LEFT JOIN (SELECT mp_name, max_by(vendor_id, order_key) AS id FROM works WHERE order_key % 4 <> 0 AND order_key % 100 >= 50 GROUP BY 1) known USING (mp_name)
LEFT JOIN (SELECT mp_name, row_number() OVER (ORDER BY first) AS n FROM (SELECT mp_name, min(order_key) AS first FROM works WHERE mp_name NOT IN (SELECT mp_name FROM works WHERE order_key % 4 <> 0 AND order_key % 100 >= 50)
  GROUP BY 1)) auto USING (mp_name)"""))
def assign_vendor_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Members' names in the part of vendors, so that many names have no id at all."""
    w = dt.works(spark, sf, "order_key", "unique_work_number", "vendor_id", "mp_name")
    k = F.col("order_key")
    rows = w.select(
        "order_key", "unique_work_number",
        F.when((k % 4 != 0) & (k % 100 >= 50), F.col("vendor_id")).otherwise("").alias("vendor_id"),
        F.concat(F.upper("mp_name"), F.lit(" ")).alias("vendor_name"),
    )
    return st.assign_vendor_ids(rows, [F.shiftright("order_key", 20)], k).select("unique_work_number", "vendor_id")


@query(works_sql("SELECT unique_work_number, row_number() OVER (ORDER BY order_key) AS n FROM works"))
def sequential_numbers(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "unique_work_number")
    k = F.col("order_key")
    return pr.sequential_number(w, [F.shiftright(k, 10)], k, "n").select("unique_work_number", "n")


@query(works_sql("SELECT mp_name, min(order_key) AS first_key, max(order_key) AS last_key FROM works GROUP BY 1"))
def first_and_last_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "mp_name", "work_status")
    k = F.col("order_key")
    first = pr.first_by(w, ["mp_name"], k).select("mp_name", k.alias("first_key"))
    last = pr.last_by(w, ["mp_name"], k).select("mp_name", k.alias("last_key"))
    return first.join(last, "mp_name")


@query(works_sql("SELECT unique_work_number, CAST(sanction_amount AS DOUBLE) / 10000000.0 AS crore, CAST(sanction_amount AS DOUBLE) / 100000.0 AS lakh FROM works"))
def unit_conversions(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("sanction_amount").cast("double")
    return dt.works(spark, sf, "unique_work_number", "sanction_amount").select(
        "unique_work_number", (a / CRORE).alias("crore"), (a / LAKH).alias("lakh")
    )


@query(works_sql("SELECT state, count(*) AS chunks FROM works GROUP BY 1"))
def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table is built once and read back the second time."""
    path = scratch_path(spark, "chunks")
    build = lambda: rt.work_chunks(dt.works(spark, sf))
    tb.build_or_reuse(spark, path, build)
    again = tb.build_or_reuse(spark, path, build)
    return again.groupBy("state").agg(F.count(F.lit(1)).alias("chunks"))
