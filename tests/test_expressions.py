"""Column expressions on known values."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from fundlens.functions.dates import normalize_date
from fundlens.functions.geo import dms_to_decimal
from fundlens.functions.money import normalize_currency
from fundlens.functions.names import clean_company_name, registration_key, vendor_key
from fundlens.functions.numbers import number_prefix_or_zero, round_even, round_up, to_number
from fundlens.operators import audit, complaints, harmonise, invoices, photos, scoring


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_currency(spark):
    cases = {
        "₹ 25.5 Lakhs": 2550000.0, "1.4 Cr": 14000000.0, "Rs. 25,00,000/-": 2500000.0, "500000": 500000.0,
        "2.5 L": 250000.0, "N/A - Not Applicable": None, "": None, None: None, "25 lac": None,
        "INR 14,00,000": 1400000.0, "5k": 5000.0, "1.5d": None,
    }
    assert column(spark, list(cases), normalize_currency) == pytest.approx(list(cases.values()))


def test_date(spark):
    d = dtm.date(2023, 4, 15)
    cases = {
        "15/04/2023": d, "15-Apr-2023": d, "45031": d, "2024-01-30": dtm.date(2024, 1, 30), "Pending Approval": None,
        "April 15, 2023": d, "15 april 2023": d, "15.04.2023": d, "31/02/2023": None, "2023/4/15": d, "": None,
        None: None, "200001": None, "15-Foo-2023": None,
    }
    assert column(spark, list(cases), normalize_date) == list(cases.values())


def test_numbers(spark):
    assert column(spark, ["12", " 1.5e3 ", "0x10", "1d", "-.5", "nan"], to_number) == [12.0, 1500.0, None, None, -0.5, None]
    assert column(spark, ["12.5abc", "abc", "", None, "-3 kg"], number_prefix_or_zero) == [12.5, 0.0, 0.0, 0.0, -3.0]
    assert column(spark, [0.5, 1.5, 2.5, -0.5], round_even, "double") == [0.0, 2.0, 2.0, 0.0]
    assert column(spark, [0.5, 1.5, 2.5, -0.5], round_up, "double") == [1.0, 2.0, 3.0, 0.0]


def test_names(spark):
    names = ["Jai Construction Corporation", "Jai Construction Pvt Ltd", "A & B Co.", "Pvt. Ltd."]
    assert column(spark, names, clean_company_name) == ["jai construction", "jai construction", "a b", ""]
    assert column(spark, [" ab-c 12", "  ", None], vendor_key) == ["ABC12", None, None]
    assert column(spark, ["abcde-1234f", "short"], lambda c: registration_key(c, 10)) == ["ABCDE1234F", None]


def test_dms(spark):
    df = spark.createDataFrame([(28, 36, 50.04, "N"), (72, 30, 0.0, "W")], "d int, m int, s double, r string")
    got = [r.x for r in df.select(dms_to_decimal(F.col("d"), F.col("m"), F.col("s"), F.col("r")).alias("x")).collect()]
    assert got == pytest.approx([28.6139, -72.5])


def test_harmonise_last_column_wins(spark):
    df = spark.createDataFrame([("W1", "KA", "x", "TN")], ["Work_Code", "State_Name", "Extra_Field_Gov", " STATE "])
    assert harmonise.harmonise_columns(df).first().asDict() == {
        "unique_work_number": "W1", "state": "TN", "Extra_Field_Gov": "x",
    }


def test_invoice_fields(spark):
    texts = [
        "Rs. 12,34,567", "Rs 5,00,000.50", "2.5 Lakh", "1.2 Crore", "INR 45,678",
        "M/s Sharma Builders.,\nInvoice 12-Jan-2024, also 2024-02-01\nTotal Rs. 100 and 1 lakh",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string")
    rows = invoices.parse_invoice(df).orderBy("i").collect()
    assert [r.amount for r in rows] == pytest.approx([1234567, 500000.5, 250000, 12000000, 45678, 100000])
    assert (rows[5].vendor_name, rows[5].invoice_date) == ("Sharma Builders", "12-Jan-2024")
    assert rows[0].invoice_date is None and len(rows[0].notes) == 2


def test_invoice_diff(spark):
    parsed = spark.createDataFrame(
        [(1, 100.0, "1/1/2024", "Acme", 80.0, "1/1/2024", "ACME "), (2, 100.0, None, None, 0.0, "1/1/2024", None)],
        "k int, amount double, invoice_date string, vendor_name string, sanctioned_amount double, sanctioned_date string, sanctioned_vendor string",
    )
    diffs = invoices.diff_against_sanction(parsed, "k")
    got = {(r.k, r.field_name): r.discrepancy for r in diffs.collect()}
    assert got == {(1, "amount"): 25.0, (1, "date"): 0.0, (1, "vendor_name"): 0.0, (2, "amount"): None, (2, "date"): None}
    kinds = sorted((r.k, r.signal_type) for r in invoices.invoice_signals(diffs, "k").collect())
    assert kinds == [(1, "AMOUNT_MISMATCH"), (2, "OCR_FIELD_MISSING"), (2, "OCR_FIELD_MISSING")]


def test_triage_reply(spark):
    rows = [
        (1, "Bridge collapsed", '```json\n{"urgency": "LOW", "category": "Road", "summary": "s"}\n```'),
        (2, "Bridge collapsed", "no json here"),
        (3, "Pipe leak", '{"urgency": "LOW", "category": "Road"}'),
        (4, "  ", None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, reply string")
    got = {r.id: (r.urgency, r.category, r.used_fallback) for r in complaints.triage(df, reply="reply").collect()}
    assert got == {1: ("LOW", "Road", False), 2: ("HIGH", "Road", True), 3: ("MEDIUM", "Other", True)}


def test_audit(spark):
    rows = [
        ("Total works: 12937", "There are 99999 works and the budget is 5000 Crore."),
        ("Total works: 12,937", "There are 12937 works."),
        ("x", "This information is not available in the current data."),
        ("", "Anything"),
    ]
    df = spark.createDataFrame(rows, "context string, answer string")
    got = [(r.confidence, list(r.novel), r.used_fallback) for r in audit.audit_answers(df).collect()]
    assert got == [
        ("MEDIUM", ["5000", "99999"], False), ("HIGH", [], False), ("LOW", [], False), ("LOW", [], True),
    ]


def test_geofence(spark):
    rows = [(1, 28.6145, 77.2092, 28.6139, 77.2090), (2, 28.6145, 77.2092, 19.0760, 72.8777), (3, None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id int, gps_lat double, gps_lon double, claimed_lat double, claimed_lon double")
    a, b, c = photos.geofence_check(df).orderBy("image_id").collect()
    assert a.is_within_threshold and a.distance_km < 0.2
    assert b.is_within_threshold is False and b.distance_km > 1000
    assert c.is_within_threshold is None and c.distance_km is None


def test_score_without_data(spark):
    df = spark.createDataFrame(
        [("p", 1000.0, "Road", "X", 7, "V", 0, 0, 0, None, None)],
        "proposal_id string, sanction_amount double, category string, region string, season_month int, vendor_id string, "
        "vendor_past_delays int, vendor_past_anomalies int, vendor_total_projects int, category_benchmark_amount double, region_risk_score double",
    )
    row = scoring.score_proposals(df).first()
    assert row.risk_level == "INSUFFICIENT_DATA"
    assert row.overall_score == pytest.approx(0.185)
    assert [round(f.contribution, 4) for f in row.factors] == [0, 0, 0, 0.105, 0.08, 0]
