"""Table schemas and the fixed vocabularies of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical column names and the lower-case headings that mean the same.
COLUMN_ALIASES = {
    "unique_work_number": [
        "work_code", "work_id", "uwn", "unique work number", "workcode",
        "work_number", "work number", "work_no",
    ],
    "state": ["state_name", "statename"],
    "nodal_district": ["district", "nodal_district_name", "nodal district", "nodaldistrict"],
    "implementing_district": ["impl_district", "implementing district", "implementingdistrict"],
    "house_name": ["house", "housename"],
    "member_type": ["membertype", "member_type_name"],
    "mp_name": ["member_name", "mp name", "mpname", "member name", "mp"],
    "constituency": ["constituency_name", "constituencyname"],
    "work_category": ["category", "work_type", "workcategory", "work category", "worktype"],
    "work_name": ["work_description", "title", "workname", "work name", "description"],
    "sanction_amount": [
        "sanction_amt", "amount_rs", "approved_cost", "amount", "sanctioned_amount",
        "sanctionamount", "sanction amount", "cost", "sanctioned_cost",
    ],
    "date_of_receipt_of_work_proposal_from_mp": [
        "proposal_date", "date_proposal", "proposaldate", "proposal date",
        "date of proposal", "receipt_date",
    ],
    "date_of_administrative_approval": [
        "approval_date", "date_approval", "admin_approval_date", "approvaldate",
        "approval date", "date of approval", "adminapprovaldate",
    ],
    "implementing_agency_name": [
        "agency", "implementing_agency", "agency_name", "agencyname",
        "implementing agency", "implementingagency",
    ],
    "vendor_id": ["vendor_code", "contractor_id", "vendorid", "vendor id", "contractorid"],
    "vendor_name": [
        "vendor", "contractor_name", "vendorname", "vendor name", "contractor",
        "contractorname",
    ],
    "work_status": [
        "status", "work_state", "project_status", "workstatus", "work status", "projectstatus",
    ],
    "physical_progress_pct": [
        "physical_progress", "physical_pct", "physicalprogress", "physical progress", "phys_pct",
    ],
    "financial_progress_pct": [
        "financial_progress", "financial_pct", "financialprogress", "financial progress",
        "fin_pct",
    ],
    "unit": ["unit_type", "unittype"],
    "note": ["notes", "remarks", "comment"],
    "payment_id": ["paymentid", "payment_code", "paymentcode"],
    "payment_date": ["paymentdate", "payment_dt", "date_payment"],
    "payment_amount": [
        "paymentamount", "paid_amount", "paidamount", "payment amount", "amount_paid",
    ],
    "pan": ["pan_number"],
    "gstin": ["gstin_number", "gst"],
    "is_hub": ["ishub", "is_hub_vendor", "hub"],
}

CURRENCY_COLUMNS = (
    "sanction_amount", "payment_amount", "category_benchmark_min", "category_benchmark_max",
)
DATE_COLUMNS = (
    "date_of_receipt_of_work_proposal_from_mp", "date_of_administrative_approval", "payment_date",
)
PERCENT_COLUMNS = ("physical_progress_pct", "financial_progress_pct")

# The strict work record: required text, the required amount, optional text, optional numbers.
REQUIRED_TEXT = ("unique_work_number", "state", "nodal_district")
OPTIONAL_TEXT = (
    "implementing_district", "house_name", "member_type", "mp_name", "constituency",
    "work_category", "work_name", "date_of_receipt_of_work_proposal_from_mp",
    "date_of_administrative_approval", "implementing_agency_name", "vendor_id", "vendor_name",
    "work_status", "unit", "note", "is_anomaly", "anomaly_type",
)
OPTIONAL_NUMBERS = (
    "physical_progress_pct", "financial_progress_pct",
    "category_benchmark_min", "category_benchmark_max",
)

# Other names of states, lower case to canonical.
PLACE_ALIASES = {
    "j & k": "Jammu And Kashmir",
    "j&k": "Jammu And Kashmir",
    "jammu & kashmir": "Jammu And Kashmir",
    "up": "Uttar Pradesh",
    "u.p.": "Uttar Pradesh",
    "mp": "Madhya Pradesh",
    "m.p.": "Madhya Pradesh",
    "ap": "Andhra Pradesh",
    "a.p.": "Andhra Pradesh",
    "tn": "Tamil Nadu",
    "t.n.": "Tamil Nadu",
    "wb": "West Bengal",
    "w.b.": "West Bengal",
    "hp": "Himachal Pradesh",
    "h.p.": "Himachal Pradesh",
    "uk": "Uttarakhand",
    "u.k.": "Uttarakhand",
    "delhi": "NCT of Delhi",
    "nct of delhi": "Delhi",
}

# District centroids and the one used for unknown districts.
DISTRICT_CENTROIDS = {
    "pune": (18.5204, 73.8567),
    "hingoli": (19.7196, 77.1478),
    "mumbai": (19.076, 72.8777),
    "nagpur": (21.1458, 79.0882),
    "nashik": (19.9975, 73.7898),
    "varanasi": (25.3176, 82.9739),
    "chennai": (13.0827, 80.2707),
    "bengaluru": (12.9716, 77.5946),
}
DEFAULT_CENTROID = (18.5204, 73.8567)

RISK_SIGNAL = T.StructType(
    [
        T.StructField("signal_type", T.StringType(), False),
        T.StructField("severity", T.DoubleType(), False),
        T.StructField("reason", T.StringType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


class InsufficientDataError(ValueError):
    """A whole input is too small for the operator to mean anything."""

    def __init__(self, operator: str, reason: str):
        super().__init__(f"[{operator}] {reason}")
        self.operator = operator
        self.reason = reason
