"""Complaints, feedback, invoices, retrieval and answer audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.numbers import round_even
from fundlens.operators import alerts as al
from fundlens.operators import audit as au
from fundlens.operators import complaints as cp
from fundlens.operators import invoices as iv
from fundlens.operators import retrieval as rt
from fundlens.plans import common as cm
from fundlens.plans.common import works_sql
from fundlens.plans.registry import query
from fundlens.sources import driver_tables as dt

# ---- complaints rendered from works -------------------------------------------------------

# (text before the place, text after it, urgency, category) by order key modulo 8.
_TEMPLATES = (
    ("The road culvert near ", " collapsed last night and is dangerous. Please act.", "HIGH", "Road"),
    ("Water pipeline in ", " is leaking and the tank is broken for weeks, nobody has come to repair it although the office promised.", "MEDIUM", "Water Supply"),
    ("Request for new street lamp at ", ".", "LOW", "Electricity"),
    ("School class room work in ", " is delayed and incomplete.", "MEDIUM", "Education"),
    ("Thank you for the good work in ", "!", "LOW", "Other"),
    ("Sewage overflow\nnear hospital at ", ", garbage everywhere.", "HIGH", "Sanitation"),
    ("Cement structure cracked in ", ", urgent inspection needed before an accident happens to people who pass there every single day.", "HIGH", "Infrastructure"),
    ("Community hall auditorium at ", " still pending.", "MEDIUM", "Community Hall"),
)


def _complaints(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "unique_work_number", "nodal_district")
    at = (F.col("order_key") % 8 + 1).cast("int")
    head = F.element_at(F.array(*[F.lit(t[0]) for t in _TEMPLATES]), at)
    tail = F.element_at(F.array(*[F.lit(t[1]) for t in _TEMPLATES]), at)
    return w.select(
        F.col("unique_work_number").alias("id"), "order_key",
        F.concat(head, F.col("nodal_district"), tail).alias("text"),
    )


def _pick(i: int) -> str:
    values = ", ".join("'" + t[i].replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in _TEMPLATES)
    return f"list_extract([{values}], order_key % 8 + 1)"


_COMPLAINTS = f"""complaints AS (SELECT unique_work_number AS id, order_key, {_pick(0)} || nodal_district || {_pick(1)} AS text, {_pick(2)} AS urgency, {_pick(3)} AS category FROM works),
triaged AS (SELECT *, CASE WHEN length(text) > 100 THEN trim(replace(substr(text, 1, 100), chr(10), ' ')) || '…' ELSE trim(replace(text, chr(10), ' ')) END AS summary FROM complaints)"""


@query(works_sql("SELECT id, urgency, category, summary FROM triaged", _COMPLAINTS))
def triage_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return cp.triage(_complaints(spark, sf)).select("id", "urgency", "category", "summary")


@query(works_sql("""SELECT id, CASE WHEN order_key % 5 < 2 THEN 'LOW' ELSE urgency END AS urgency, CASE WHEN order_key % 5 < 2 THEN 'Health' ELSE category END AS category,
  CASE WHEN order_key % 5 < 2 THEN 'reply ' || id ELSE summary END AS summary, order_key % 5 >= 2 AS used_fallback FROM triaged""", _COMPLAINTS))
def triage_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies: fenced, amid text, cut off, with an illegal urgency, missing."""
    good = F.concat(F.lit('{"urgency": "LOW", "category": "Health", "summary": "reply '), "id", F.lit('"}'))
    kind = F.col("order_key") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here it is: "), good, F.lit(" as asked.")))
        .when(kind == 2, F.substring(good, 1, 30))
        .when(kind == 3, F.regexp_replace(good, "LOW", "SOON"))
    )
    c = _complaints(spark, sf).withColumn("reply", reply)
    return cp.triage(c, reply="reply").select("id", "urgency", "category", "summary", "used_fallback")


_RULE_HIGH = " OR ".join(f"contains(lower(text), '{w}')" for w in cp.RULE_HIGH_WORDS)
_RULE_MEDIUM = " OR ".join(f"contains(lower(text), '{w}')" for w in cp.RULE_MEDIUM_WORDS)


@query(works_sql(f"""SELECT id, CASE WHEN h THEN 'HIGH' WHEN m THEN 'MEDIUM' ELSE 'LOW' END AS urgency, CASE WHEN h THEN 1.0 WHEN m THEN 0.5 ELSE 0.1 END AS urgency_score, h AS is_safety_hazard,
  CASE WHEN h AND (contains(lower(text), 'road') OR contains(lower(text), 'culvert')) THEN 'Road' WHEN h THEN 'Infrastructure' WHEN m AND contains(lower(text), 'water') THEN 'Water Supply' WHEN m THEN 'Infrastructure' ELSE 'Other' END AS category
FROM (SELECT *, {_RULE_HIGH} AS h, {_RULE_MEDIUM} AS m FROM complaints)""", _COMPLAINTS))
def rule_triage(spark: SparkSession, sf: str) -> DataFrame:
    return cp.rule_triage(_complaints(spark, sf)).select("id", "urgency", "urgency_score", "is_safety_hazard", "category")


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """What people wrote: all documents and the users' turns of all conversations."""
    turns = dt.table(spark, sf, "conversations").where("role = 'user'")
    return dt.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text").unionByName(
        turns.select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("id"), "text")
    )


# The other engine's \\b knows ASCII only: the patterns' edges are spelled out.
_EDGE = "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"


def _hit(pattern: str) -> str:
    inner = pattern.removeprefix("\\b").removesuffix("\\b")
    return f"regexp_matches(text, '(?i)(?:^|{_EDGE}){inner}(?:{_EDGE}|$)')"


_SAID = f"""said AS (SELECT 'doc-' || doc_id AS id, text FROM documents UNION ALL SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'),
heard AS (SELECT *, CASE WHEN {_hit(cp.HIGH_URGENCY)} THEN 'HIGH' WHEN {_hit(cp.MEDIUM_URGENCY)} THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
  CASE {' '.join(f"WHEN {_hit(p)} THEN '{name}'" for name, p in cp.CATEGORY_PATTERNS.items())} ELSE 'Other' END AS category,
  CASE WHEN length(text) > 100 THEN trim(replace(substr(text, 1, 100), chr(10), ' ')) || '…' ELSE trim(replace(text, chr(10), ' ')) END AS summary
FROM said WHERE trim(text) <> '')"""


@query(cm.with_ctes(_SAID, body="SELECT id, urgency, category, summary FROM heard"))
def triage_texts(spark: SparkSession, sf: str) -> DataFrame:
    return cp.triage(_said(spark, sf)).select("id", "urgency", "category", "summary")


@query(cm.with_ctes(_SAID, body=f"""SELECT id, CASE WHEN h THEN 'HIGH' WHEN m THEN 'MEDIUM' ELSE 'LOW' END AS urgency, CASE WHEN h THEN 1.0 WHEN m THEN 0.5 ELSE 0.1 END AS urgency_score, h AS is_safety_hazard,
  CASE WHEN h AND (contains(lower(text), 'road') OR contains(lower(text), 'culvert')) THEN 'Road' WHEN h THEN 'Infrastructure' WHEN m AND contains(lower(text), 'water') THEN 'Water Supply' WHEN m THEN 'Infrastructure' ELSE 'Other' END AS category
FROM (SELECT *, {_RULE_HIGH} AS h, {_RULE_MEDIUM} AS m FROM said WHERE trim(text) <> '')"""))
def rule_triage_texts(spark: SparkSession, sf: str) -> DataFrame:
    return cp.rule_triage(_said(spark, sf)).select("id", "urgency", "urgency_score", "is_safety_hazard", "category")


# ---- citizen feedback ---------------------------------------------------------------------


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback from complaints: some without a work, some on unknown works, some with GPS."""
    k = F.col("order_key")
    return _complaints(spark, sf).select(
        k.alias("feedback_id"),
        F.when(k % 11 == 0, "").when(k % 11 == 1, F.concat(F.lit("X"), "id")).otherwise(F.col("id")).alias("work_id"),
        F.when(k % 13 == 0, F.lit("too short")).otherwise(F.col("text")).alias("feedback_text"),
        F.when(k % 3 > 0, 18.5204 + (k % 4) * 0.004).alias("latitude"),
        F.when(k % 3 > 0, 73.8567 + (k % 5) * 0.004).alias("longitude"),
    )


_HAZARD = " OR ".join(f"contains(lower(feedback_text), '{w}')" for w in cp.HAZARD_WORDS)
FEEDBACK_SQL = f"""feedback AS (SELECT order_key AS feedback_id, CASE WHEN order_key % 11 = 0 THEN '' WHEN order_key % 11 = 1 THEN 'X' || id ELSE id END AS work_id,
    CASE WHEN order_key % 13 = 0 THEN 'too short' ELSE text END AS feedback_text,
    CASE WHEN order_key % 3 > 0 THEN 18.5204::DOUBLE + (order_key % 4) * 0.004::DOUBLE END AS latitude, CASE WHEN order_key % 3 > 0 THEN 73.8567::DOUBLE + (order_key % 5) * 0.004::DOUBLE END AS longitude FROM complaints),
assessed AS (SELECT *, CASE WHEN hazard THEN 'HIGH' WHEN length(feedback_text) > 80 THEN 'MEDIUM' ELSE 'LOW' END AS urgency, coalesce(distance_km > 1.0, FALSE) AS gps_mismatch, hazard OR coalesce(distance_km > 1.0, FALSE) AS is_high_risk
  FROM (SELECT *, {_HAZARD} AS hazard, round_even(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) * 1000, 0) / 1000 AS distance_km FROM (
    SELECT *, pow(sin(radians(18.5204::DOUBLE - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(18.5204::DOUBLE)) * pow(sin(radians(73.8567::DOUBLE - longitude) / 2), 2) AS h
    FROM feedback WHERE length(trim(feedback_text)) >= 10 AND work_id <> '' AND work_id NOT LIKE 'X%')))"""


def assessed_feedback(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "unique_work_number", "nodal_district")
    return cp.assess_feedback(cp.split_feedback(feedback(spark, sf), works)[0])


@query(works_sql("SELECT feedback_id, urgency, distance_km, gps_mismatch, is_high_risk, CASE WHEN is_high_risk THEN 'HIGH' ELSE 'LOW' END AS severity FROM assessed", _COMPLAINTS, FEEDBACK_SQL))
def assess_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return assessed_feedback(spark, sf).select("feedback_id", "urgency", "distance_km", "gps_mismatch", "is_high_risk", "severity")


@query(works_sql("""SELECT feedback_id, CASE WHEN work_id = '' THEN 'work_id is required' WHEN length(trim(feedback_text)) < 10 THEN 'feedback_text is too short' ELSE 'work not found' END AS reject_reason
FROM feedback WHERE work_id = '' OR length(trim(feedback_text)) < 10 OR work_id LIKE 'X%'""", _COMPLAINTS, FEEDBACK_SQL))
def rejected_feedback(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "unique_work_number", "nodal_district")
    return cp.split_feedback(feedback(spark, sf), works)[1].select("feedback_id", "reject_reason")


@query(works_sql("""SELECT 'ALT-CITIZEN-' || feedback_id AS alert_id, work_id, 0.88 AS risk_score, 'CITIZEN_REPORTED' AS source, TIMESTAMP '1998-06-15 12:00:00' + INTERVAL 72 HOUR AS sla_deadline FROM assessed WHERE is_high_risk""", _COMPLAINTS, FEEDBACK_SQL))
def feedback_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return al.feedback_alerts(assessed_feedback(spark, sf), cm.as_of()).select(
        "alert_id", "work_id", "risk_score", "source", "sla_deadline"
    )


@query(works_sql("""SELECT unique_work_number, 18.5204 AS site_lat, 73.8567 AS site_lon FROM works WHERE order_key % 2 = 0
UNION ALL SELECT unique_work_number, 21.1458, 79.0882 FROM works WHERE order_key % 2 = 1"""))
def site_centroids(spark: SparkSession, sf: str) -> DataFrame:
    w = dt.works(spark, sf, "order_key", "unique_work_number", "nodal_district")
    named = w.withColumn("nodal_district", F.when(F.col("order_key") % 2 == 1, " Nagpur").otherwise(F.col("nodal_district")))
    return cp.with_site_centroid(named).select("unique_work_number", "site_lat", "site_lon")


# ---- document similarity ------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in cp.STOP_WORDS)
_VECTORS = f"""texts AS (SELECT min(doc_id) AS rep, text, count(*) AS copies FROM documents GROUP BY text),
tok AS (SELECT rep, copies, token, count(*) AS tf FROM (SELECT rep, copies, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM texts) WHERE token NOT IN ({_STOPS}) GROUP BY 1, 2, 3),
raw AS (SELECT rep, token, tf * (ln((1.0 + (SELECT sum(copies) FROM texts)) / (1.0 + df)) + 1.0) AS r FROM tok JOIN (SELECT token, sum(copies) AS df FROM tok GROUP BY 1) USING (token)),
vec AS (SELECT rep, token, r / sqrt(sum(r * r) OVER (PARTITION BY rep)) AS w FROM raw)"""
_COSINES = """cosines AS (SELECT x.rep AS rep_a, y.rep AS rep_b, sum(x.w * y.w) AS similarity FROM vec x JOIN vec y ON x.token = y.token AND x.rep < y.rep GROUP BY 1, 2 HAVING sum(x.w * y.w) >= {})"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return cp.distinct_texts(dt.table(spark, sf, "documents"), "doc_id", "text")


@query(cm.with_ctes(_VECTORS, body="SELECT rep, token, round_even(w * 1000000, 0) / 1000000 AS w FROM vec"))
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return cp.tfidf(_texts(spark, sf)).select("rep", "token", round_even(F.col("w"), 6).alias("w"))


@query(cm.with_ctes(_VECTORS, _COSINES.format(0.8), body="SELECT rep_a, rep_b, round_even(similarity * 1000000, 0) / 1000000 AS similarity FROM cosines"))
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cp.cosine_pairs(cp.text_rows(_texts(spark, sf)), 0.8)
    return pairs.withColumn("similarity", round_even(F.col("similarity"), 6))


_DOC_CLUSTERS = """links AS (SELECT rep_a AS a, rep_b AS b FROM cosines),
closure AS (SELECT a AS node, a AS reached FROM links UNION SELECT b, b FROM links
  UNION SELECT node, CASE WHEN l.a = reached THEN l.b ELSE l.a END FROM closure JOIN links l ON l.a = reached OR l.b = reached),
parts AS (SELECT node, min(reached) AS component FROM closure GROUP BY node),
members AS (SELECT doc_id, coalesce(component, rep) AS cluster_id FROM documents JOIN texts USING (text) LEFT JOIN parts ON node = rep WHERE rep IN (SELECT rep FROM tok)),
sized AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM members)"""


@query("WITH RECURSIVE " + ",\n".join((_VECTORS, _COSINES.format(0.6), _DOC_CLUSTERS)) + "\nSELECT doc_id, cluster_id, size FROM sized WHERE size > 1")
def complaint_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cp.cluster_complaints(dt.table(spark, sf, "documents"), "doc_id", "text", cp.similarity_threshold(0.4))


@query("WITH RECURSIVE " + ",\n".join((_VECTORS, _COSINES.format(0.6), _DOC_CLUSTERS)) + """
SELECT s.doc_id, cluster_id, round_even(coalesce((SELECT sum(x.w * y.w) FROM vec x JOIN vec y ON x.token = y.token WHERE x.rep = cluster_id AND y.rep = t.rep), 0) * 1000000, 0) / 1000000 AS similarity
FROM sized s JOIN documents d USING (doc_id) JOIN texts t USING (text) WHERE size > 1""")
def cluster_similarities(spark: SparkSession, sf: str) -> DataFrame:
    docs = dt.table(spark, sf, "documents")
    texts = _texts(spark, sf)
    rows = cp.text_rows(texts)
    members = cp.cluster_members(docs, "doc_id", "text", 0.6, texts, rows)
    return cp.similarity_to_representative(members, rows).select(
        "doc_id", "cluster_id", round_even(F.col("similarity"), 6).alias("similarity")
    )


@query("WITH RECURSIVE " + ",\n".join((_VECTORS, _COSINES.format(0.6), _DOC_CLUSTERS, _SAID)) + """
SELECT id AS subject_id, 'HIGH_URGENCY_COMPLAINT' AS signal_type, CAST(0.9 AS DOUBLE) AS severity, 'High-urgency complaint: ' || summary AS reason FROM heard WHERE urgency = 'HIGH'
UNION ALL SELECT DISTINCT CAST(cluster_id AS VARCHAR), 'DUPLICATE_COMPLAINTS', least(CAST(0.8 AS DOUBLE), CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * size), size || ' near-duplicate complaints.' FROM sized WHERE size > 1""")
def complaint_signals(spark: SparkSession, sf: str) -> DataFrame:
    clusters = cp.cluster_complaints(dt.table(spark, sf, "documents"), "doc_id", "text", cp.similarity_threshold(0.4))
    return cp.complaint_signals(cp.triage(_said(spark, sf)), clusters)


# ---- invoices -----------------------------------------------------------------------------


def _invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice texts of works: amount in digits or lakh, date in three layouts, defects in some."""
    w = dt.works(spark, sf, "order_key", "unique_work_number", "sanction_amount", "date_of_administrative_approval", "vendor_name")
    k = F.col("order_key")
    day = F.col("date_of_administrative_approval")
    billed = F.when(k % 5 == 0, F.col("sanction_amount") * 2).otherwise(F.col("sanction_amount"))
    digits = F.format_number(billed.cast("decimal(18,2)"), 2)
    lakh = F.concat((billed / 100000).cast("decimal(18,7)").cast("string"), F.lit(" Lakh"))
    amount = F.when(k % 3 == 0, F.concat(F.lit("Rs. "), digits)).when(k % 3 == 1, F.concat(F.lit("₹"), digits)).otherwise(lakh)
    date = F.when(k % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MMM-yyyy"))
    vendor = F.when(k % 4 == 0, F.concat(F.lit("M/s "), "vendor_name", F.lit("."))).otherwise(F.concat(F.lit("Vendor: "), "vendor_name", F.lit(" ")))
    text = F.concat_ws(
        "\n",
        F.lit("TAX INVOICE"),
        F.when(k % 7 != 0, vendor),
        F.when(k % 6 != 0, F.concat(F.lit("Date "), date)),
        F.when(k % 9 != 0, F.concat(F.lit("Advance Rs 100, total "), amount, F.lit(" only"))),
    )
    return w.select(
        F.col("unique_work_number").alias("invoice_id"), text.alias("raw_text"),
        F.col("sanction_amount").alias("sanctioned_amount"),
        F.date_format(day, "dd/MM/yyyy").alias("sanctioned_date"),
        F.upper("vendor_name").alias("sanctioned_vendor"),
    )


_INVOICES = """inv AS (SELECT unique_work_number AS invoice_id, CAST(sanction_amount AS DOUBLE) AS agreed,
    CASE WHEN order_key % 9 <> 0 THEN CASE WHEN order_key % 5 = 0 THEN CAST(sanction_amount * 2 AS DOUBLE) ELSE CAST(sanction_amount AS DOUBLE) END END AS amount,
    CASE WHEN order_key % 6 <> 0 THEN CASE WHEN order_key % 2 = 0 THEN strftime(date_of_administrative_approval, '%d/%m/%Y') ELSE strftime(date_of_administrative_approval, '%d-%b-%Y') END END AS invoice_date,
    CASE WHEN order_key % 7 <> 0 THEN vendor_name END AS vendor_name, order_key % 2 = 0 AS same_layout,
    strftime(date_of_administrative_approval, '%d/%m/%Y') AS sanctioned_date FROM works),
diffs AS (
  SELECT invoice_id, 'amount' AS field_name, round_even((amount - agreed) / agreed * 100 * 100, 0) / 100 AS discrepancy,
    CASE WHEN amount IS NULL THEN 'Amount could not be extracted from the document.' WHEN abs((amount - agreed) / agreed * 100) > 5 THEN 'Amount ' || format('{:,.2f}', amount) || ' differs from sanctioned ' || format('{:,.2f}', agreed) || ' by ' || printf('%+.1f', (amount - agreed) / agreed * 100) || '%.'
      ELSE 'Amount is within tolerance.' END AS reason FROM inv
  UNION ALL SELECT invoice_id, 'date', CASE WHEN invoice_date IS NULL THEN NULL WHEN same_layout THEN 0.0 ELSE 1.0 END,
    CASE WHEN invoice_date IS NULL THEN 'Date could not be extracted from the document.' WHEN same_layout THEN 'Date matches.' ELSE 'Date ' || chr(39) || invoice_date || chr(39) || ' differs from sanctioned ' || chr(39) || sanctioned_date || chr(39) || '.' END FROM inv
  UNION ALL SELECT invoice_id, 'vendor_name', CASE WHEN vendor_name IS NOT NULL THEN 0.0 END, CASE WHEN vendor_name IS NULL THEN 'Vendor could not be extracted from the document.' ELSE 'Vendor matches.' END FROM inv)"""


@query(works_sql("SELECT invoice_id, round_even(amount * 100, 0) / 100 AS amount, invoice_date, vendor_name FROM inv", _INVOICES))
def parse_invoices(spark: SparkSession, sf: str) -> DataFrame:
    return iv.parse_invoice(_invoices(spark, sf)).select(
        "invoice_id", round_even(F.col("amount"), 2).alias("amount"), "invoice_date", "vendor_name"
    )


@query(works_sql("SELECT * FROM diffs", _INVOICES))
def invoice_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return iv.diff_against_sanction(iv.parse_invoice(_invoices(spark, sf)), "invoice_id").select(
        "invoice_id", "field_name", "discrepancy", "reason"
    )


@query(works_sql("""SELECT invoice_id, CASE WHEN discrepancy IS NULL THEN 'OCR_FIELD_MISSING' WHEN field_name = 'amount' THEN 'AMOUNT_MISMATCH' ELSE upper(field_name) || '_MISMATCH' END AS signal_type,
  CASE WHEN discrepancy IS NULL THEN 0.3 WHEN field_name = 'amount' THEN round_even(least(1.0, abs(discrepancy) / 100) * 1000, 0) / 1000 ELSE 0.5 END AS severity, reason
FROM diffs WHERE discrepancy IS NULL OR (field_name = 'amount' AND abs(discrepancy) > 5) OR (field_name <> 'amount' AND discrepancy = 1)""", _INVOICES))
def invoice_signals(spark: SparkSession, sf: str) -> DataFrame:
    diffs = iv.diff_against_sanction(iv.parse_invoice(_invoices(spark, sf)), "invoice_id")
    return iv.invoice_signals(diffs, "invoice_id")


@query(works_sql("SELECT invoice_id, CASE WHEN amount IS NULL THEN 0 ELSE 0.9 END AS amount_confidence, CASE WHEN invoice_date IS NULL THEN 0 ELSE 0.85 END AS date_confidence, CASE WHEN vendor_name IS NULL THEN 0 ELSE 0.8 END AS vendor_confidence FROM inv".replace("amount IS NULL", "invoice_id IN (SELECT unique_work_number FROM works WHERE order_key % 9 = 0)"), _INVOICES))
def invoice_confidences(spark: SparkSession, sf: str) -> DataFrame:
    return iv.field_confidences(iv.parse_invoice(_invoices(spark, sf)), "invoice_id")


# ---- retrieval ----------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return rt.chunk_table(
        dt.works(spark, sf), dt.vendors(spark, sf), dt.mp_master(spark, sf)
    )


_RUPEES = "CAST(round_even(CAST({} AS DOUBLE), 0) AS BIGINT)"
_WORK_TEXT = f"""concat_ws('; ', 'work=' || unique_work_number, 'title=' || work_name, 'kind=' || work_category, 'district=' || implementing_district, 'state=' || state,
  'member=' || mp_name, 'seat=' || constituency, 'agency=' || implementing_agency_name, 'vendor=' || vendor_name, 'vendor_id=' || vendor_id, 'rupees=' || {_RUPEES.format("sanction_amount")},
  'stage=' || work_status, 'built_pct=' || printf('%.1f', physical_progress_pct), 'paid_pct=' || printf('%.1f', financial_progress_pct), CASE WHEN is_anomaly THEN 'flagged=' || anomaly_type END)"""


@query(works_sql(f"SELECT 'work:' || unique_work_number AS chunk_id, 'work' AS type, state, {_WORK_TEXT} AS text FROM works"))
def work_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return rt.work_chunks(dt.works(spark, sf))


@query(cm.with_ctes(dt.VENDORS_SQL, dt.MP_MASTER_SQL, dt.PAYMENTS_SQL, body=f"""SELECT chunk_id, type, text FROM (
  SELECT 'vendor:' || vendor_id AS chunk_id, 'vendor' AS type, concat_ws('; ', 'vendor_id=' || vendor_id, 'vendor=' || vendor_name, 'state=' || state, CASE WHEN is_hub THEN 'hub=yes' END) AS text FROM vendors
  UNION ALL SELECT 'mp:' || mp_name, 'mp', concat_ws('; ', 'member=' || mp_name, 'seat=' || constituency, 'state=' || state) FROM mp_master
  UNION ALL SELECT 'payment:' || payment_id, 'payment', concat_ws('; ', 'paid_for=' || unique_work_number, 'day=' || payment_date, 'instalment=' || payment_type, 'vendor_id=' || vendor_id, 'rupees=' || {_RUPEES.format("payment_amount")}) FROM payments)"""))
def master_chunks(spark: SparkSession, sf: str) -> DataFrame:
    parts = rt.vendor_chunks(dt.vendors(spark, sf)).unionByName(rt.mp_chunks(dt.mp_master(spark, sf)))
    return parts.unionByName(rt.payment_chunks(dt.payments(spark, sf), F.col("payment_id"))).drop("state")


_SUMS = "count(*) AS n, sum(sanction_amount) AS amount, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (work_status = 'Stalled') AS stalled"
_RATE = "'flagged_pct=' || printf('%.1f', round_even(CAST(anomalies AS DOUBLE) / n * 100 * 10, 0) / 10)"


def _group_chunks(scope: str, name: str, column: str, rest: str = "") -> str:
    return f"""SELECT 'summary:{scope}:' || {column}, concat_ws('; ', 'about={name}', '{name}=' || {column}, 'works=' || n, 'rupees=' || {_RUPEES.format("amount")}, 'stalled=' || stalled, 'flagged=' || anomalies, {_RATE})
  FROM (SELECT {column}, {_SUMS} FROM works GROUP BY 1 {rest})"""


@query(works_sql(f"""SELECT 'summary:global' AS chunk_id, concat_ws('; ', 'about=all works', 'works=' || n, 'rupees=' || {_RUPEES.format("amount")}, 'members=' || (SELECT count(*) FROM mp_master),
    'vendors=' || (SELECT count(*) FROM vendors), 'hub_vendors=' || (SELECT count(*) FROM vendors WHERE is_hub), 'recommended=0', 'running=' || progress, 'stalled=' || stalled, 'completed=' || completed, 'flagged=' || anomalies, {_RATE}) AS text
FROM (SELECT {_SUMS}, count(*) FILTER (work_status = 'Completed') AS completed, count(*) FILTER (work_status = 'Work in Progress') AS progress FROM works)
UNION ALL SELECT 'summary:status', 'about=stages; works=' || string_agg(work_status || ' ' || n, ', ' ORDER BY n DESC, work_status) FROM (SELECT work_status, count(*) AS n FROM works GROUP BY 1)
UNION ALL SELECT 'summary:anomaly_types', concat_ws('; ', 'about=flags', 'kinds=' || (SELECT string_agg(anomaly_type || ' ' || k, ', ' ORDER BY k DESC, anomaly_type) FROM (SELECT anomaly_type, count(*) AS k FROM works WHERE is_anomaly GROUP BY 1)),
    'flagged=' || anomalies, 'works=' || n, {_RATE}) FROM (SELECT {_SUMS} FROM works)
UNION ALL {_group_chunks("state", "state", "state")}
UNION ALL {_group_chunks("category", "kind", "work_category")}
UNION ALL {_group_chunks("mp", "member", "mp_name", "ORDER BY n DESC, mp_name LIMIT 30")}""", dt.VENDORS_SQL, dt.MP_MASTER_SQL))
def summary_chunks(spark: SparkSession, sf: str) -> DataFrame:
    works = dt.works(spark, sf, "state", "work_category", "mp_name", "sanction_amount", "is_anomaly", "anomaly_type", "work_status")
    return rt.summary_chunks(works, dt.vendors(spark, sf), dt.mp_master(spark, sf)).select("chunk_id", "text")


@query(works_sql("""SELECT 'work' AS type, count(*) AS chunks FROM works UNION ALL SELECT 'vendor', count(*) FROM supplier UNION ALL SELECT 'mp', count(*) FROM customer
UNION ALL SELECT 'summary', 3 + count(DISTINCT state) + count(DISTINCT work_category) + least(30, count(DISTINCT mp_name)) FROM works"""))
def chunk_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rt.chunk_type_counts(_chunks(spark, sf))


def _vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with made-up chunk metadata."""
    e = dt.table(spark, sf, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("summary", "work", "vendor", "mp"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("chunk_id"), "embedding", kind.alias("type"), F.col("label"),
        F.concat(F.lit("chunk text "), F.repeat(F.concat(F.col("vec_id").cast("string"), F.lit(" ")), 30)).alias("text"),
    )


def _label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: the label's mean vector."""
    e = dt.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg((F.sum(F.col("x").cast("decimal(38,18)")).cast("double") / F.count(F.lit(1))).alias("m"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select(
        F.col("label").cast("string").alias("query_id"), F.transform("v", lambda s: s.m).alias("embedding"),
        F.concat(F.lit("How many "), F.col("label").cast("string")).alias("question"),
    )


_TOP = """queries AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (SELECT label, pos, CAST(sum(CAST(x AS DECIMAL(38,18))) AS DOUBLE) / count(*) AS m FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY label),
scores AS (SELECT CAST(query_id AS VARCHAR) AS query_id, vec_id AS chunk_id, list_extract(['summary', 'work', 'vendor', 'mp'], vec_id % 4 + 1) AS type, list_inner_product(q, CAST(embedding AS DOUBLE[])) AS score,
    'chunk text ' || repeat(CAST(vec_id AS VARCHAR) || ' ', 30) AS text FROM queries, embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores) WHERE rank <= 10)"""


@query(cm.with_ctes(_TOP, body="SELECT query_id, chunk_id, rank, round_even(score * 1000000, 0) / 1000000 AS score FROM top"))
def top_k_vectors(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.top_k_vectors(_vector_chunks(spark, sf), _label_queries(spark, sf), 10)
    return hits.withColumn("score", round_even(F.col("score"), 6))


@query(cm.with_ctes(_TOP, body="""SELECT query_id, chunk_id, rank, round_even(score * 1000000, 0) / 1000000 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores WHERE type = 'vendor') WHERE rank <= 5"""))
def top_k_vectors_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of one type; the filter runs before the search."""
    vendors = _vector_chunks(spark, sf).where(F.col("type") == "vendor")
    hits = rt.top_k_vectors(vendors, _label_queries(spark, sf), 5)
    return hits.withColumn("score", round_even(F.col("score"), 6))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _vector_chunks(spark, sf)
    queries = _label_queries(spark, sf)
    hits = rt.top_k_vectors(chunks, queries, 10)
    return hits.join(chunks.select("chunk_id", "type", "text"), "chunk_id").join(queries.select("query_id", "question"), "query_id")


@query(cm.with_ctes(_TOP, body="""SELECT query_id, chunk_id, type, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN type = 'summary' THEN 0 ELSE 1 END, score DESC, chunk_id) AS rank FROM top"""))
def boost_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return rt.boost_summaries(_results(spark, sf), "question", "type").select("query_id", "chunk_id", "type", "rank")


@query(cm.with_ctes(_TOP, body="""SELECT query_id, rank AS source_id, type, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_preview, round_even(score * 1000, 0) / 1000 AS relevance_score FROM top"""))
def source_citations(spark: SparkSession, sf: str) -> DataFrame:
    return rt.source_citations(_results(spark, sf))


@query(cm.with_ctes(_TOP, body="""SELECT query_id, 'Here is what the records show:' || chr(10) || chr(10) || string_agg('• ' || CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS answer FROM top WHERE rank <= 3 GROUP BY 1"""))
def retrieval_answers(spark: SparkSession, sf: str) -> DataFrame:
    return rt.retrieval_answer(rt.source_citations(_results(spark, sf)))


# ---- answer audit -------------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the turn before as their context, and figures from the turn numbers."""
    t = dt.table(spark, sf, "conversations")
    ask = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    a = t.where(F.col("role") == "assistant").join(ask, ["conv_id", "turn"], "left")
    k = F.col("conv_id") + F.col("turn")
    return a.select(
        "conv_id", "turn",
        F.concat(F.col("context"), F.lit(" There are "), (k % 7 * 111).cast("string"), F.lit(" works.")).alias("context"),
        F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, F.lit("This is not available in the current data."))
        .otherwise(F.concat(F.col("text"), F.lit(" We count 1,"), F.lpad((k % 5 * 111).cast("string"), 3, "0"), F.lit(" and "), (k % 7 * 111).cast("string"), F.lit(" works, 9 new.")))
        .alias("answer"),
    )


_NUMS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[\\d,]+(?:\\.\\d+)?'), lambda n : replace(n, ',', '')), lambda n : n <> ''))"
_REFUSE = " OR ".join("contains(lower(coalesce(answer, '')), '" + p.replace("'", "''") + "')" for p in au.ASSISTANT_REFUSALS)
_AUDIT = f"""answers AS (SELECT a.conv_id, a.turn, q.text || ' There are ' || CAST((a.conv_id + a.turn) % 7 * 111 AS VARCHAR) || ' works.' AS context,
    CASE WHEN (a.conv_id + a.turn) % 10 = 0 THEN '' WHEN (a.conv_id + a.turn) % 10 = 1 THEN 'This is not available in the current data.'
      ELSE a.text || ' We count 1,' || lpad(CAST((a.conv_id + a.turn) % 5 * 111 AS VARCHAR), 3, '0') || ' and ' || CAST((a.conv_id + a.turn) % 7 * 111 AS VARCHAR) || ' works, 9 new.' END AS answer
  FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE a.role = 'assistant'),
audited AS (SELECT *, trim(coalesce(context, '')) = '' OR trim(coalesce(answer, '')) = '' AS used_fallback,
    list_sort(list_filter({_NUMS.format('answer')}, lambda n : NOT list_contains({_NUMS.format("coalesce(context, '')")}, n))) AS novel_all, {_REFUSE} AS refusing FROM answers),
judged AS (SELECT *, CASE WHEN used_fallback THEN '' ELSE array_to_string(list_filter(novel_all, lambda n : length(replace(n, '.', '')) >= 2), ', ') END AS novel,
    CASE WHEN used_fallback THEN '' ELSE array_to_string(list_slice(list_filter(novel_all, lambda n : length(replace(n, '.', '')) >= 3), 1, 5), ', ') END AS novel3 FROM audited)"""


@query(cm.with_ctes(_AUDIT, body="""SELECT conv_id, turn, used_fallback, novel, NOT used_fallback AND refusing AS refused, CASE WHEN used_fallback OR refusing THEN 'LOW' WHEN novel <> '' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM judged"""))
def audit_answers(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_answers(_answers(spark, sf)).select(
        "conv_id", "turn", "used_fallback", F.concat_ws(", ", "novel").alias("novel"), "refused", "confidence"
    )


@query(cm.with_ctes(_AUDIT, body="""SELECT conv_id, turn, novel3 AS novel, CASE WHEN used_fallback OR refusing THEN 0.3 WHEN novel3 <> '' THEN 0.7 ELSE 0.95 END AS confidence_score FROM judged"""))
def audit_retrieval_answers(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_answers(_answers(spark, sf), retrieval=True).select(
        "conv_id", "turn", F.concat_ws(", ", "novel").alias("novel"), "confidence_score"
    )


@query(cm.with_ctes(_AUDIT, body="""SELECT conv_id, turn, 'NL_QUERY_WARNING' AS signal_type, CASE WHEN NOT used_fallback AND NOT refusing AND novel <> '' THEN 0.3 ELSE 0.5 END AS severity,
  CASE WHEN trim(coalesce(context, '')) = '' THEN 'Data context was empty.' WHEN used_fallback THEN 'Answer was empty.' ELSE 'Answer contains number(s) not found in the supplied data: ' || novel || '.' END AS reason FROM judged WHERE used_fallback OR novel <> ''"""))
def audit_signals(spark: SparkSession, sf: str) -> DataFrame:
    audited = au.audit_answers(_answers(spark, sf)).withColumn("key", F.struct("conv_id", "turn"))
    return au.audit_signals(audited, "key").select("key.conv_id", "key.turn", "signal_type", "severity", "reason")


@query(f"SELECT doc_id, array_to_string(list_sort({_NUMS.format('text')}), ' ') AS numbers FROM documents")
def document_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = dt.table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws(" ", F.array_sort(au.numbers_in(F.col("text")))).alias("numbers"))
