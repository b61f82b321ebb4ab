"""Role dashboards: all members, districts, states and vendors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundlens.functions.numbers import (
    CRORE, LAKH, as_crore, count_when, pct, round_even, round_up, spent_amount, sum_money,
)
from fundlens.operators.pairing import top_k_per_group

APPROVED = "date_of_administrative_approval"
RECEIVED = "date_of_receipt_of_work_proposal_from_mp"
DEFAULT_ALLOCATION = 5e7
# Instalment shares and the share of spending that releases each.
INSTALMENTS = (
    (1, "Advance Mobilization (20%)", 0.2, 0.0),
    (2, "Stage 1 Plinth & Foundation (30%)", 0.3, 0.5),
    (3, "Stage 2 Superstructure (35%)", 0.35, 0.85),
    (4, "Final Settlement / Retention (15%)", 0.15, None),
)


def _n() -> Column:
    return F.count(F.lit(1))


def _is(status: str) -> Column:
    return F.col("work_status") == status


def _spent() -> Column:
    return F.sum(spent_amount(F.col("sanction_amount"), F.col("financial_progress_pct")))


def whole_pct(part: Column, whole: Column) -> Column:
    """Percentage rounded half up to whole points, 0 when the whole is 0."""
    share = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole == 0, F.lit(0)).otherwise(round_up(share).cast("bigint"))


def _shared_kpis() -> list[Column]:
    return [
        _n().alias("total_works"),
        sum_money(F.col("sanction_amount")).alias("_amount"),
        count_when(F.col("is_anomaly")).alias("anomalies"),
        count_when(_is("Stalled")).alias("stalled_works"),
    ]


def national_overview(works: DataFrame, mp_master: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row of national indicators."""
    kpis = works.agg(*_shared_kpis())
    mps = mp_master.agg(_n().alias("total_mps"))
    hubs = vendors.agg(count_when(F.col("is_hub")).alias("hub_contractors"))
    # Three one-row frames.
    return (
        kpis.crossJoin(F.broadcast(mps))
        .crossJoin(F.broadcast(hubs))
        .select(
            "total_works", as_crore(F.col("_amount")).alias("total_sanctioned_cr"), "total_mps",
            F.col("anomalies").alias("total_anomalies"),
            pct(F.col("anomalies"), F.col("total_works")).alias("anomaly_rate_pct"),
            "stalled_works", "hub_contractors",
        )
    )


def record_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(_n().alias("records")).select(F.lit(n).alias("table_name"), "records") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_allocation(kpis: DataFrame, mp_master: DataFrame, default: float = DEFAULT_ALLOCATION) -> DataFrame:
    """Adds ``allocated`` per member; members without an allocation get the default."""
    known = mp_master.groupBy(F.trim("mp_name").alias("mp_name")).agg(
        F.max("allocated_amount").alias("_a")
    )
    return kpis.join(known, "mp_name", "left").withColumn(
        "allocated", F.coalesce(F.col("_a").cast("double"), F.lit(default))
    ).drop("_a")


def mp_dashboard(works: DataFrame, mp_master: DataFrame) -> DataFrame:
    """Indicators of every member."""
    kpis = works.groupBy("mp_name").agg(
        F.min("state").alias("state"),
        F.min("constituency").alias("constituency"),
        *_shared_kpis(),
        _spent().alias("spent"),
        count_when(_is("Completed")).alias("completed_works"),
        count_when(_is("Work in Progress")).alias("in_progress_works"),
    )
    return with_allocation(kpis, mp_master).select(
        "mp_name", "constituency", "state",
        round_even(F.col("allocated") / CRORE, 2).alias("allocated_limit_cr"),
        "total_works", as_crore(F.col("_amount")).alias("total_sanctioned_cr"),
        as_crore(F.col("spent")).alias("total_spent_cr"),
        whole_pct(F.col("spent"), F.col("allocated")).alias("utilization_pct"),
        "completed_works", "in_progress_works", "stalled_works",
        F.col("anomalies").alias("anomaly_works_count"),
    )


def mp_category_distribution(works: DataFrame) -> DataFrame:
    return works.groupBy(
        "mp_name", F.coalesce("work_category", F.lit("Other")).alias("work_category")
    ).agg(_n().alias("works"))


def top_anomalous_works(works: DataFrame, group: str, k: int) -> DataFrame:
    """The first ``k`` anomalous works per group, by work number."""
    rows = works.where("is_anomaly").select(group, "unique_work_number", "anomaly_type")
    return top_k_per_group(rows, [group], [F.col("unique_work_number")], k)


def _in_district(works: DataFrame, *columns: str) -> DataFrame:
    """Works by district; a work counts once in each of its one or two districts."""
    places = F.explode(F.array_distinct(F.array("nodal_district", "implementing_district")))
    return works.select(places.alias("district"), *columns)


def district_dashboard(works: DataFrame) -> DataFrame:
    """Indicators of every district, over works it is nodal or implementing for."""
    rows = _in_district(
        works, "state", "sanction_amount", "financial_progress_pct", "is_anomaly", "work_status", "vendor_id"
    ).where(F.col("district").isNotNull())
    kpis = rows.groupBy("district").agg(
        *_shared_kpis(),
        _spent().alias("spent"),
        count_when(_is("Completed")).alias("completed"),
        count_when(_is("Work in Progress")).alias("in_progress"),
    )
    vendors = rows.where("vendor_id <> ''").select("district", "vendor_id").distinct().groupBy("district").agg(
        _n().alias("contractors_active")
    )
    return kpis.join(vendors, "district", "left").select(
        "district", "total_works", as_crore(F.col("_amount")).alias("total_sanctioned_cr"),
        as_crore(F.col("spent")).alias("total_spent_cr"),
        whole_pct(F.col("spent"), F.col("_amount")).alias("utilization_pct"),
        F.col("anomalies").alias("anomalous_works"),
        F.coalesce("contractors_active", F.lit(0)).alias("contractors_active"),
        "completed", "in_progress", F.col("stalled_works").alias("stalled"),
    )


def district_top_vendors(works: DataFrame, k: int = 5) -> DataFrame:
    counts = (
        _in_district(works, "vendor_id", "vendor_name")
        .where("vendor_id <> ''")
        .groupBy("district", "vendor_id")
        .agg(_n().alias("project_count"), F.min("vendor_name").alias("vendor_name"))
    )
    return top_k_per_group(counts, ["district"], [F.desc("project_count"), F.col("vendor_id")], k)


def district_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Open, high-risk open and nearly overdue alerts per district."""
    is_open = F.col("status") == "OPEN"
    left = F.timestamp_diff("SECOND", as_of, F.col("sla_deadline"))
    return alerts.groupBy("district").agg(
        count_when(is_open).alias("open_alerts"),
        count_when(is_open & (F.col("severity") == "HIGH")).alias("high_risk_alerts"),
        count_when(is_open & (left > 0) & (left < 86400)).alias("pending_sla_alerts"),
    )


def state_dashboard(works: DataFrame) -> DataFrame:
    """Indicators of every state. Districts are pre-aggregated, so no state meets in one task."""
    per_district = works.groupBy("state", "nodal_district").agg(*_shared_kpis())
    kpis = per_district.groupBy("state").agg(
        F.count(F.when(F.col("nodal_district") != "", 1)).alias("total_districts"),
        F.sum("total_works").alias("total_works"),
        F.sum("_amount").alias("_amount"),
        F.sum("anomalies").alias("total_anomalies"),
        F.sum("stalled_works").alias("stalled_works"),
    )
    return kpis.select(
        "state", "total_districts", "total_works",
        as_crore(F.col("_amount")).alias("total_sanctioned_cr"), "total_anomalies",
        pct(F.col("total_anomalies"), F.col("total_works")).alias("anomaly_rate_pct"), "stalled_works",
    )


def state_district_ranking(works: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` districts with most anomalies per state."""
    counts = works.groupBy("state", "nodal_district").agg(
        _n().alias("total_works"), count_when(F.col("is_anomaly")).alias("anomalies")
    )
    ranked = top_k_per_group(counts, ["state"], [F.desc("anomalies"), F.col("nodal_district")], k)
    return ranked.withColumn("rate_pct", pct(F.col("anomalies"), F.col("total_works"), 1))


def state_kpis(works: DataFrame) -> DataFrame:
    """Totals, anomaly rate and utilisation of every state."""
    return (
        works.groupBy(F.coalesce("state", F.lit("Unknown")).alias("state"))
        .agg(*_shared_kpis(), _spent().alias("spent"))
        .select(
            "state", "total_works", "anomalies",
            pct(F.col("anomalies"), F.col("total_works"), 1).alias("rate_pct"),
            as_crore(F.col("_amount")).alias("sanctioned_cr"),
            whole_pct(F.col("spent"), F.col("_amount")).alias("utilization_pct"),
        )
    )


def ministry_state_ranking(works: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` states with most anomalies."""
    return state_kpis(works).orderBy(F.desc("anomalies"), "state").limit(k)


def ministry_anomaly_types(works: DataFrame) -> DataFrame:
    return works.where("is_anomaly and anomaly_type <> ''").groupBy("anomaly_type").agg(_n().alias("works"))


def ministry_kpis(works: DataFrame, mp_master: DataFrame) -> DataFrame:
    kpis = works.agg(*_shared_kpis(), _spent().alias("spent"))
    return kpis.crossJoin(F.broadcast(mp_master.agg(_n().alias("total_mps")))).select(
        F.col("total_works").alias("active_works"),
        as_crore(F.col("_amount")).alias("funds_released_cr"),
        whole_pct(F.col("spent"), F.col("_amount")).alias("utilization_pct"),
        round_up(F.col("anomalies") / F.col("total_works") * 100, 1).alias("national_flag_rate_pct"),
        "total_mps",
    )


def region_rollup(works: DataFrame) -> DataFrame:
    """National, state and district totals in one pass; ``level`` is 0, 1 or 2 names deep."""
    rolled = works.rollup("state", "nodal_district").agg(
        (F.lit(2) - F.grouping("state") - F.grouping("nodal_district")).cast("int").alias("level"),
        *_shared_kpis(),
    )
    return rolled.select(
        "level", "state", "nodal_district", "total_works",
        as_crore(F.col("_amount")).alias("sanctioned_cr"), "anomalies", "stalled_works",
    )


def top_risk_queue(alerts: DataFrame, k: int = 8) -> DataFrame:
    return (
        alerts.where((F.col("severity") == "HIGH") & (F.col("status") == "OPEN"))
        .orderBy(F.desc("risk_score"), "alert_id")
        .limit(k)
        .select("alert_id", "work_id", "state", "district", as_crore(F.col("sanction_amount")).alias("sanction_cr"), "risk_score")
    )


def vendor_scorecard(works: DataFrame) -> DataFrame:
    """Totals, on-time share, flags and both grades of every vendor."""
    v = works.where("vendor_id <> ''").groupBy("vendor_id").agg(
        F.min("vendor_name").alias("vendor_name"),
        _n().alias("total_projects"),
        count_when(_is("Stalled")).alias("delayed_projects"),
        count_when(F.col("is_anomaly")).alias("flagged_projects"),
        sum_money(F.col("sanction_amount")).cast("double").alias("total_sanctioned"),
    )
    on_time = whole_pct(F.col("total_projects") - F.col("delayed_projects"), F.col("total_projects"))
    flagged = F.col("flagged_projects")
    return v.withColumn("on_time_pct", on_time).withColumns(
        {
            "rating": F.when((F.col("on_time_pct") > 80) & (flagged == 0), "A").when(flagged > 2, "C-").otherwise("B"),
            "district_rating": F.when(flagged > 1, "C").when(F.col("delayed_projects") > 1, "B").otherwise("A"),
            "is_busy": F.col("total_projects") >= 4,
        }
    )


def multi_state_vendors(works: DataFrame) -> DataFrame:
    """Vendors active in two or more states."""
    per_state = works.where("vendor_id <> ''").groupBy("vendor_id", "state").agg(*_shared_kpis())
    v = per_state.groupBy("vendor_id").agg(
        _n().alias("active_states"),
        F.concat_ws(", ", F.sort_array(F.collect_set("state"))).alias("states"),
        F.sum("total_works").alias("total_works"),
        F.sum("_amount").alias("_amount"),
        F.sum("stalled_works").alias("delayed"),
        F.sum("anomalies").alias("incidents"),
    )
    return v.where("active_states >= 2").select(
        "vendor_id", "active_states", "states", "total_works",
        as_crore(F.col("_amount")).alias("total_cr"),
        whole_pct(F.col("delayed"), F.col("total_works")).alias("delay_rate_pct"), "incidents",
    )


def district_comparison(works: DataFrame, alerts: DataFrame) -> DataFrame:
    """Works, funds, utilisation, flags, mean days to action and risk level of every district."""
    w = works.groupBy("nodal_district").agg(*_shared_kpis(), _spent().alias("spent"))
    days = F.timestamp_diff("SECOND", F.col("created_at"), F.col("actioned_at"))
    a = alerts.groupBy(F.col("district").alias("nodal_district")).agg(
        _n().alias("flags"), F.sum(days).alias("_seconds"), F.count(days).alias("_actioned")
    )
    rate = F.col("flags") / F.col("total_works")
    return w.join(a, "nodal_district", "left").withColumn("flags", F.coalesce("flags", F.lit(0))).select(
        "nodal_district", "total_works", as_crore(F.col("_amount")).alias("sanctioned_cr"),
        whole_pct(F.col("spent"), F.col("_amount")).alias("utilization_pct"), "flags",
        round_even(F.when(F.col("_actioned") > 0, F.col("_seconds") / F.col("_actioned") / 86400.0), 1).alias("avg_action_days"),
        F.when(rate >= 0.35, "HIGH").when(rate >= 0.32, "MEDIUM").otherwise("LOW").alias("risk_level"),
    )


def category_speed_cost(works: DataFrame) -> DataFrame:
    """Cost band, mean days to approval and fastest district per category."""
    days = F.datediff(F.col(APPROVED), F.col(RECEIVED))
    per = works.groupBy("work_category", "nodal_district").agg(
        F.min("sanction_amount").alias("lo"), F.max("sanction_amount").alias("hi"),
        F.sum(days).alias("d"), F.count(days).alias("n"),
    )
    speed = F.struct((F.col("d") / F.col("n")).alias("avg"), F.col("nodal_district").alias("district"))
    return per.groupBy("work_category").agg(
        (F.min("lo").cast("double") / LAKH).alias("min_lakh"),
        (F.max("hi").cast("double") / LAKH).alias("max_lakh"),
        (F.sum("d") / F.sum("n")).alias("avg_days"),
        F.min(F.when(F.col("n") > 0, speed)).alias("fast"),
    ).select(
        "work_category", "min_lakh", "max_lakh", "avg_days",
        F.col("fast.district").alias("fastest_district"), F.col("fast.avg").alias("fastest_days"),
    )


def vendor_concentration(payments: DataFrame, vendors: DataFrame) -> DataFrame:
    """Payments per vendor and its share of its state's amount."""
    per = payments.groupBy("vendor_id").agg(
        _n().alias("payments"), sum_money(F.col("payment_amount")).alias("amount")
    ).join(vendors.select("vendor_id", "state"), "vendor_id")
    return share_within(per, ["state"], "amount").select(
        "vendor_id", "state", "payments", F.col("amount").cast("double").alias("amount"), "share"
    )


def share_within(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds ``share``: the row's part of its group's total."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    return df.join(totals, group).withColumn(
        "share", F.col(value).cast("double") / F.col("_total").cast("double")
    ).drop("_total")


def workload(works: DataFrame, by: str) -> DataFrame:
    """Ongoing and all works per unit, against the mean of its state."""
    per = works.groupBy("state", by).agg(
        count_when(_is("Work in Progress")).alias("ongoing"), _n().alias("works")
    )
    mean = per.groupBy("state").agg((F.sum("works") / _n()).alias("state_mean"))
    return per.join(mean, "state").withColumn("ratio", F.col("works") / F.col("state_mean"))


def spend_pace(works: DataFrame, mp_master: DataFrame, term_months: int = 60) -> DataFrame:
    """Cumulative spending per member and month against a straight line to the allocation.

    Months count from the member's first approval. Works are summed per month first, so a window
    holds one row per month.
    """
    month = F.trunc(F.col(APPROVED), "month")
    monthly = works.where(F.col(APPROVED).isNotNull()).groupBy("mp_name", month.alias("month")).agg(_spent().alias("spent"))
    ordered = W.partitionBy("mp_name").orderBy("month")
    paced = monthly.withColumn("actual", F.sum("spent").over(ordered)).withColumn(
        "month_no", (F.months_between("month", F.min("month").over(ordered)) + 1).cast("int")
    )
    target = F.col("allocated") * F.least(F.col("month_no"), F.lit(term_months)) / F.lit(float(term_months))
    return with_allocation(paced, mp_master).select(
        "mp_name", "month", "month_no", "actual", target.alias("target")
    )


def peer_rank(mp_kpis: DataFrame) -> DataFrame:
    """Rank in the state and national percentile of every member by utilisation.

    Ranks come from counts per utilisation value, so windows hold one row per distinct value.
    """
    base = mp_kpis.select("mp_name", "state", "utilization_pct")
    per_state = base.groupBy("state", "utilization_pct").agg(_n().alias("n"))
    better_in_state = W.partitionBy("state").orderBy(F.desc("utilization_pct")).rowsBetween(W.unboundedPreceding, -1)
    in_state = per_state.select(
        "state", "utilization_pct",
        (F.coalesce(F.sum("n").over(better_in_state), F.lit(0)) + 1).alias("rank_in_state"),
        F.sum("n").over(W.partitionBy("state")).alias("state_mps"),
    )
    nation = base.groupBy("utilization_pct").agg(_n().alias("n"))
    worse = W.orderBy("utilization_pct").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    below = F.coalesce(F.sum("n").over(worse), F.lit(0))
    total = F.sum("n").over(whole)
    national = nation.select(
        "utilization_pct",
        F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias("national_percentile"),
    )
    return base.join(in_state, ["state", "utilization_pct"]).join(national, "utilization_pct")


def drawdown_schedule(works: DataFrame) -> DataFrame:
    """Four instalments per work with their release status."""
    amount = F.col("sanction_amount").cast("double")
    spent = spent_amount(F.col("sanction_amount"), F.col("financial_progress_pct"))
    rows = []
    for number, label, share, released_at in INSTALMENTS:
        if released_at is None:
            status = F.when(_is("Completed"), "Disbursed").otherwise("Held")
        else:
            status = F.when(spent >= amount * released_at, "Disbursed").otherwise("Pending")
        rows.append(
            F.struct(
                F.lit(number).alias("instalment_no"), F.lit(label).alias("instalment"),
                round_up(amount * share).cast("bigint").alias("amount"), status.alias("status"),
            )
        )
    return works.select("unique_work_number", F.explode(F.array(*rows)).alias("i")).select("unique_work_number", "i.*")


def milestone_timeline(works: DataFrame) -> DataFrame:
    """Five stages per work with date (where recorded) and completion flag."""
    no_date = F.lit(None).cast("date")
    stages = (
        (1, "Proposed", F.col(RECEIVED), F.lit(True), F.col("mp_name")),
        (2, "Approved", F.col(APPROVED), F.lit(True),
         F.col("nodal_district")),
        (3, "Contracted", no_date, F.lit(True), F.col("implementing_agency_name")),
        (4, "Under construction", no_date, F.col("physical_progress_pct") > 20, F.lit(None).cast("string")),
        (5, "Finished", no_date, _is("Completed"), F.lit(None).cast("string")),
    )
    rows = [
        F.struct(
            F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), date.alias("stage_date"),
            F.coalesce(done, F.lit(False)).alias("completed"), officer.alias("officer"),
        )
        for n, name, date, done, officer in stages
    ]
    return works.select("unique_work_number", F.explode(F.array(*rows)).alias("s")).select("unique_work_number", "s.*")


def topn_overlap(works: DataFrame, vendors: DataFrame) -> DataFrame:
    """How well the busiest vendors match the marked hubs; as many are taken as there are hubs."""
    counts = works.where("vendor_id <> ''").groupBy("vendor_id").agg(_n().alias("projects"))
    hubs = vendors.where("is_hub").select("vendor_id").distinct()
    n_hubs = hubs.count()
    top = counts.orderBy(F.desc("projects"), "vendor_id").limit(n_hubs)
    marked = top.join(hubs.withColumn("hub", F.lit(True)), "vendor_id", "left")
    found = marked.agg(_n().alias("picked"), F.count("hub").alias("hits"))
    hubs_total = F.lit(n_hubs).cast("bigint")
    return found.select(
        hubs_total.alias("hubs"), "picked", "hits",
        F.when(F.col("picked") > 0, F.col("hits") / F.col("picked")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(hubs_total > 0, F.col("hits") / hubs_total).otherwise(F.lit(0.0)).alias("recall"),
    )


def score_by_label(scored: DataFrame, label: str) -> DataFrame:
    """Mean score and level counts per label. Scores have four digits, so the sum is exact."""
    level = F.col("risk_level")
    return scored.groupBy(label).agg(
        _n().alias("proposals"),
        (F.sum(F.col("overall_score").cast("decimal(18,4)")).cast("double") / _n()).alias("avg_score"),
        *[count_when(level == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW", "INSUFFICIENT_DATA")],
    )


def brief_rows(ranking: DataFrame) -> DataFrame:
    """One line of audit brief per state."""
    return ranking.select(
        "state",
        F.format_string(
            "%s: %d works, %d flagged (%.1f%%), %d%% of funds utilised.",
            "state", "total_works", "anomalies", "rate_pct", "utilization_pct",
        ).alias("brief"),
    )


def digest_rows(mp_kpis: DataFrame) -> DataFrame:
    """One line of press digest per member."""
    return mp_kpis.select(
        "mp_name",
        F.format_string(
            "%s (%s): %.2f Cr spent (%d%% of %.2f Cr), %d works, %d completed, %d under way.",
            "mp_name", "constituency", "total_spent_cr", "utilization_pct", "allocated_limit_cr",
            "total_works", "completed_works", "in_progress_works",
        ).alias("digest"),
    )
