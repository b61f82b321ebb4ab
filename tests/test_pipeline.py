"""Files, ingestion, merging and streams."""

import collections
import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fundlens.operators import alerts, store, validation
from fundlens.plans import ingest
from fundlens.sources import readers, tables
from fundlens.streaming import feeds, rate_limit, runner, sla

CSV = """Work_Code,State_Name,District,Amount_Rs,Approval_Date,Contractor_Name,Category
W001,Maharastra,Pune,₹ 25.5 Lakhs,15/04/2023,Sharma Builders,Road
W002,Tamil Nadu,Chennai,"Rs. 12,00,000/-",15-Apr-2023,"Verma, ""V"" Co",Water
,Karnataka,Mysuru,500000,2024-01-30,X,Road
W004,J & K,Srinagar,1.4 Cr,45031,sharma builders ,Road
"""
REFS = [("Maharashtra", "A", "Pune", "Pune"), ("Tamil Nadu", "B", "Chennai", "Chennai"), ("Jammu And Kashmir", "C", "Srinagar", "Srinagar"), ("Karnataka", "D", "Mysuru", "Mysuru")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n", encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": None}, {"a": "x", "b": 2.5}]), encoding="utf-8")
    assert [tuple(r) for r in readers.read_raw(spark, str(tmp_path / "a.csv"), multi_line=True).collect()] == [("1", "x\ny"), ("2", "z")]
    assert readers.read_raw(spark, str(tmp_path / "a.tsv")).collect()[0].b == "x"
    assert [tuple(r) for r in readers.read_raw(spark, str(tmp_path / "a.json")).collect()] == [("1", None), ("x", "2.5")]
    with pytest.raises(ValueError):
        readers.read_raw(spark, str(tmp_path / "a.xyz"))


def test_ingest_file(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV, encoding="utf-8")
    mps = spark.createDataFrame(REFS, "state string, mp_name string, constituency string, district string")
    works, quarantine = str(tmp_path / "works"), str(tmp_path / "quarantine")
    report = ingest.ingest_file(spark, str(path), works, quarantine, "t1", "2025-01-01", mps).first()
    assert (report.total_rows, report.valid_count, report.quarantined_count, report.added, report.updated) == (4, 3, 1, 3, 0)
    assert report.status == "completed_with_warnings"
    rows = {r.unique_work_number: r for r in tables.read_keyed(spark, works).collect()}
    assert (rows["W001"].state, float(rows["W001"].sanction_amount)) == ("Maharashtra", 2550000.0)
    assert (rows["W004"].state, rows["W004"].date_of_administrative_approval) == ("Jammu And Kashmir", "2023-04-15")
    assert rows["W001"].vendor_id == rows["W004"].vendor_id == "V_AUTO_00001"
    assert rows["W002"].vendor_id == "V_AUTO_00002"
    bad = tables.read_quarantine(spark, quarantine, "t1").collect()
    assert len(bad) == 1 and bad[0].row_index == 2 and "unique_work_number" in bad[0].errors[0]
    again = ingest.ingest_file(spark, str(path), works, quarantine, "t2", "2025-01-01", mps).first()
    assert (again.added, again.updated, again.total_works) == (0, 3, 3)
    # One more work rewrites its own bucket only; a replayed run leaves the same rows.
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "works").rglob("part-*.parquet")}
    before = files()
    head, first, *_ = CSV.splitlines()
    path.write_text(f"{head}\n{first.replace('W001', 'W777')}\n", encoding="utf-8")
    for run, added in (("t3", 1), ("t4", 0)):
        more = ingest.ingest_file(spark, str(path), works, quarantine, run, "2025-01-01", mps).first()
        assert (more.added, more.updated, more.total_works) == (added, 1 - added, 4)
    after = files()
    kept = [f for f in before if after.get(f) == before[f]]
    assert len(kept) >= len(before) - 1 and len(after) <= len(before) + 1
    assert {r.unique_work_number for r in tables.read_keyed(spark, works).collect()} == {"W001", "W002", "W004", "W777"}


def test_validation(spark):
    rows = [("W1", "KA", "Mysuru", "6e8", "5", "60"), ("W2", "KA", "Mysuru", "-1000", None, None), ("W3", " ", "Mysuru", "abc", "101", "x")]
    df = spark.createDataFrame(rows, "unique_work_number string, state string, nodal_district string, sanction_amount string, physical_progress_pct string, financial_progress_pct string")
    got = validation.validate_rows(df, "2025-01-01").orderBy("unique_work_number").collect()
    assert [len(r.errors) for r in got] == [0, 1, 3]
    assert got[0].warnings == ["LARGE_AMOUNT", "POSSIBLE_GHOST_WORK"]
    assert got[2].financial_progress_pct is None


def test_upsert_later_row_wins(spark):
    old = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "keep")], "unique_work_number string, x int, extra string")
    new = spark.createDataFrame([("a", 5, 0), ("a", None, 1), ("c", 7, 2), ("  ", 9, 3)], "unique_work_number string, x int, o int")
    got = sorted((r.unique_work_number, r.x, r.extra, r._origin) for r in store.upsert(old, new, F.col("o")).drop("o").collect())
    assert got == [("a", None, "keep", "updated"), ("b", 2, "keep", "kept"), ("c", 7, None, "added")]


def test_known_vendor_name_takes_last_id(spark):
    rows = [(1, "V1", "Acme"), (2, "V2", " ACME"), (3, "", "acme"), (4, None, "New"), (5, "", "Zed"), (6, "", "new "), (7, "", " ")]
    df = spark.createDataFrame(rows, "i long, vendor_id string, vendor_name string")
    got = {r.i: r.vendor_id for r in store.assign_vendor_ids(df, [F.shiftright("i", 1)], F.col("i")).collect()}
    assert got == {1: "V1", 2: "V2", 3: "V2", 4: "V_AUTO_00001", 5: "V_AUTO_00002", 6: "V_AUTO_00001", 7: ""}


def expected_limit(rows, limit, width):
    log, out = {}, {}
    for key, at, i in sorted(rows):
        live = [t for t in log.get(key, []) if at - t < width]
        out[i] = len(live) < limit
        log[key] = live + [at] if out[i] else live
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(10)
    rows = [(rng.choice("ab") if rng.random() < 0.3 else "hot", rng.randrange(0, 40_000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want = expected_limit(rows, 3, 600)
    batch = rate_limit.rate_limit(df, "k", "ts", "i", 3, 600)
    assert {r.event_id: r.accepted for r in batch.collect()} == want
    assert any(want.values()) and not all(want.values())
    # Two files in order of time, one per micro-batch.
    feed = str(tmp_path / "feed")
    df.where("s < 20000").coalesce(1).write.mode("append").parquet(feed)
    df.where("s >= 20000").coalesce(1).write.mode("append").parquet(feed)
    stream = rate_limit.rate_limit_stream(runner.file_stream(spark, feed, 1), "k", "ts", "i", 3, 600)
    out = runner.drain(stream, "rate", out=str(tmp_path / "out"))
    assert {r.event_id: r.accepted for r in out.collect()} == want


def test_feedback_sinks_survive_a_replay(spark, tmp_path):
    """A batch that runs again replaces its own rows in every sink."""
    works = spark.createDataFrame([("W1", "Pune", "Asha"), ("W2", "Pune", None)], "unique_work_number string, nodal_district string, mp_name string")
    schema = "feedback_id long, work_id string, feedback_text string, latitude double, longitude double, created_at timestamp_ntz"
    at = datetime.datetime(2024, 1, 1)
    first = [(1, "W1", "the new road is in use", 18.5204, 73.8567, at), (2, "W1", "DANGER of collapse here", 19.0760, 72.8777, at), (3, None, "no work number given", None, None, at)]
    second = [(4, "W2", "Danger near the old school", None, None, at), (5, "W9", "this work is not known", None, None, at), (6, "W1", None, None, None, at)]
    feed, root, state = str(tmp_path / "feed"), str(tmp_path / "sinks"), str(tmp_path / "state")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    def run():
        feeds.feedback_to_sinks(runner.file_stream(spark, feed, 1), works, root, F.col("created_at"), state)

    def seen():
        return {s: sorted(str(r.asDict()) for r in spark.read.parquet(f"{root}/{s}").collect()) for s in feeds.FEEDBACK_SINKS}

    run()
    once = seen()
    assert {s: len(r) for s, r in once.items()} == {"accepted": 3, "rejects": 3, "alerts": 2, "notifications": 3}
    notes = spark.read.parquet(f"{root}/notifications").collect()
    assert {(r.notification_id, r.scope_id) for r in notes} == {
        ("NTF-ALT-CITIZEN-2-DISTRICT", "Pune"), ("NTF-ALT-CITIZEN-2-MP", "Asha"), ("NTF-ALT-CITIZEN-4-DISTRICT", "Pune")}
    # The commit of the last batch is lost: it is run again.
    commits = sorted(p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        if p.exists():
            p.unlink()
    run()
    assert seen() == once


def test_scope(spark):
    w = spark.createDataFrame([("W1", "KA", "Mysuru", "Pune", "c1", "Asha Rao")], "unique_work_number string, state string, nodal_district string, implementing_district string, constituency string, mp_name string")
    seen = lambda role, scope: alerts.scoped_works(w, role, scope).count()
    assert [seen("MINISTRY", None), seen("STATE", "ka"), seen("DISTRICT", "PUNE"), seen("MP", "asha"), seen("CITIZEN", ""), seen("CITIZEN", "x"), seen("OTHER", None)] == [1, 1, 1, 1, 1, 0, 0]


def test_sla_monitor_by_bucket(spark, tmp_path):
    """Warnings and escalations over several batches; the state has a row per bucket, not per work."""
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(13)
    feed = []  # per batch: (work, status, deadline, event time)
    for batch in range(6):
        now = start + datetime.timedelta(days=batch)
        rows = [(f"w{rng.randrange(60)}", rng.choice(["OPEN"] * 4 + ["CLOSED"]), now + datetime.timedelta(hours=rng.randrange(96)), now) for _ in range(40)]
        rows = list({r[0]: r for r in rows}.values())
        feed.append(rows)
        frame = spark.createDataFrame([(w, f"A{w}", s, d, t) for w, s, d, t in rows], "work_id string, alert_id string, status string, sla_deadline timestamp_ntz, created_at timestamp_ntz")
        frame.coalesce(1).write.parquet(f"{tmp_path}/feed/batch={batch}")
        time.sleep(0.05)  # files are taken in order of their times
    stream = runner.file_stream(spark, f"{tmp_path}/feed", 1)
    got = collections.Counter((r.work_id, r.type, r.due_ms) for r in runner.drain(sla.sla_monitor(stream, "created_at", buckets=5), "sla", out=f"{tmp_path}/out").collect())

    want, held = collections.Counter(), {}
    # A batch sees the watermark of the one before; a last one without rows follows.
    for batch in range(7):
        for w, status, due, _ in feed[batch] if batch < 6 else ():
            if status != "OPEN":
                held.pop(w, None)
            elif held.get(w, (0, 0, False))[2] is not True:
                held[w] = [due, held[w][1] if w in held else False, False]
        mark = start + datetime.timedelta(days=batch - 1, hours=-1) if batch else datetime.datetime(1970, 1, 1)
        for w, state in held.items():
            due, warned, done = state
            ms = int(due.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
            if not done and not warned and mark >= due - datetime.timedelta(days=1):
                want[w, "SLA_WARNING", ms] += 1
                state[1] = True
            if not done and mark >= due:
                want[w, "ESCALATED", ms] += 1
                state[2] = True
    assert got == want and len({t for _, t, _ in want}) == 2
    assert spark.read.format("statestore").load(f"{tmp_path}/out-state").count() <= 5
