"""Files, documents, tables and the drop stream, on generated scratch files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import book, reports as report_ops, tables, trajectory
from spendlens.operators.joins import newest_per_key, top_per_key
from spendlens.plans import ingest, scoring
from spendlens.sources import configs, files, reports
from spendlens.streaming import drops

AS_OF, LOADED = dt.date(2025, 9, 20), dt.datetime(2025, 9, 20, 6)


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_encoding_classes(spark, folder):
    put(folder, "a.csv", "x\ty\n1\t2\n".encode("utf-16"))
    put(folder, "b.csv", b"\xef\xbb\xbfx,y\n1,2\n")
    put(folder, "c.csv", "x,y\ncafé,2\n".encode("cp1252"))
    put(folder, "d.csv", b"x,y\n\x81,2\n")
    put(folder, "e.csv", b"x,y\n1,2\n")
    got = {r["file_name"]: r["encoding_class"] for r in files.classified(spark, folder).collect()}
    assert got == {"a.csv": "utf-16", "b.csv": "utf-8", "c.csv": "cp1252", "d.csv": "latin1", "e.csv": "utf-8"}


def test_guards_and_latest(spark, folder):
    put(folder, "r_2025-09-01.csv", b"<html><body class='maincontent-logon'>\nx")
    put(folder, "r_2025-09-03.csv", b'  {"error": 1}')
    put(folder, "r_2025-09-02.csv", b"x,y\n1,2\n")
    known = files.classified(spark, folder)
    assert {r["file_name"]: r["reject_reason"] for r in files.rejected_files(known).collect()} == {
        "r_2025-09-01.csv": "login page", "r_2025-09-03.csv": "json"}
    assert files.latest_file(known, "name").first()["file_name"] == "r_2025-09-03.csv"
    assert files.latest_file(known).count() == 1
    sums = files.checksums(spark, folder).collect()
    assert len({r["sha256"] for r in sums}) == 3


def test_ingest_mixed_encodings(spark, folder):
    head = "Campaign ID\tAdvertiser Name\tLast Active\tAmount Spent\tStart Date\n"
    put(folder, "ultimate_dms_2025-09-18.csv", (head + "1\tJoe Pizza\tx\t$1,200.50\t2025-09-01\n\t\t\t\t\n").encode("utf-16"))
    put(folder, "ultimate_dms_2025-09-19.csv", (head.replace("\t", ",") + "2,Ann,NULL,bad,9/2/2025\n").encode("utf-8"))
    put(folder, "ultimate_dms_bad.csv", b"<!DOCTYPE html>")
    rows = ingest.ingest(spark, folder, configs.SOURCES["ultimate_dms"], LOADED, AS_OF)
    got = {r["campaign_id"]: r for r in rows.collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["advertiser_name"] == "JoePizza" and got["1"]["amount_spent"] == 1200.5
    assert got["1"]["snapshot_date"] == dt.date(2025, 9, 18) and got["1"]["start_date"] == dt.date(2025, 9, 1)
    assert got["2"]["amount_spent"] is None and got["2"]["last_active"] is None
    assert got["2"]["start_date"] == dt.date(2025, 9, 2)
    latest = ingest.ingest(spark, folder, configs.SOURCES["ultimate_dms"], LOADED, AS_OF, latest=True)
    assert latest.count() == 1


def test_pipeline_headers_and_rejects(spark, folder):
    put(folder, "sf_partner_pipeline_2025-09-19.csv",
        b"Opportunity Name,Account Name,Created Date,Type,Type,Mo. Offer Amt\nA,B,2025-01-02,New,Web,5\n,B,2025-01-02,New,Web,6\n")
    source = configs.SOURCES["sf_partner_pipeline"]
    rows = ingest.ingest(spark, folder, source, LOADED, AS_OF)
    assert {"type_1", "type_2", "mo_offer_amt"} <= set(rows.columns)
    good, bad = ingest.split_rejects(rows, source)
    assert good.count() == 1
    assert bad.first()["reject_reason"] == "missing opportunity_name"
    once = ingest.load(None, good, source)
    assert ingest.load(once, good, source).count() == once.count() == 1


def test_performance_report_to_scores(spark, folder):
    header = [h for h, _ in ingest.PERFORMANCE_REPORT.values()]
    header = list(dict.fromkeys(header))
    cells = {"Campaign ID": "9", "Campaign Budget": "3000", "Amount Spent": "500", "Avg Cycle Length": "30", "Days Elapsed": "10",
             "Utilization": "99.71", "Running CID Leads": "4", "Running CID CPL": "125", "CPL Goal": "100", "BSC CPL Avg": "120"}
    put(folder, "ultimate_dms_2025-09-18.csv",
        ("\t".join(header) + "\n" + "\t".join(cells.get(h, "t") for h in header) + "\n").encode("utf-16"))
    raw = files.read_table_files(spark, [folder], "utf-16")
    campaigns = ingest.campaigns_from_report(raw)
    row = scoring.score_book(campaigns).first()
    assert row["utilization"] == pytest.approx(0.9971) and row["io_cycle"] == 1.0 and row["priority_tier"]


def test_crm_report_files(spark, folder):
    doc = {
        "reportMetadata": {"detailColumns": ["A", "B"]},
        "reportExtendedMetadata": {"detailColumnInfo": {"A": {"label": "Name"}}},
        "factMap": {"0!T": {"rows": [{"dataCells": [{"label": "l", "value": "v"}]}]},
                    "T!T": {"rows": [{"dataCells": [{"value": {"amount": 5.5, "currency": "USD"}}, {"value": 3}, {"label": "x"}]}]}},
    }
    put(folder, "a.json", ("﻿" + json.dumps(doc)).encode())
    put(folder, "b.json", json.dumps(doc | {"factMap": {"T!T": {"rows": []}}}).encode())
    docs = reports.parse_crm_reports(reports.read_documents(spark, folder))
    rows = reports.cells_to_columns(reports.flatten_all_blocks(docs, ["source_file"]), ["Name", "B"]).collect()
    assert sorted((r["block"], r["Name"], r["B"]) for r in rows) == [("0!T", "v", None), ("T!T", "5.5", "3")]
    first = reports.flatten_first_block(docs, ["source_file"]).collect()
    assert [r["block"] for r in first] == ["T!T"] and first[0]["cells"]["Column_2"] == "x"
    assert [r["reject_reason"] for r in reports.reports_without_rows(docs, ["source_file"]).collect()] == ["no detail rows"]


def test_benchmark_file(spark, folder):
    doc = {"date": "2025-09-01", "records": {"_version": {}, "law|x": {"meta": {"category": "law", "subcategory": "x"},
           "cpl": {"median": 100, "dms": {"top10": "bad", "bot10": "7"}}}}}
    put(folder, "2025-09-18-bench.json", json.dumps(doc).encode("utf-8-sig"))
    parsed = reports.parse_benchmark_files(reports.read_documents(spark, folder))
    row = reports.benchmark_rows(parsed, ["source_file"]).first()
    assert (row["key"], row["cpl_median"], row["cpl_top10"], row["cpl_bot10"]) == ("law|x", 100.0, None, 7.0)
    snap = reports.benchmark_snapshots(parsed).first()
    assert (snap["version"], snap["snapshot_date"], snap["records_count"]) == ("2025-09-01", dt.date(2025, 9, 18), 1)


def test_upsert_semantics(spark):
    now = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (None, "n", "old")], "k int, g string, v string")
    new = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (3, "c", "z", 1), (None, "n", "again", 1)], "k int, g string, v string, o int")
    once = tables.upsert(now, new, ["k", "g"], ["o"]).select("k", "g", "v")
    got = sorted((r["k"] or 0, r["v"]) for r in once.collect())
    assert got == [(0, "again"), (0, "old"), (1, "y"), (2, "old"), (3, "z")]
    keyed = new.where("k is not null")
    twice = tables.upsert(tables.upsert(now, keyed, ["k", "g"], ["o"]).select("k", "g", "v"), keyed, ["k", "g"], ["o"])
    assert twice.count() == 4
    assert "updated_at" in tables.upsert(now, keyed, ["k", "g"], ["o"], stamp="updated_at").columns


def test_unseen_rows(spark, folder):
    stored = spark.createDataFrame([(1, "a"), (None, "b")], "k int, g string")
    staged = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "k int, g string")
    assert [r["k"] for r in tables.unseen_rows(staged, stored, ["k", "g"]).collect()] == [2]
    assert sorted(r["k"] or 0 for r in tables.unseen_rows(staged, stored, ["k", "g"], compat=True).collect()) == [0, 2]
    path = folder + "/history"
    tables.append(stored, path)
    assert tables.load_unseen(staged, path, ["k", "g"]) == 1
    assert tables.load_unseen(staged, path, ["k", "g"]) == 0


def test_publish_and_replace(spark, folder):
    a = spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file string, v int")
    tables.publish(a, "book_now", folder + "/book", "1")
    tables.refresh(lambda: a.withColumn("v", F.col("v") * 10), "book_now", folder + "/book", "2")
    assert spark.table("book_now").agg(F.sum("v")).first()[0] == 30
    tables.replace_files(a, folder + "/files")
    tables.replace_files(spark.createDataFrame([("f2", 5), ("f2", 6)], "source_file string, v int"), folder + "/files")
    assert sorted(r["v"] for r in spark.read.parquet(folder + "/files").collect()) == [1, 5, 6]
    entry = tables.snapshot_entry(a, "x.csv", AS_OF, 10).first()
    assert (entry["record_count"], entry["snapshot_date"]) == (2, AS_OF)


def test_exports(spark, folder):
    df = spark.createDataFrame([(1, dt.date(2025, 1, 2))], "n int, d date").coalesce(1)
    report_ops.export_json(df, folder + "/j")
    assert spark.read.text(folder + "/j").first()[0] == '{"n":1.0,"d":"2025-01-02"}'
    report_ops.export_csv(df, folder + "/c")
    assert [r[0] for r in spark.read.text(folder + "/c").collect()] == ["n,d", "1,2025-01-02"]
    report_ops.export_csv(df.limit(0), folder + "/e")
    assert spark.read.text(folder + "/e").first()[0] == "No data available"


def test_alert_log_round_trip(spark, folder):
    alerts = spark.createDataFrame([(dt.datetime(2025, 9, 18, 11), "WARN", "t", "m", "{}")], "timestamp timestamp_ntz, level string, title string, message string, details string")
    tables.append_alerts(alerts, folder + "/alerts")
    tables.append_alerts(alerts, folder + "/alerts")
    assert files.read_alert_log(spark, folder + "/alerts").where("level = 'WARN'").count() == 2


def test_drop_stream_equals_batch_and_rerun_adds_nothing(spark, folder):
    drop, root, ck = folder + "/drop", folder + "/table", folder + "/ck"
    day1 = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    day2 = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, o int")
    day1.write.mode("append").parquet(drop)

    def run():
        stream = drops.drop_stream(spark, drop, "k int, v string, o int")
        q = drops.apply_drops(stream, root, "drops_now", ["k"], ["o"], ck)
        q.awaitTermination(120)
        return sorted((r["k"], r["v"]) for r in spark.table("drops_now").collect())

    assert run() == [(1, "a"), (2, "b")]
    day2.write.mode("append").parquet(drop)
    want = sorted((r["k"], r["v"]) for r in tables.upsert(day1, day2, ["k"], ["o"]).collect())
    assert run() == want == [(1, "a"), (2, "c"), (3, "d")]
    assert run() == want


def test_sparkline_and_trend_edges(spark):
    def calc(values):
        df = spark.createDataFrame([(values,)], "v array<double>")
        return df.select(trajectory.sparkline_of(F.col("v")).alias("s"), trajectory.trend_of(F.col("v")).alias("t")).first()

    assert calc([]).s == [] and calc([5.0]).s == []
    assert calc([5.0, 5.0]).s == [50, 50] and calc([5.0, 5.0]).t["direction"] == "stable"
    nine = calc([float(i) for i in range(9)])
    assert nine.s == [0, 17, 33, 50, 67, 83, 100] and nine.t["confidence"] == "high"
    assert calc([20.0, 10.0]).t["direction"] == "declining" and calc([10.0, 20.0]).t["direction"] == "improving"


def test_keyword_fallback_with_wildcards(spark):
    camps = spark.createDataFrame(
        [("1", "P", "a%c plan", 10, 100.0, 90.0), ("2", "P", "of in", 10, 100.0, 90.0), ("3", "P", "Zeta one", 10, 100.0, 90.0)],
        "campaign_id string, partner_name string, campaign_name string, days_elapsed int, running_cid_cpl double, cpl_goal double")
    hist = spark.createDataFrame(
        [(70, dt.date(2025, m, 1), "P", n, float(m), 1, 1.0) for m, n in ((1, "xxABBC"), (2, "zeta x"), (3, "other"))],
        "campaign_id bigint, report_month date, business_name string, campaign_name string, cost_per_lead double, leads bigint, spend double")
    got = {r["campaign_id"]: [p["month"].month for p in (r["points"] or [])] for r in trajectory.history_points(camps, hist).collect()}
    assert got == {"1": [1], "2": [3, 2, 1], "3": [2]}


def test_playbook_gap(spark):
    df = spark.createDataFrame([(["Search"],), (["Search", "SEO", "DASH"],), (None,)], "p array<string>")
    assert [r[0] for r in book.with_missing_product(df, "p").select("missing_product").collect()] == ["SEO", None, "Search"]


def test_top_per_key_trims_before_the_shuffle(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    for df in (top_per_key(lines, ["l_orderkey"], [F.desc("l_shipdate")], 3), newest_per_key(lines, ["l_orderkey"], [F.desc("l_shipdate")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan.split("Exchange hashpartitioning", 1)[1]
        assert "WindowGroupLimit" in below


def test_scoring_has_no_shuffle_and_no_python(spark, small):
    from spendlens.plans import testbed as tb

    rows = spark.createDataFrame(tb.campaigns(spark, small).limit(50).collect(), tb.campaigns(spark, small).schema)
    plan = scoring.score_risk(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    from spendlens.operators import performance
    from spendlens.plans import performance_queries as pq

    df = performance.filter_performance(pq.performance(spark, small), channel="2-HIGH").select("campaign_id", "actual_spend")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "orders.parquet" in line][0]
    assert "EqualTo(o_orderpriority,2-HIGH)" in scan
    assert "o_orderstatus" not in scan


def test_campaign_tables(spark):
    from spendlens.operators import quality

    spark.range(1).withColumnRenamed("id", "mcid_clicks").createOrReplaceTempView("clicks_view")
    assert "clicks_view" in quality.campaign_tables(spark)


def test_reports_by_name(spark):
    from spendlens.operators import reports as r

    assert r.date_range("campaign_performance", AS_OF) == (AS_OF - dt.timedelta(days=30), AS_OF)
    assert r.date_range("executive_summary", AS_OF)[0] == AS_OF - dt.timedelta(days=365)
    with pytest.raises(KeyError):
        r.build_report("nope", None, AS_OF)


def rows_of(spark, folder, name, **kwargs):
    return [r.asDict() for r in files.read_reports(spark, folder, configs.SOURCES[name], **kwargs).drop("source_file", "source_row").collect()]


def test_files_with_other_header_orders_are_united_by_name(spark, folder):
    put(folder, "sf_partner_calls_1.csv", b"Call ID,Partner Name,Call Date\n1,ACME,2025-01-01\n")
    put(folder, "sf_partner_calls_2.csv", b"Partner Name,Call ID,Call Date,Extra\nBETA,2,2025-01-02,x\n")
    got = sorted(rows_of(spark, folder, "sf_partner_calls"), key=lambda r: r["call_id"])
    assert got == [
        {"call_id": "1", "partner_name": "ACME", "call_date": "2025-01-01", "extra": None},
        {"call_id": "2", "partner_name": "BETA", "call_date": "2025-01-02", "extra": "x"},
    ]


def test_quoted_cells(spark, folder):
    put(folder, "sf_partner_calls_1.csv", b'Call ID,Partner Name,Notes\n1,"said ""hi"", bye","line one\nline two"\n2,B,corporate portal outage\n')
    got = sorted(rows_of(spark, folder, "sf_partner_calls"), key=lambda r: r["call_id"])
    assert got == [
        {"call_id": "1", "partner_name": 'said "hi", bye', "notes": "line one\nline two"},
        {"call_id": "2", "partner_name": "B", "notes": "corporate portal outage"},
    ]


def test_stray_quotes_where_quoting_is_off(spark, folder):
    text = "Business ID\tAlert Type\tCreated Date\n1\t\"a\tx\n2\tb\ty\n3\tc\"\tz\n4\td\tw\n"
    put(folder, "dfp_rij_1.csv", text.encode("utf-16"))
    assert sorted(r["business_id"] for r in rows_of(spark, folder, "dfp_rij")) == ["1", "2", "3", "4"]


def test_guards_only_where_a_source_asks(spark, folder):
    put(folder, "spend_revenue_1.csv", b"MAID,Campaign ID\n1,[x]\n2,corporate portal\n")
    put(folder, "spend_revenue_2.csv", b"<!DOCTYPE html><html>\n<body>corporate portal</body>\n")
    source = configs.SOURCES["spend_revenue_performance"]
    assert len(rows_of(spark, folder, "spend_revenue_performance")) == 2
    assert [r["file_name"] for r in ingest.rejected_reports(spark, folder, source).collect()] == ["spend_revenue_2.csv"]
    assert ingest.rejected_reports(spark, folder, configs.SOURCES["sf_partner_calls"]).count() == 0


def test_usual_date_spellings(spark):
    from spendlens.functions import cleaning

    cells = [
        "2025-09-18", "2025-09-18T11:18:34", "2025-09-18T11:18:34.000+0000", "2025-09-18 11:18:34.123456", "9/18/2025 11:18 AM", "18-Sep-2025",
        "9-18-2025", "Sep 18 2025", "9/18/25", "2025-09-18T11:18:34Z", "2025/09/18", "18 Sep 2025", "Sep 18, 2025", "20250918", " 9/18/2025 ",
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r[0] for r in df.select(cleaning.parse_date("c")).collect()} == {dt.date(2025, 9, 18)}
    raw = spark.createDataFrame([("soon", "x"), ("2025-01-01", "y"), ("NULL", None), (None, None)], "start_date string, other string")
    assert [tuple(r) for r in ingest.unparsed_dates(raw).collect()] == [("start_date", 2, 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_last_row_of_a_file_wins(spark, folder, partitions):
    lines = "".join(f"{i % 5},P{i % 5},2025-01-0{1 + i % 5},note {i}\n" for i in range(40))
    put(folder, "sf_partner_calls_2025-09-19.csv", ("Call ID,Partner Name,Call Date,Notes\n" + lines).encode())
    source = configs.SOURCES["sf_partner_calls"]
    fresh = ingest.ingest(spark, folder, source, LOADED, AS_OF).repartition(partitions)
    table = ingest.load(None, fresh, source)
    assert "source_row" not in table.columns
    assert sorted(r["notes"] for r in table.collect()) == [f"note {i}" for i in range(35, 40)]
    assert ingest.load(table, fresh, source).count() == 5


def test_text_mode_is_a_choice(spark, folder):
    put(folder, "ultimate_dms_2025-09-19.csv", b"Campaign ID,Advertiser Name\n1,Joe Pizza Shop\n")
    source = configs.SOURCES["ultimate_dms"]
    names = [ingest.ingest(spark, folder, source, LOADED, AS_OF, text_mode=m).first()["advertiser_name"] for m in ("compat", "collapse", None)]
    assert names == ["JoePizzaShop", "Joe Pizza Shop", "Joe Pizza Shop"]


def test_repeated_labels_of_a_crm_report(spark):
    df = spark.createDataFrame([(["Amount", "Amount", "Name", "Amount", "Amount_2"],), ([],)], "h array<string>")
    got = [r[0] for r in df.select(reports.numbered(F.col("h"))).collect()]
    assert got[1] == [] and len(set(got[0])) == 5 and got[0][0] == "Amount" and got[0][2] == "Name" and got[0][4] == "Amount_2"


def test_stream_keeps_rows_with_a_new_checkpoint_and_leaves_other_buckets_alone(spark, folder):
    root = os.path.join(folder, "table")

    def run(number, rows):
        drop = os.path.join(folder, f"drop{number}")
        spark.createDataFrame(rows, "k int, v string, o int").write.parquet(drop)
        stream = drops.drop_stream(spark, drop, "k int, v string, o int")
        drops.apply_drops(stream, root, "kept_now", ["k"], ["o"], os.path.join(folder, f"check{number}"), buckets=8).awaitTermination(120)
        return sorted((r["k"], r["v"]) for r in spark.table("kept_now").collect())

    def written():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}

    first = [(k, "a") for k in range(20)]
    assert run(1, [(k, "a", 1) for k in range(20)]) == first
    before = written()
    assert run(2, [(3, "b", 2)]) == sorted([*((k, v) for k, v in first if k != 3), (3, "b")])
    after = written()
    assert before.items() <= after.items()
    assert len({os.path.dirname(p).split("/_bucket=")[1].split("/")[0] for p in after.keys() - before.keys()}) == 1
    old = drops.forget_versions(spark, root, 1).collect()
    assert len(old) == 1 and old[0]["_version"] == 1


def test_catalog_helpers(spark, folder):
    put(folder, "items.json", b'[{"a": 1}, {"a": 2}]')
    assert sorted(r["a"] for r in files.read_json_items(spark, folder).collect()) == [1, 2]
    spark.range(3).write.parquet(os.path.join(folder, "p"))
    assert files.read_parquet_files(spark, os.path.join(folder, "p")).select("source_file").distinct().count() >= 1


def test_default_snapshot(spark):
    schema = "snapshot_date date, file_name string, file_size_bytes bigint, record_count bigint, last_modified timestamp_ntz, is_current boolean"
    some = spark.createDataFrame([(AS_OF, "a.csv", 1, 2, LOADED, False), (AS_OF, "b.csv", 1, 2, LOADED, None)], schema)
    now = F.lit("2025-09-21 01:02:03").cast("timestamp_ntz")
    assert [r["file_name"] for r in book.current_or_default_snapshot(some, now).collect()] == ["b.csv"]
    (row,) = book.current_or_default_snapshot(some.limit(0), now).collect()
    assert (row["snapshot_date"], row["file_name"], row["record_count"], row["is_current"]) == (dt.date(2025, 9, 21), "database", 0, True)


def test_drivers_of_every_scorer_can_be_drawn(spark):
    from spendlens.operators.risk import waterfall

    listed = "array<struct<name: string, impact: double, is_controllable: boolean, why: string, rel_pct: double>>"
    rows = [(20.0, 11.0, [("Few leads", 9.0, True, "w", 40.0)], None), (16.0, 11.0, [], 5.0), (14.0, 11.0, None, 3.0), (0.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, f"total double, base double, drivers {listed}, risk_pacing_pp double")
    drawn = waterfall.churn_waterfall(df, F.col("total"), F.col("base"), waterfall.uniform_drivers(df, "drivers"), F.col("total"))
    got = [r["waterfall"] and [(d["label"], d["pp"], d["type"], d["rel_pct"]) for d in r["waterfall"]["drivers"]] for r in drawn.collect()]
    assert got == [[("Few leads", 9, "controllable", 40.0)], [("Off-pacing", 5, "controllable", None)], [("Off-pacing", 3, "controllable", None)], None]


def test_campaign_samples(spark):
    from spendlens.operators import quality

    spark.createDataFrame([(1, "x"), (2, "y")], "campaign_id int, note string").createOrReplaceTempView("sampled_campaigns")
    assert sorted(quality.campaign_samples(spark)["sampled_campaigns"]) == ['{"campaign_id":1,"note":"x"}', '{"campaign_id":2,"note":"y"}']
