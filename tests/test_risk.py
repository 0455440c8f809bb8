"""Golden rows, boundaries and properties of the risk model."""

import math

import pytest
from pyspark.sql import functions as F

from spendlens.functions.columns import fence
from spendlens.operators.rank import average_percent_rank
from spendlens.operators.risk import churn, goals, priority, waterfall
from spendlens.operators.risk.params import CATEGORY_LTV, CURRENT, LEGACY, RiskParams
from spendlens.plans import scoring
from spendlens.plans import testbed as tb

SAMPLE = dict(
    campaign_id="4991357", campaign_budget=10000.0, amount_spent=5000.0, io_cycle=2.0, avg_cycle_length=30.0,
    days_elapsed=15.0, utilization=50.0, running_cid_leads=25.0, running_cid_cpl=200.0, cpl_goal=100.0,
    bsc_cpl_avg=150.0, effective_cpl_goal=100.0, advertiser_product_count=1.0, bsc_cpc_average=3.0,
)


def frame(spark, *rows):
    full = [SAMPLE | r for r in rows]
    names = list(full[0])
    schema = ", ".join(f"{n} {'string' if n == 'campaign_id' else 'double'}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)


def test_golden_current(spark):
    scored = churn.attach_drivers(churn.score_churn(frame(spark, {})))
    row = scored.first()
    assert row["_tenure"] == "LTE_90D"
    assert row["churn_prob_90d"] == pytest.approx(0.2926852528848905, abs=1e-12)
    assert row["churn_prob_90d_unclamped"] == row["churn_prob_90d"]
    assert [d["points"] for d in row["risk_drivers"]["drivers"]] == [5.1, 7.4, 5.8]
    assert row["revenue_at_risk"] == pytest.approx(2926.852528848905)
    assert (row["is_safe"], row["churn_risk_band"], row["reconcile_ok"]) == (False, "MEDIUM", True)


def test_golden_legacy(spark):
    rows = frame(spark, {}).withColumns(
        {"expected_leads_to_date": F.lit(50), "expected_leads_monthly": F.lit(100), "is_safe": F.lit(False)}
    )
    row = scoring.score_legacy(rows).first()
    assert row["churn_prob_90d"] == pytest.approx(0.17146564086222205, abs=1e-12)
    assert [d["points"] for d in row["risk_drivers"]["drivers"]] == [4.3, 3.9]
    assert row["churn_risk_band"] == "MEDIUM"
    assert row["revenue_at_risk"] == pytest.approx(1714.6564086222205)


def test_reconciliation_can_fail_without_stopping(spark):
    rows = spark.range(1).selectExpr(
        "0.11D as baseline_p", "1.1459D as f_cpl", "1.6D as f_deficit", "1.8D as f_zero_emerging",
        "cast(null as double) as f_zero_month", "1.35D as f_single", "1.3D as cpl_ratio", "false as is_safe",
        "0.35511D as churn_prob_90d", "0.35511D as churn_prob_90d_unclamped",
    )
    row = churn.attach_drivers(rows).first()
    assert [d["points"] for d in row["risk_drivers"]["drivers"]] == [1.4, 6.1, 10.5, 6.5]
    assert row["risk_drivers"]["p_unclamped_pct"] == 36
    assert row["reconcile_ok"] is False


@pytest.mark.parametrize(
    "p, band", [(0.15, "LOW"), (0.1500001, "MEDIUM"), (0.30, "MEDIUM"), (0.45, "HIGH"), (0.4500001, "CRITICAL")]
)
def test_churn_bands_are_right_closed(spark, p, band):
    from spendlens.functions.numeric import right_closed

    got = spark.range(1).select(right_closed(F.lit(p), CURRENT.churn_bands, churn.CHURN_BANDS).alias("b")).first()["b"]
    assert got == band


@pytest.mark.parametrize("ratio, hazard", [(0.9, 1.0), (1.0, 1.0), (1.2, 1.022), (2.0, 1.55), (2.3, 1.8), (9.0, 1.8)])
def test_hazard_curve(spark, ratio, hazard):
    got = spark.range(1).select(churn.cpl_hazard(F.lit(ratio)).alias("h")).first()["h"]
    assert got == pytest.approx(hazard)


def test_hazard_steps(spark):
    params = RiskParams(smooth_cpl=False)
    got = spark.range(1).select(*[churn.cpl_hazard(F.lit(r), params).alias(f"h{i}") for i, r in enumerate((1.2, 1.4, 3.0, 5.0, 1000.0))])
    assert list(got.first()) == [1.05, 1.2, 1.6, 2.4, 1.0]


@pytest.mark.parametrize("months, bucket", [(3.0, "LTE_90D"), (3.1, "M3_6"), (6.0, "M3_6"), (6.1, "GT_6")])
def test_tenure(spark, months, bucket):
    assert spark.range(1).select(churn.tenure_bucket(F.lit(months)).alias("t")).first()["t"] == bucket


def test_missing_goal_charges_no_deficit(spark):
    rows = frame(spark, {"effective_cpl_goal": None, "running_cid_leads": 1.0}, {"running_cid_leads": 1.0})
    got = churn.score_churn(rows).select("f_deficit").collect()
    assert [r[0] for r in got] == [None, 2.8]


def test_missing_cpl_is_neutral_for_ratio_and_never_safe(spark):
    row = churn.score_churn(frame(spark, {"running_cid_cpl": None})).first()
    assert row["cpl_ratio"] == 0.0 and row["f_cpl"] is None and row["is_safe"] is False


def test_goal_quality_boundaries(spark):
    rows = frame(spark, *[{"cpl_goal": g} for g in (None, 0.0, 74.99, 75.0, 225.0, 225.01)], {"cpl_goal": 500.0, "bsc_cpl_avg": None})
    got = [r[0] for r in rows.select(goals.goal_quality("cpl_goal", "bsc_cpl_avg")).collect()]
    assert got == ["missing", "missing", "too_low", "reasonable", "reasonable", "too_high", "reasonable"]


def test_safe_properties(spark, small):
    rows = fence(
        scoring.score_risk(tb.campaigns(spark, small)),
        ["campaign_id", "is_safe", "churn_prob_90d", "churn_prob_90d_unclamped", "baseline_p", "priority_index", "revenue_at_risk"],
    )
    assert rows.where("is_safe and churn_prob_90d > baseline_p + 1e-12").count() == 0
    assert rows.where("churn_prob_90d_unclamped < baseline_p - 1e-12").count() == 0
    scored = priority.priority_score(rows)
    assert scored.where("is_safe and (flare_score > 15 or flare_band <> 'low')").count() == 0


def test_rank_with_ties_and_a_hot_value(spark):
    values = [1.0] * 400 + [0.5, 2.0, 2.0, 3.5] + [float(i) for i in range(10, 110)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double").repartition(5)
    ranked = average_percent_rank(df, "v", "pct", ["id"], parts=6)
    got = {r["id"]: r["pct"] for r in ranked.collect()}
    order = sorted(values)
    for i, v in enumerate(values):
        first, count = order.index(v) + 1, values.count(v)
        assert got[i] == pytest.approx((first + (count - 1) / 2) / len(values)), (i, v)
    again = average_percent_rank(df.repartition(3), "v", "pct", ["id"], parts=9)
    assert {r["id"]: r["pct"] for r in again.collect()} == got


def test_rank_of_one_value(spark):
    df = spark.createDataFrame([(i, 7.0) for i in range(10)], "id bigint, v double")
    assert {round(r["pct"], 6) for r in average_percent_rank(df, "v", "pct", ["id"]).collect()} == {0.55}


def test_rank_never_sorts_rows_in_one_task(spark, small):
    from spendlens.operators.rank import average_percent_rank as rank

    df = tb.campaigns(spark, small).select("campaign_id", "campaign_budget")
    plan = rank(df, "campaign_budget", "pct", ["campaign_id"])._jdf.queryExecution().executedPlan().toString()
    # The only single-partition step is over range totals, after their aggregation.
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part.split("\n", 2)[1]
        assert "HashAggregate" in below, below


def test_waterfall_rules(spark):
    driver = "struct<name:string,points:double,is_controllable:boolean,explanation:string,lift_x:double>"
    rows = spark.createDataFrame(
        [
            ("a", 30, 11, 30, [("x", 9.6, True, "w", 1.5), ("y", 8.4, False, None, 1.2)]),
            ("b", 11, 11, 20, [("x", 9.2, True, "w", 1.5), ("z", 0.4, True, "w", 1.1)]),
            ("c", 0, 0, 0, []),
            ("d", 5, 11, 5, [("x", -6.2, True, "w", 0.5)]),
        ],
        f"id string, total int, base int, raw int, drivers array<{driver}>",
    )
    out = waterfall.churn_waterfall(rows, F.col("total"), F.col("base"), F.col("drivers"), F.col("raw"))
    got = {r["id"]: r["waterfall"] for r in out.collect()}
    assert [(d["label"], d["pp"], d["type"]) for d in got["a"]["drivers"]] == [("x", 10, "controllable"), ("y", 9, "structural")]
    assert got["a"]["drivers"][1]["why"] == "" and got["a"]["note"] is None
    assert [d["pp"] for d in got["b"]["drivers"]] == [9]
    assert got["b"]["note"] == "SAFE clamp active: displayed churn 11% < model 20%."
    assert got["c"] is None
    assert [(d["pp"], d["type"]) for d in got["d"]["drivers"]] == [(-6, "protective")]
    bars = {r["id"]: r["bars"] for r in waterfall.bar_geometry(out, reconcile=True).where("waterfall is not null").collect()}
    assert [(b["left"], b["width"]) for b in bars["d"]] == [(0.0, 11.0), (5.0, 6.0)]
    assert [b["label"] for b in bars["b"]] == ["Baseline", "x", "Other modeled factors"]


def test_flat_drivers(spark):
    rows = spark.createDataFrame([(25.0, None)], "risk_cpl_pp double, risk_pacing_pp double")
    got = rows.select(waterfall.flat_drivers(rows).alias("d")).first()["d"]
    assert [(d["name"], d["points"], d["is_controllable"]) for d in got] == [("High CPL (≥3× goal)", 25.0, True)]


def test_mean_ltv():
    assert math.isclose(sum(CATEGORY_LTV.values()) / len(CATEGORY_LTV), 48037.037037, rel_tol=1e-9)


def test_legacy_ranked_rejects(spark):
    rows = frame(spark, {}, {"campaign_id": None}, {"campaign_id": "x", "campaign_budget": None})
    ranked, rejected = scoring.score_legacy_ranked(rows)
    assert ranked.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["missing campaign_id", "unreadable budget"]
    assert LEGACY.baselines == (0.09, 0.06, 0.05)


def test_full_book(spark, small):
    book = scoring.explain_book(scoring.score_book(tb.campaigns(spark, small)))
    row = book.select("campaign_id", "priority_tier", "headline_diagnosis", "diagnosis_pills", "waterfall", "actions").first()
    assert row["priority_tier"] and row["headline_diagnosis"]
    assert book.count() == tb.table(spark, small, "orders").count()
