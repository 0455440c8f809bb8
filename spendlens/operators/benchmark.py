"""Benchmark lookups, batch diagnosis of campaigns against them, and what-if scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even

# Bounds an axis may end at, and the target assumed without any benchmark.
MONEY_AXIS = (0.5, 1, 2, 3, 5, 7.5, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75, 100, 150, 200, 250, 300, 400, 500, 750, 1000)
PERCENT_AXIS = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.80, 1.00)
DEFAULT_TARGET = {"CR": 0.05, "CPC": 3.0, "CPL": 50.0}


def categories(benchmarks: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct active categories in order."""
    rows = benchmarks
    if "active" in rows.columns:
        rows = rows.where("active")
    rows = rows.select(
        F.concat(F.coalesce("category", F.lit("")), F.lit("|"), F.coalesce("subcategory", F.lit(""))).alias("key"),
        "category",
        "subcategory",
    ).distinct()
    return rows if limit is None else rows.orderBy("category", "subcategory").limit(limit)


def latest_benchmarks(benchmarks: DataFrame, order: str = "snapshot_id") -> DataFrame:
    """Rows of the newest snapshot overall."""
    newest = benchmarks.agg(F.max(order).alias(order))
    return benchmarks.join(newest, order, "left_semi")


def newest_per_category(benchmarks: DataFrame, order: str) -> DataFrame:
    """The newest row of every category, whichever snapshot it came from. Combined map-side."""
    values = [c for c in benchmarks.columns if c not in ("category", "subcategory")]
    picked = benchmarks.groupBy("category", "subcategory").agg(F.max_by(F.struct(*values), F.col(order)).alias("v"))
    return picked.select("category", "subcategory", "v.*")


def benchmark_record(row_columns: Sequence[str]) -> Column:
    """Wide benchmark columns as nested metrics: ``cpl.median``, ``cpl.dms.top10`` and so on; zero means unknown."""
    def get(name):
        return F.when(F.col(name) != 0, F.col(name)) if name in row_columns else F.lit(None).cast("double")

    # Percentile suffixes per metric.
    spread = ("top10", "top25", "avg", "bot25", "bot10")
    budget = ("p10_bottom", "p25_bottom", "avg", "p25_top", "p10_top")

    def metric(name, parts):
        return F.struct(
            get(f"{name}_median").alias("median"), F.struct(*[get(f"{name}_{p}").alias(p) for p in parts]).alias("dms")
        ).alias(name)

    return F.struct(
        metric("cpl", spread),
        metric("cpc", spread),
        F.struct(get("ctr_median").alias("median")).alias("ctr"),
        metric("budget", budget),
    )


def diagnose(requests: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Derived rates of each request, the medians of its category, goal status and first recommendation."""
    medians = (
        benchmarks.select(
            "category",
            "subcategory",
            *[F.col(f"{m}_median").alias(f"median_{m}") for m in ("cpl", "cpc", "ctr", "budget")],
        )
    )
    budget, clicks, leads, goal = (F.col(c) for c in ("budget", "clicks", "leads", "goal_cpl"))
    cpl = F.try_divide(budget, leads)
    joined = requests.join(medians, ["category", "subcategory"])
    known = goal.isNotNull() & (goal != 0) & cpl.isNotNull() & (cpl != 0)

    def shown(value, digits):
        return F.when(value != 0, half_even(value, digits))

    return joined.select(
        *requests.columns,
        F.concat_ws("|", "category", "subcategory").alias("category_key"),
        shown(F.try_divide(budget, clicks), 2).alias("cpc"),
        shown(cpl, 2).alias("cpl"),
        shown(F.try_divide(leads.cast("double"), clicks), 4).alias("cr"),
        shown(F.try_divide(clicks.cast("double"), F.col("impressions")), 4).alias("ctr"),
        *[shown(F.col(f"median_{m}"), d).alias(f"median_{m}") for m, d in (("cpl", 2), ("cpc", 2), ("ctr", 4), ("budget", 2))],
        F.when(~known, "unknown").when(cpl <= goal, "achieved").otherwise("behind").alias("goal_status"),
        F.when(known, F.when(cpl <= goal, "scale").otherwise("optimize")).alias("primary_recommendation"),
        F.col("median_cpl").alias("recommended_cpl"),
    )


def target_range(
    metric: str, median: Column, value: Column | None = None, p25: Column | None = None, p75: Column | None = None,
    given_low: Column | None = None, given_high: Column | None = None,
) -> tuple[Column, Column]:
    """Target of a metric: the range given with it, else the middle half, each if both ends are known, else the median (or
    the value, or a default) ±15 %."""
    centre = F.coalesce(*[c for c in (median, value) if c is not None], F.lit(DEFAULT_TARGET[metric]))
    span = F.greatest(F.lit(0.00001), centre * 0.15)
    low, high = F.greatest(F.lit(0.0), centre - span), centre + span
    if p25 is not None and p75 is not None:
        both = p25.isNotNull() & p75.isNotNull()
        low = F.when(both, F.greatest(F.lit(0.0), p25)).otherwise(low)
        high = F.when(both, F.greatest(p75, p25)).otherwise(high)
    if given_low is not None and given_high is not None:
        both = given_low.isNotNull() & given_high.isNotNull()
        low, high = F.when(both, given_low).otherwise(low), F.when(both, given_high).otherwise(high)
    return low, high


def verdict(value: Column, low: Column, high: Column, lower: Column) -> Column:
    """Position of a value against its target; ``lower`` says whether less is better."""
    better = F.when(lower, value < low).otherwise(value > high)
    return (
        F.when(value.isNull() | low.isNull() | high.isNull(), "unknown")
        .when(value.between(low, high), "on_target")
        .when(better, "exceeds_target")
        .otherwise("outside_target")
    )


def delta_pct(value: Column, low: Column, high: Column) -> Column:
    """Distance from the range in percent of its nearer end."""
    tiny = F.lit(1e-9)
    return (
        F.when(value < low, (low - value) / F.greatest(low, tiny) * 100)
        .when(value > high, (value - high) / F.greatest(high, tiny) * 100)
        .otherwise(F.when(value.isNotNull(), 0.0))
    )


def metric_status(value: Column, low: Column, high: Column, lower: Column) -> Column:
    """GOOD on or better than target, AVG up to 15 % off, else WEAK."""
    v = verdict(value, low, high, lower)
    return (
        F.when(value.isNull(), "UNKNOWN")
        .when(v.isin("on_target", "exceeds_target"), "GOOD")
        .when(delta_pct(value, low, high) <= 15, "AVG")
        .otherwise("WEAK")
    )


def _axis(value: Column, stops: Sequence[float], beyond: Column) -> Column:
    want = value * 1.15
    reach = F.filter(F.array(*[F.lit(float(s)) for s in stops]), lambda s: s >= want)
    return F.coalesce(F.array_min(reach), beyond)


def money_axis(value: Column) -> Column:
    return _axis(value, MONEY_AXIS, F.ceil(value * 1.15 / 100) * 100.0)


def percent_axis(value: Column) -> Column:
    return _axis(value, PERCENT_AXIS, F.least(F.lit(1.0), F.ceil(value * 1.15 * 20) / F.lit(20.0)))


def axis_end(metric: Column, value: Column, median: Column, high: Column) -> Column:
    """Where the axis of a metric bar ends; a CPL axis leaves more headroom."""
    zero = F.lit(0.0)
    top = F.greatest(F.coalesce(value, zero), F.coalesce(high, zero), F.coalesce(median, zero))
    roomy = F.greatest(top * 1.4, high * 1.6, F.coalesce(median, zero) * 1.5)
    return F.when(metric == "CR", percent_axis(top)).otherwise(money_axis(F.when(metric == "CPC", top).otherwise(roomy)))


def bar_layout(end: Column, value: Column, low: Column, high: Column, lower: Column) -> Column:
    """Axis end, marker position and section widths of a metric bar, all in percent of the axis."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x, end))) * 100
    first, middle = share(low), share(high - low)
    last = F.greatest(F.lit(0.0), 100 - first - middle)
    total = first + middle + last
    under = F.when(lower, "excellent").otherwise("needs-improvement")
    over = F.when(lower, "needs-improvement").otherwise("excellent")
    return F.struct(
        end.alias("axis_end"),
        share(value).alias("position"),
        F.when(value < low, under).when(value > high, over).otherwise("target-range").alias("section"),
        (first / total * 100).alias("low_width"),
        (middle / total * 100).alias("target_width"),
        (last / total * 100).alias("high_width"),
    )


def metric_rows(diagnosed: DataFrame) -> DataFrame:
    """One row per request and metric with value, median and target range.

    The conversion benchmark is the one its CPC and CPL medians imply.
    """
    med_cr = F.try_divide(F.col("median_cpc"), F.col("median_cpl"))
    rows = []
    for metric, value, median in (("CPL", F.col("cpl"), F.col("median_cpl")), ("CPC", F.col("cpc"), F.col("median_cpc")), ("CR", F.col("cr"), med_cr)):
        low, high = target_range(metric, median, value)
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"), value.alias("value"), median.alias("median"), low.alias("target_low"), high.alias("target_high")
            )
        )
    return diagnosed.select("request_id", F.inline(F.array(*rows)))


def metric_panel(diagnosed: DataFrame) -> DataFrame:
    """Target, verdict, distance, status and bar for CPL, CPC and conversion rate, one row per metric."""
    lower = F.col("metric") != "CR"
    args = (F.col("value"), F.col("target_low"), F.col("target_high"))
    return (
        metric_rows(diagnosed)
        .withColumns({"verdict": verdict(*args, lower), "delta_pct": delta_pct(*args)})
        .withColumns(
            {
                "status": F.when(F.col("value").isNull(), "UNKNOWN")
                .when(F.col("verdict").isin("on_target", "exceeds_target"), "GOOD")
                .when(F.col("delta_pct") <= 15, "AVG")
                .otherwise("WEAK"),
                "_end": axis_end(F.col("metric"), F.col("value"), F.col("median"), F.col("target_high")),
            }
        )
        .withColumn("bar", bar_layout(F.col("_end"), *args, lower))
        .drop("_end")
    )


def rule_diagnosis(diagnosed: DataFrame) -> DataFrame:
    """Main finding per request, checked in order of urgency, with the conversion rate or CPC it would take."""
    value = {"CPL": F.col("cpl"), "CPC": F.col("cpc"), "CR": F.col("cr")}
    median = {
        "CPL": F.col("median_cpl"),
        "CPC": F.col("median_cpc"),
        "CR": F.try_divide(F.col("median_cpc"), F.col("median_cpl")),
    }
    ranges = {m: target_range(m, median[m], value[m]) for m in value}
    lower = {"CPL": F.lit(True), "CPC": F.lit(True), "CR": F.lit(False)}
    df = diagnosed.withColumns({f"_st_{m}": metric_status(value[m], *ranges[m], lower[m]) for m in value})
    weak = {m: F.col(f"_st_{m}") == "WEAK" for m in value}
    clicks, leads, budget = F.col("clicks"), F.col("leads"), F.col("budget")
    suspicious = value["CR"] > F.greatest(ranges["CR"][1] * 1.8, F.lit(0.15))
    untracked = ((leads == 0) & (clicks >= 100)) | F.coalesce(suspicious, F.lit(False))
    good = ~weak["CPL"] & ~weak["CPC"] & ~weak["CR"]
    met = F.col("goal_status").isin("achieved", "on_track")
    cpc_extreme, cr_deep = value["CPC"] > ranges["CPC"][1] * 1.5, value["CR"] < ranges["CR"][0] * 0.5
    behind = F.col("goal_status") == "behind"
    finding = (
        F.when(F.coalesce(clicks, F.lit(0)) == 0, "no_traffic")
        .when(untracked, "verify_tracking")
        .when(budget < 500, "budget_too_low")
        .when(good & met, "ready_to_scale")
        .when(good, "realign_goal")
        .when(behind & weak["CR"] & ~weak["CPC"], "fix_conversion_rate")
        .when(behind & weak["CPC"] & ~weak["CR"], "reduce_traffic_cost")
        .when(behind & F.coalesce(cpc_extreme & ~cr_deep, F.lit(False)), "cpc_then_cr")
        .when(behind, "cr_then_cpc")
        .otherwise("monitor")
    )
    return df.withColumns(
        {
            "diagnosis": finding,
            "provisional": (leads < 15) | (clicks < 300),
            "budget_constrained": budget < 1000,
            "needed_cr": F.when(F.col("goal_cpl") > 0, F.try_divide(value["CPC"], F.col("goal_cpl"))),
            "needed_cpc": F.col("goal_cpl") * value["CR"],
        }
    ).drop(*[f"_st_{m}" for m in value])


def goal_check(diagnosed: DataFrame) -> DataFrame:
    """Position of the goal against the typical CPL range."""
    goal = F.col("goal_cpl")
    low, high = target_range("CPL", F.col("median_cpl"), goal)
    where = F.when(goal < low, "below").when(goal > high, "above").otherwise("within")
    return diagnosed.where(goal.isNotNull()).select(
        "request_id",
        "goal_cpl",
        low.alias("typical_low"),
        high.alias("typical_high"),
        where.alias("position"),
        F.floor(delta_pct(goal, low, high) + 0.5).alias("off_pct"),
    )


def scenario_bounds(budget: Column, cpc: Column, cr: Column) -> dict[str, tuple[Column, Column]]:
    """Slider limits around the current state."""
    one = F.lit(1.0)
    cpc_low, cpc_high = F.greatest(F.lit(0.2), cpc * 0.5), cpc * 1.8
    cr_low, cr_high = F.greatest(F.lit(0.001), cr * 0.3), F.least(one, cr * 2.0)
    return {
        "budget": (F.lit(0.0), F.greatest(budget * 2, F.lit(10000.0))),
        "cpc": (
            F.when(cpc_low >= cpc_high, F.greatest(F.lit(0.2), cpc * 0.5)).otherwise(cpc_low),
            F.when(cpc_low >= cpc_high, cpc * 2.0).otherwise(cpc_high),
        ),
        "cr": (
            F.when(cr_low >= cr_high, F.greatest(F.lit(0.001), cr * 0.5)).otherwise(cr_low),
            F.when(cr_low >= cr_high, F.least(one, cr * 2.0)).otherwise(cr_high),
        ),
    }


def scenarios(diagnosed: DataFrame, grid: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """Clicks, leads and CPL for each (name, budget, CPC, CR factor) of ``grid``, kept within the bounds,
    plus the two scenarios that meet the goal through CR or CPC alone. The grid is exploded from a literal."""
    base = diagnosed.where(F.coalesce("cpc", "median_cpc").isNotNull()).select(
        "request_id",
        "goal_cpl",
        F.col("budget").alias("_b"),
        F.coalesce("cpc", "median_cpc").alias("_c"),
        F.coalesce("cr", F.try_divide("median_cpc", "median_cpl")).alias("_r"),
    ).where(F.col("_r").isNotNull())
    limits = scenario_bounds(F.col("_b"), F.col("_c"), F.col("_r"))
    keep = lambda v, name: F.least(F.greatest(v, limits[name][0]), limits[name][1])
    goal = F.col("goal_cpl")
    make = lambda name, b, c, r: F.struct(
        F.lit(name).alias("scenario"), b.alias("budget"), c.alias("cpc"), r.alias("cr")
    )
    options = [
        make(n, keep(F.col("_b") * fb, "budget"), keep(F.col("_c") * fc, "cpc"), keep(F.col("_r") * fr, "cr"))
        for n, fb, fc, fr in grid
    ]
    options.append(
        F.when((goal > 0) & (F.col("_c") > 0), make("snap_cr", F.col("_b"), F.col("_c"), keep(F.try_divide(F.col("_c"), goal), "cr")))
    )
    options.append(
        F.when((goal > 0) & (F.col("_r") > 0), make("snap_cpc", F.col("_b"), keep(goal * F.col("_r"), "cpc"), F.col("_r")))
    )
    rows = base.select("request_id", F.inline(F.array_compact(F.array(*options))))
    b, c, r = F.col("budget"), F.col("cpc"), F.col("cr")
    rows = rows.withColumns(
        {
            "clicks": F.when((b > 0) & (c > 0), F.try_divide(b, c)).otherwise(0.0),
            "leads": F.when((r > 0) & (c > 0), F.try_divide(b * r, c)).otherwise(0.0),
            "cpl": F.when(r > 0, F.try_divide(c, r)),
        }
    )
    return rows.withColumns(
        {
            "low_volume": (F.col("clicks") < 300) | (F.col("leads") < 15),
            "budget_constrained": (b >= 500) & (b < 1000),
        }
    )


# The columns of a stored diagnosis.
HISTORY = (
    "request_id", "category_key", "budget", "clicks", "leads", "goal_cpl", "cpl", "cpc", "cr", "goal_status", "primary_recommendation",
)


def diagnosis_history(diagnosed: DataFrame, run_at: Column) -> DataFrame:
    """One row to append per diagnosed request: what was asked, what was found, and when. Unknown columns are NULL."""
    have = set(diagnosed.columns)
    return diagnosed.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in HISTORY], run_at.alias("created_at"))
