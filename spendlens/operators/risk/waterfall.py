"""Churn waterfalls: baseline plus drivers in whole percentage points, and their bar geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import half_even, half_up

# Flat input fields of older scores with their label, kind and explanation.
FLAT_FIELDS = (
    ("risk_cpl_pp", "High CPL (≥3× goal)", "controllable", "3× goal historically elevates churn vs cohort."),
    ("risk_new_account_pp", "Early Account (≤90d)", "structural", "First 90 days show elevated hazard vs matured accounts."),
    ("risk_single_product_pp", "Single Product", "structural", "Fewer anchors → higher volatility."),
    ("risk_pacing_pp", "Off-pacing", "controllable", "Under/over-spend drives instability and lead gaps."),
    ("risk_low_leads_pp", "Below expected leads", "controllable", "Lead scarcity increases cancel probability."),
)
DEFAULT_BASELINE = 11


def flat_drivers(df: DataFrame) -> Column:
    """Driver array from the flat fields a frame carries; used when it has no driver list."""
    entries = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.lit(label).alias("name"),
                F.col(name).cast("double").alias("points"),
                F.lit(kind == "controllable").alias("is_controllable"),
                F.lit(why).alias("explanation"),
                F.lit(None).cast("double").alias("lift_x"),
            ),
        )
        for name, label, kind, why in FLAT_FIELDS
        if name in df.columns
    ]
    return F.array_compact(F.array(*entries))


# What each part of a driver is called, by age of the score; the first name that a driver has and fills counts.
DRIVER_FIELDS = {
    "name": (("label", "name"), "string"), "points": (("points", "impact"), "double"), "is_controllable": (("is_controllable",), "boolean"),
    "explanation": (("explanation", "why"), "string"), "lift_x": (("lift_x",), "double"), "rel_pct": (("rel_pct",), "double"),
}


def uniform_drivers(df: DataFrame, drivers: str) -> Column:
    """Drivers of any scorer in one form; where the list is missing or empty, those of the flat fields."""
    have = df.select(F.explode_outer(drivers).alias("d")).schema["d"].dataType.fieldNames()

    def part(d: Column, names: tuple[str, ...], kind: str) -> Column:
        found = [d[n].cast(kind) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    listed = F.transform(drivers, lambda d: F.struct(*[part(d, names, kind).alias(n) for n, (names, kind) in DRIVER_FIELDS.items()]))
    flat = F.transform(
        flat_drivers(df),
        lambda d: F.struct(*[d[n].cast(k).alias(n) for n, (_, k) in DRIVER_FIELDS.items() if n != "rel_pct"], F.lit(None).cast("double").alias("rel_pct")),
    )
    return F.when(F.size(F.coalesce(drivers, F.array())) > 0, listed).otherwise(flat)


def churn_waterfall(
    df: DataFrame, total_pct: Column, baseline: Column, drivers: Column, total_unclamped: Column, out: str = "waterfall"
) -> DataFrame:
    """Whole-point bars that add up to the unclamped total: zero bars go, the rounding rest joins the last bar.

    NULL when there is nothing to draw. Drivers come as this package makes them or from ``uniform_drivers``; ``rel_pct`` is
    shown where a driver has it.
    """
    shape = df.select(drivers.alias("d")).schema["d"].dataType.elementType.fieldNames()
    df = df.withColumns(
        {
            "_total": half_even(total_pct).cast("int"),
            "_base": half_even(baseline).cast("int"),
            "_target": half_even(F.coalesce(total_unclamped, total_pct)).cast("int"),
            "_bars": F.filter(
                F.transform(
                    drivers,
                    lambda d: F.struct(
                        F.coalesce(d["name"], F.lit("Driver")).alias("label"),
                        half_even(d["points"]).cast("int").alias("pp"),
                        F.when(d["points"] < -0.5, "protective")
                        .when(d["is_controllable"], "controllable")
                        .otherwise("structural")
                        .alias("type"),
                        F.coalesce(d["explanation"], F.lit("")).alias("why"),
                        d["lift_x"].alias("lift_x"),
                        *([d["rel_pct"].alias("rel_pct")] if "rel_pct" in shape else []),
                    ),
                ),
                lambda b: b["pp"] != 0,
            ),
        }
    )
    bars = F.col("_bars")
    rest = F.col("_target") - F.col("_base") - F.aggregate(bars, F.lit(0), lambda acc, b: acc + b["pp"])
    last = F.size(bars) - 1
    settled = F.transform(
        bars, lambda b, i: F.when(i == last, b.withField("pp", b["pp"] + rest)).otherwise(b)
    )
    shown_base = F.greatest(F.lit(0), F.least(F.lit(100), F.col("_base")))
    empty = (F.col("_total") == 0) & (F.col("_base") == 0) & (F.size(bars) == 0)
    note = F.when(
        F.col("_total") < F.col("_target"),
        F.format_string("SAFE clamp active: displayed churn %d%% < model %d%%.", F.col("_total"), F.col("_target")),
    )
    drawn = F.struct(
        F.col("_total").alias("total_pct"),
        F.col("_target").alias("math_total_unclamped"),
        shown_base.alias("baseline"),
        shown_base.alias("baseline_pp"),
        settled.alias("drivers"),
        note.alias("note"),
        F.lit(100).alias("cap_to"),
        F.lit(False).alias("show_ranges"),
    )
    return df.withColumn(out, F.when(~empty, drawn)).drop("_total", "_base", "_target", "_bars")


def waterfall_of_scores(df: DataFrame, out: str = "waterfall") -> DataFrame:
    """Waterfall of frames scored by this package."""
    payload = F.col("risk_drivers")
    return churn_waterfall(
        df, payload["p_clamped_pct"], payload["baseline"], payload["drivers"], payload["p_unclamped_pct"], out
    )


def stored_waterfall(df: DataFrame, out: str = "churn_waterfall") -> DataFrame:
    """Waterfall as served next to partner opportunities: points cut to whole numbers, nothing reconciled."""
    payload = F.col("risk_drivers")
    drivers = F.transform(
        payload["drivers"],
        lambda d: F.struct(
            F.coalesce(d["name"], F.lit("Risk Factor")).alias("name"),
            F.coalesce(d["points"], F.lit(0.0)).cast("int").alias("points"),
            F.coalesce(d["is_controllable"], F.lit(False)).alias("is_controllable"),
            F.coalesce(d["explanation"], F.lit("Risk factor affecting churn probability.")).alias("explanation"),
            F.coalesce(d["lift_x"], F.lit(1.0)).alias("lift_x"),
        ),
    )
    return df.withColumn(
        out,
        F.when(
            payload.isNotNull(),
            F.struct(
                half_even(F.coalesce("churn_prob_90d", F.lit(0.0)) * 100).cast("int").alias("total_pct"),
                F.coalesce(payload["baseline"], F.lit(DEFAULT_BASELINE)).alias("baseline_pp"),
                drivers.alias("drivers"),
            ),
        ),
    )


def bar_geometry(df: DataFrame, waterfall: str = "waterfall", reconcile: bool = False, out: str = "bars") -> DataFrame:
    """Position of every bar on a 0..100 track: baseline, then each driver from the running total.

    The running total stays within the track. With ``reconcile`` a last bar closes a gap of a point or more.
    """
    w = F.col(waterfall)
    cap = w["cap_to"].cast("double")
    bound = lambda c: F.greatest(F.lit(0.0), F.least(cap, c))

    def bar(label, kind, start, end, pp):
        return F.struct(
            label.alias("label"),
            kind.alias("kind"),
            F.least(start, end).alias("left"),
            F.abs(end - start).alias("width"),
            pp.cast("int").alias("pp"),
        )

    zero = F.lit(0.0)
    start = bound(w["baseline_pp"].cast("double"))
    first = F.struct(start.alias("at"), F.array(bar(F.lit("Baseline"), F.lit("baseline"), zero, start, start)).alias("bars"))
    walked = F.aggregate(
        w["drivers"],
        first,
        lambda acc, d: F.struct(
            bound(acc["at"] + d["pp"]).alias("at"),
            F.concat(
                acc["bars"], F.array(bar(d["label"], d["type"], acc["at"], bound(acc["at"] + d["pp"]), d["pp"]))
            ).alias("bars"),
        ),
    )
    df = df.withColumn("_walk", walked)
    bars = F.col("_walk.bars")
    if reconcile:
        at = F.col("_walk.at")
        gap = half_up(bound(w["total_pct"].cast("double")) - at)
        rest = F.array(bar(F.lit("Other modeled factors"), F.lit("residual"), at, bound(at + gap), gap))
        bars = F.when(F.abs(gap) >= 1, F.concat(bars, rest)).otherwise(bars)
    return df.withColumn(out, bars).drop("_walk")
