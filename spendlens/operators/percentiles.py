"""Grouped percentiles: exact for groups that one task may hold, a mergeable quantile sketch beyond that.

Group sizes are counted first (one row per group, small). A group with at most ``exact_max`` rows is exact: its
sorted values, at most that many in one task, give each percentile by linear interpolation between the two nearest
ranks (position (n - 1) * p, value lo + (hi - lo) * (position - floor(position)), as SQL's ``quantile_cont``). Rows of larger groups take
``percentile_approx``: each task builds a quantile summary of its share and summaries merge before and after the
shuffle, so a group of a third of all rows never meets in one place. Its stated error: the returned value is an
element of the group whose rank differs from p * n by at most n / ``accuracy``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of one group computed exactly; beyond it the sketch.
EXACT_MAX = 100_000
#: Sketch accuracy: rank error at most n / ACCURACY.
ACCURACY = 10_000
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], probs: Sequence[float] = PROBS,
    exact_max: int = EXACT_MAX, accuracy: int = ACCURACY,
) -> DataFrame:
    """keys, sample_size (rows of the group), exact (whether the group was small enough), and per value v:
    v_n (non-null values), v_avg and v_pNN for every p. Nulls of a value are left out of its statistics; a value
    that is null throughout its group gives nulls. Null keys form groups of their own."""
    rows = df.select(*keys, *[c.cast("double").alias(n) for n, c in values.items()])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("sample_size"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = rows.alias("r").join(sizes.alias("s"), cond).select(*[F.col(f"r.{k}") for k in keys],
                                                                 *values.keys(), "sample_size")
    grid = F.array(*[F.lit(float(p)) for p in probs])

    def stats(exact: bool):
        out = [F.first("sample_size").alias("sample_size"), F.lit(exact).alias("exact")]
        for n in values:
            q = F.array_sort(F.collect_list(n)) if exact else F.percentile_approx(n, grid, accuracy)
            out += [F.count(n).alias(f"{n}_n"), F.avg(n).alias(f"{n}_avg"), q.alias(f"{n}_q")]
        return out

    def interpolated(n: str, p: float) -> Column:
        ranked = F.col(f"{n}_q")
        at = (F.size(ranked) - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        lo, hi = F.element_at(ranked, (low + 1).cast("int")), F.element_at(ranked, (high + 1).cast("int"))
        return F.when(F.size(ranked) == 0, F.lit(None)).when(low == high, lo).otherwise(lo + (hi - lo) * (at - low))

    small = joined.where(F.col("sample_size") <= exact_max).groupBy(*keys).agg(*stats(True))
    small = small.select(*keys, "sample_size", "exact", *[c for n in values for c in (
        F.col(f"{n}_n"), F.col(f"{n}_avg"), F.array(*[interpolated(n, p) for p in probs]).alias(f"{n}_q"))])

    large = joined.where(F.col("sample_size") > exact_max).groupBy(*keys).agg(*stats(False))
    both = small.unionByName(large)
    return both.select(
        *keys, "sample_size", "exact",
        *[c for n in values for c in (
            F.col(f"{n}_n"), F.col(f"{n}_avg"),
            *[F.col(f"{n}_q")[i].alias(f"{n}_{_name(p)}") for i, p in enumerate(probs)])],
    )


def benchmark_percentiles(requests: DataFrame, exact_max: int = EXACT_MAX, accuracy: int = ACCURACY) -> DataFrame:
    """The benchmark table of a category from its campaign rows: CPL, CPC and CTR, each as median, average and the
    top and bottom 10 % and 25 % (for CPL and CPC low is good, so top10 is the 10th percentile; for CTR high is good,
    so top10 is the 90th), and budget as median, average and the 10th, 25th, 75th and 90th percentiles. Rates
    exist only where their divisor is above 0. Rounded as stored, half to even: money to cents,
    CTR to six places; budget statistics are taken in whole cents."""
    values = {
        "cpl": F.when(F.col("leads") > 0, F.col("budget") / F.col("leads")),
        "cpc": F.when(F.col("clicks") > 0, F.col("budget") / F.col("clicks")),
        "ctr": F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")),
        "budget": F.round(F.col("budget") * 100),  # cents: sums and averages of whole numbers are exact
    }
    q = grouped_percentiles(requests, ["category", "subcategory"], values, PROBS, exact_max, accuracy)

    def money(c: str, cents: bool = False) -> Column:
        return F.bround(F.col(c) if cents else F.col(c) * 100, 0) / 100

    def low_is_good(m: str):
        return [money(f"{m}_p50").alias(f"{m}_median"), money(f"{m}_p10").alias(f"{m}_top10"),
                money(f"{m}_p25").alias(f"{m}_top25"), money(f"{m}_avg").alias(f"{m}_avg"),
                money(f"{m}_p75").alias(f"{m}_bot25"), money(f"{m}_p90").alias(f"{m}_bot10")]

    def r6(c: str) -> Column:
        return F.bround(F.col(c) * 1_000_000, 0) / 1_000_000

    return q.select(
        "category", "subcategory", *low_is_good("cpl"), *low_is_good("cpc"),
        r6("ctr_p50").alias("ctr_median"), r6("ctr_p90").alias("ctr_top10"), r6("ctr_p75").alias("ctr_top25"),
        r6("ctr_avg").alias("ctr_avg"), r6("ctr_p25").alias("ctr_bot25"), r6("ctr_p10").alias("ctr_bot10"),
        money("budget_p50", True).alias("budget_median"), money("budget_p10", True).alias("budget_p10_bottom"),
        money("budget_p25", True).alias("budget_p25_bottom"), money("budget_avg", True).alias("budget_avg"),
        money("budget_p75", True).alias("budget_p25_top"), money("budget_p90", True).alias("budget_p10_top"),
        F.col("sample_size").cast("int").alias("sample_size"), "exact",
    )
