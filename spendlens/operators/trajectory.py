"""Cost-per-lead trajectories: up to twelve months per campaign, trend, sparkline and period averages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..shared import written
from .joins import top_per_key
from .keyword_index import keyword_matches, name_index

MONTHS = 12

# Words that say nothing about a campaign, and the glyphs of a text sparkline.
STOPWORDS = ("search", "sem", "campaign", "the", "and", "or", "for", "of", "in", "on", "at")
GLYPHS = ("▁", "▂", "▃", "▄", "▅", "▆", "▇", "█")


def first_keyword(name) -> Column:
    """First word of a campaign name that is no stopword and longer than two characters, else ''."""
    text = F.translate(F.coalesce(F.col(name), F.lit("")), "|-", "  ")
    words = F.filter(
        F.split(text, r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOPWORDS)
    )
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def _newest() -> list[Column]:
    """Order of the months of a key, newest first. Months of one date follow campaign id."""
    return [F.desc_nulls_first("report_month"), F.asc("campaign_id")]


def _points(history: DataFrame, keys: list[str]) -> DataFrame:
    """Newest twelve months per key as an array, newest first.

    The array is built over the window that ranks the months, so neither a second sort nor a hash table of lists is
    needed.
    """
    top = top_per_key(history, keys, _newest(), MONTHS, "_pos")
    point = F.struct("_pos", F.col("report_month").alias("month"), F.col("cost_per_lead").alias("cpl"), "leads", "spend")
    whole = Window.partitionBy(*keys).orderBy(*_newest()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = top.select(*keys, "_pos", F.collect_list(point).over(whole).alias("points"))
    return listed.where("_pos = 1").select(*keys, F.sort_array("points").alias("points"))


def _own_points(months: DataFrame) -> DataFrame:
    """Newest twelve months per campaign, from its months per business and campaign name.

    They come from the twelve names with the newest first month, so at most 144 months of a campaign meet. Most
    campaigns have one name, so nothing is trimmed before the rows move to the task of their campaign.
    """
    order = [F.desc_nulls_first(F.col("points")[0]["month"]), F.asc("business_name"), F.asc("campaign_name")]
    top = top_per_key(months.where(F.col("campaign_id").isNotNull()).repartition("campaign_id"), ["campaign_id"], order, MONTHS, "_name")
    whole = Window.partitionBy("campaign_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = top.select("campaign_id", "_name", F.collect_list("points").over(whole).alias("lists")).where("_name = 1")
    # Newest first: months as falling day numbers, a missing month before all others.
    keyed = F.transform(F.flatten("lists"), lambda p: F.struct((-F.unix_date(p["month"])).alias("age"), p.alias("p")))
    merged = F.transform(F.slice(F.sort_array(keyed), 1, MONTHS), lambda k, i: k["p"].withField("_pos", i + 1))
    return listed.select("campaign_id", F.when(F.size("lists") == 1, F.col("lists")[0]).otherwise(merged).alias("points"))


def _months_by_name(months: DataFrame) -> DataFrame:
    """The twelve newest months per business and campaign name, one row each.

    They belong to the twelve campaigns with the newest first month, which alone are unfolded.
    """
    keys = ["business_name", "campaign_name"]
    first = F.col("points")[0]["month"]
    top = top_per_key(months, keys, [F.desc_nulls_first(first), F.asc("campaign_id")], MONTHS, "_campaign")
    rows = top.select(*keys, "campaign_id", F.explode("points").alias("p")).select(
        *keys, "campaign_id", F.col("p.month").alias("report_month"), F.col("p.cpl").alias("cost_per_lead"), "p.leads", "p.spend")
    return top_per_key(rows, keys, _newest(), MONTHS, "_pos").drop("_pos")


def _by_keyword(keys: DataFrame, months: DataFrame) -> DataFrame:
    """Months of a business whose campaign names contain a keyword, for each (partner_name, keyword).

    ``months`` (``points`` per campaign and name) is first cut to the twelve newest months per business and campaign
    name, which cannot lose a month that belongs to the twelve of a keyword, for businesses that need it, and written
    once for all steps. Names and keywords meet through a q-gram index of the names (``keyword_index``): candidates from
    a keyword's rarest piece, kept if they hold all its pieces, then the pattern test; no step joins a keyword with all
    names of its business.
    """
    wanted = keys.select(F.col("partner_name").alias("business_name")).distinct()
    by_name = written(_months_by_name(months.join(wanted, "business_name", "left_semi")), "history-by-name")
    empty = F.col("keyword") == ""
    index = name_index(by_name, "business_name", "campaign_name")
    named = keyword_matches(keys.where(~empty).select(F.col("partner_name").alias("owner"), "keyword"), index)
    named = named.select(F.col("owner").alias("partner_name"), "keyword", F.col("name").alias("campaign_name"))
    by_name = by_name.withColumnRenamed("business_name", "partner_name")
    found = named.join(by_name, ["partner_name", "campaign_name"])
    whole = keys.where(empty).select("partner_name", "keyword").join(
        top_per_key(by_name, ["partner_name"], _newest(), MONTHS, "_pos").drop("_pos"), "partner_name"
    )
    columns = ["partner_name", "keyword", "campaign_id", "report_month", "cost_per_lead", "leads", "spend"]
    return _points(found.select(*columns).unionByName(whole.select(*columns)), ["partner_name", "keyword"])


def history_points(campaigns: DataFrame, history: DataFrame) -> DataFrame:
    """``points`` per campaign: its own months, or those of its business found by keyword when it has none.

    The history is read once: its months per campaign and name are written, and own months as well as months by name
    follow from them. Campaign rows are never written, so a caller's columns alone are read, and only campaigns
    without months of their own meet the months by keyword.
    """
    known = history.where(F.col("cost_per_lead").isNotNull())
    months = written(_points(known, ["campaign_id", "business_name", "campaign_name"]), "months-by-campaign")
    hid = F.col("campaign_id").try_cast("bigint")
    keyword = first_keyword("campaign_name")
    usable = (F.coalesce("partner_name", F.lit("")) != "") & (F.coalesce("campaign_name", F.lit("")) != "")
    # Keywords are cut out of the names of lost campaigns alone.
    lost = campaigns.select("campaign_id", "partner_name", "campaign_name", hid.alias("_hid")).join(
        months.select(F.col("campaign_id").alias("_hid")), "_hid", "left_anti")
    lost = written(lost.select("campaign_id", "partner_name", F.when(usable, keyword).alias("keyword")), "lost-campaigns")
    keys = written(lost.where(F.col("keyword").isNotNull()).select("partner_name", "keyword").distinct(), "lost-keywords")
    borrowed = _by_keyword(keys, months).withColumnRenamed("points", "_points")
    ids = lost.select(F.col("campaign_id").alias("_lost")).distinct()
    rows = campaigns.join(ids, F.col("campaign_id").eqNullSafe(F.col("_lost")), "left_semi").withColumn("keyword", keyword)
    found = rows.join(borrowed, ["partner_name", "keyword"], "left").withColumn("points", F.when(usable, F.col("_points")))
    own = _own_points(months).toDF("_hid", "_points")
    owners = campaigns.withColumns({"keyword": keyword, "_hid": hid}).join(own, "_hid").withColumn("points", F.col("_points"))
    return owners.drop("_hid", "_points").unionByName(found.drop("_points"))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def change_of(values: Column) -> Column:
    """Newest three (or half) against the rest, in per cent of the rest."""
    n = F.size(values)
    take = F.least(F.lit(3), F.floor(n / 2).cast("int"))
    recent, older = _mean(F.slice(values, 1, take)), _mean(F.slice(values, take + 1, F.greatest(n - take, F.lit(0))))
    return _let(older, lambda o: F.try_divide(recent - o, o) * 100)


def trend_of(values: Column, direction_only: bool = False, change: Column | None = None) -> Column:
    """Newest three (or half) against the rest: direction beyond ±10 %, size, days covered and confidence.

    ``change`` names a column that already holds ``change_of(values)``.
    """
    n = F.size(values)
    change = change_of(values) if change is None else change
    enough = n >= 2
    return F.struct(
        F.when(~enough, "insufficient_data")
        .when(change > 10, "declining")
        .when(change < -10, "improving")
        .otherwise("stable")
        .alias("direction"),
        F.when(enough, F.abs(change)).alias("percentage"),
        F.when(enough, n * 30).alias("period_days"),
        F.when(n > 6, "high").when(n > 3, "medium").otherwise("low").alias("confidence"),
    )


def sparkline_of(values: Column, keep: int = 7, newest: bool = False) -> Column:
    """Values scaled to 0..100; flat series sit at 50, fewer than two points draw nothing.

    Series run newest first, and the stored sparkline takes the last ``keep`` of them, the oldest ones.
    ``newest`` takes the first ones instead.
    """
    n = F.size(values)
    part = (
        F.slice(values, 1, keep) if newest else F.slice(values, F.greatest(n - (keep - 1), F.lit(1)), F.lit(keep))
    )

    def scale(b):
        low, high = b["low"], b["high"]
        return F.transform(
            b["part"], lambda v: F.when(low == high, 50).otherwise(half_even(F.try_divide(v - low, high - low) * 100).cast("int"))
        )

    # Cut and bounds are computed once per series, not once per value.
    bounds = lambda p: F.struct(p.alias("part"), F.array_min(p).alias("low"), F.array_max(p).alias("high"))
    scaled = _let(_let(part, bounds), scale)
    return F.when(n >= 2, scaled).otherwise(F.array().cast("array<int>"))


def glyphs_of(sparkline: Column) -> Column:
    table = F.array(*[F.lit(g) for g in GLYPHS])
    level = lambda v: F.least(F.floor(v / 12.5), F.lit(7)).cast("int")
    return F.array_join(F.transform(sparkline, lambda v: F.get(table, level(v))), "")


def _quality(count: Column, age: Column) -> Column:
    return (
        F.when(count == 0, "none")
        .when((count < 3) | (age < 60), "limited")
        .when(count < 6, "moderate")
        .otherwise("rich")
    )


def trajectories(campaigns: DataFrame, history: DataFrame, as_of: dt.date, agreed: DataFrame | None = None) -> DataFrame:
    """One trajectory per campaign. ``agreed`` adds the contracted CPL where a campaign has one."""
    rows = history_points(campaigns, history).withColumns(
        {
            "points": F.coalesce("points", F.array().cast("array<struct<_pos:int,month:date,cpl:double,leads:bigint,spend:double>>")),
            "campaign_age_days": F.coalesce(F.col("days_elapsed"), F.lit(0)),
        }
    )
    # A month without cost is a data point but carries no CPL.
    priced = F.filter("points", lambda p: p["cpl"] != 0)
    rows = rows.withColumns({"_n": F.size("points"), "_priced": priced})
    values = F.transform("_priced", lambda p: p["cpl"])
    age_of = lambda p: F.datediff(F.lit(as_of), p["month"])

    def mean_where(test):
        """Mean cost of the months that pass, in one walk over the months."""
        none = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
        add = lambda a, p: F.when(
            test(p), F.struct((a["total"] + p["cpl"]).alias("total"), (a["n"] + 1).alias("n"))).otherwise(a)
        return F.aggregate("_priced", none, add, lambda a: F.try_divide(a["total"], a["n"]))

    # One column each, so that no later expression repeats it.
    rows = rows.withColumn("_values", values).withColumn("_change", change_of(F.col("_values")))
    empty = F.size("_values") == 0
    out = rows.select(
        *[c for c in campaigns.columns],
        "campaign_age_days",
        F.when(F.col("running_cid_cpl") != 0, F.col("running_cid_cpl")).alias("current_cpl"),
        F.when(F.col("cpl_goal") != 0, F.col("cpl_goal")).alias("goal_cpl"),
        _quality(F.col("_n"), F.col("campaign_age_days")).alias("data_quality"),
        trend_of(F.col("_values"), change=F.col("_change")).alias("trend"),
        sparkline_of(F.col("_values")).alias("sparkline"),
        F.struct(
            mean_where(lambda p: age_of(p) <= 45).alias("last_30d_avg"),
            mean_where(lambda p: age_of(p) <= 105).alias("last_90d_avg"),
            mean_where(lambda p: F.year(p["month"]) == as_of.year).alias("ytd_avg"),
        ).alias("metrics"),
        F.when(empty, 0).otherwise(F.col("_n")).alias("data_points"),
        F.when(~empty, F.date_format(F.get("points", F.col("_n") - 1)["month"], "yyyy-MM")).alias("earliest_data"),
    )
    if agreed is None:
        return out
    terms = agreed.select(
        "campaign_id", F.col("cpl_agreed").alias("agreed_cpl"), F.col("cpl_mcid").alias("mcid_cpl"), "cycle_start_date"
    )
    return out.join(terms, "campaign_id", "left").withColumn(
        "cycle_start", F.date_format("cycle_start_date", "yyyy-MM-dd")
    ).drop("cycle_start_date")
