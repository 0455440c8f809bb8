"""Grouped percentiles: exact groups against interpolated ranks, sketch groups within their stated rank error."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from spendlens.operators.percentiles import grouped_percentiles

PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def interpolated(values, p):
    s = sorted(values)
    if not s:
        return None
    at = (len(s) - 1) * p
    lo, hi = s[math.floor(at)], s[math.ceil(at)]
    return lo if math.floor(at) == math.ceil(at) else lo + (hi - lo) * (at - math.floor(at))


def rows(seed=2):
    rng = random.Random(seed)
    out = [("hot", rng.choice((None, rng.random() * 100))) for _ in range(3000)]  # one group of a third of all rows
    out += [(rng.choice(("a", "b", "c", None)), rng.choice((None, float(rng.randrange(50))))) for _ in range(6000)]
    out += [("only-nulls", None), ("one", 7.0)]
    return out


def test_exact_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double").withColumn("sample_size", F.lit(-1))  # an extra column
    got = grouped_percentiles(df, ["k"], {"v": F.col("v")}).collect()
    assert len(got) == len({k for k, _ in data})
    for r in got:
        values = [v for k, v in data if k == r.k and v is not None]
        assert r.exact and r.sample_size == sum(1 for k, _ in data if k == r.k) and r.v_n == len(values)
        for p in PROBS:
            assert r[f"v_p{round(p * 100):02d}"] == interpolated(values, p)


def test_sketch_groups_within_rank_error(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = grouped_percentiles(df, ["k"], {"v": F.col("v")}, exact_max=0, accuracy=100).collect()
    for r in got:
        values = sorted(v for k, v in data if k == r.k and v is not None)
        assert not r.exact
        if not values:
            assert r.v_p50 is None
            continue
        n = len(values)
        for p in PROBS:
            v = r[f"v_p{round(p * 100):02d}"]
            ranks = [i for i, x in enumerate(values) if x == v]
            assert ranks and min(abs(i + 1 - p * n) for i in ranks) <= n / 100 + 1
