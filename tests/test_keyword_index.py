"""Keyword-in-name matching by q-gram index against the plain ILIKE join."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spendlens.operators.keyword_index import keyword_matches, name_index


def test_keyword_matches_equal_the_plain_join(spark):
    rng = random.Random(7)
    words = ["Build", "build", "SEM", "Search", "1003", "x%y", "a_b", "É", "ing", "in", "on", "\\%"]
    names = [("hot", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for _ in range(300)]
    names += [(rng.choice(("a", "b", None)), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))) for _ in range(600)]
    names += [("a", None), ("hot", "")]
    keys = [("hot", k) for k in ("build", "BUILD", "%%%", "___", "a_b", "x%y", "in", "i", "Search 1003", "zzz", "\\%", "é", "")]
    keys += [("a", "sem"), ("b", "ON"), (None, "sem"), ("b", None), ("a", "sem")]
    n = spark.createDataFrame(names, "business string, name string").withColumn("gram", F.lit("clash"))
    k = spark.createDataFrame(keys, "owner string, keyword string")
    got = {tuple(r) for r in keyword_matches(k, name_index(n, "business", "name")).collect()}
    plain = k.where(F.col("keyword") != "").join(n, k.owner == n.business).where(F.expr("name ILIKE concat('%', keyword, '%')"))
    want = {tuple(r) for r in plain.select("owner", "keyword", "name").collect()}
    assert got == want and len(want) > 100
