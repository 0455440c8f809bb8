"""Keyword-in-name matching (``name ILIKE '%keyword%'``) through a q-gram inverted index, per owner.

Names are indexed once: (owner, gram, name) for every distinct lower-cased piece of one, two and three characters,
plus one length entry per name. A keyword's literal parts (what lies between the wildcards ``%`` and ``_`` and the
escape sign) give its required grams: every piece of the longest usable length, at most three. A name can match only
if it holds all of them and is at least as long as the keyword's fixed characters. Candidates come from the rarest
required gram of each keyword, so a gram that every name of a business holds is never joined in full; the candidates
then meet the postings of all other required grams by (owner, gram, name), and only names that hold every one are
tested with ``ILIKE``. No step joins on the owner alone, so a business that owns a third of all names is split by
its grams, and AQE splits a posting list that is still hot.

A keyword of wildcards only has no literal part: its candidates are the names of its owner that are long enough,
which is its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest indexed piece.
Q = 3
#: Gram of the length entry: a name's row in the index that every keyword without literal parts asks for.
ANY = ""


def name_grams(name: Column) -> Column:
    """Distinct pieces of 1 to Q characters of the lower-cased name, and the length entry."""
    low = F.lower(name)
    return F.array_distinct(F.concat(*[_pieces(low, F.lit(q)) for q in range(1, Q + 1)], F.array(F.lit(ANY))))


def _pieces(text: Column, q: Column) -> Column:
    """Every substring of q characters of text, in order."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, q))


def keyword_grams(keyword: Column) -> Column:
    """The grams every match must hold: all pieces of length min(Q, longest literal part) of the literal parts."""
    parts = F.filter(F.split(F.lower(keyword), r"[%_\\]+"), lambda p: F.length(p) > 0)
    q = F.least(F.lit(Q), F.array_max(F.transform(parts, lambda p: F.length(p))))
    pieces = F.flatten(F.transform(parts, lambda p: _pieces(p, q)))
    return F.when(F.size(parts) > 0, F.array_distinct(pieces)).otherwise(F.array(F.lit(ANY)))


def fixed_length(keyword: Column) -> Column:
    """Characters a match needs at least: those of the keyword that are no ``%`` and no escape sign."""
    return F.length(F.regexp_replace(keyword, r"[%\\]", ""))


def name_index(names: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, gram, name, name_length) for distinct (owner, name) rows."""
    distinct = names.select(F.col(owner).alias("owner"), F.col(name).alias("name")).distinct()
    return distinct.select("owner", "name", F.length("name").alias("name_length"), F.explode(name_grams(F.col("name"))).alias("gram"))


def keyword_matches(keys: DataFrame, index: DataFrame, owner: str = "owner", keyword: str = "keyword") -> DataFrame:
    """(owner, keyword, name) for every name of the keyword's owner with ``name ILIKE '%' || keyword || '%'``.

    keys: (owner, keyword) rows, repeats allowed; index: name_index of the names. Null or empty keywords and null
    owners match nothing (callers treat an empty keyword apart).
    """
    kw = keys.select(F.col(owner).alias("owner"), F.col(keyword).alias("keyword")).where(
        F.col("owner").isNotNull() & (F.coalesce(F.col("keyword"), F.lit("")) != "")).distinct()
    required = kw.select("owner", "keyword", fixed_length(F.col("keyword")).alias("need"),
                         F.explode(keyword_grams(F.col("keyword"))).alias("gram"))
    df = index.groupBy("owner", "gram").agg(F.count("*").alias("df"))
    sized = required.join(df, ["owner", "gram"], "left")
    # A required gram without postings: no name can match.
    per_kw = sized.groupBy("owner", "keyword", "need").agg(
        F.count("*").alias("n_required"), F.count("df").alias("n_known"),
        F.min_by("gram", F.struct("df", "gram")).alias("rarest"))
    per_kw = per_kw.where(F.col("n_required") == F.col("n_known"))
    candidates = per_kw.join(index.withColumnRenamed("gram", "rarest"), ["owner", "rarest"]).where(
        F.col("name_length") >= F.col("need")).select("owner", "keyword", "name", "n_required")
    held = candidates.join(required.select("owner", "keyword", "gram"), ["owner", "keyword"]).join(
        index.select("owner", "gram", "name"), ["owner", "gram", "name"], "left_semi")
    whole = held.groupBy("owner", "keyword", "name", "n_required").agg(F.count("*").alias("n_held")).where(
        F.col("n_held") == F.col("n_required"))
    return whole.where(F.expr("name ILIKE concat('%', keyword, '%')")).select("owner", "keyword", "name")
