"""Ranked lexical search by bag deduplication: documents that hold the same counts of the items' terms and the same
length factor score alike, so each such class is scored once and only its first members are expanded.

A document is cut to the item vocabulary (the terms of all items); its bag is the sorted list of (term, tf) that
remain, and together with its length factor m it forms the class key. Classes are found by grouping on the 64-bit
hash of (m, bag) and on the bag itself, so a hash collision never merges two classes (the bag verifies the hash).
Every class is scored against every item through a broadcast of the item terms (the stated query set, of checked
byte size) and the class postings, never by a join on a term, so a term that every text holds does not meet in one
task. Per item only the 10 first classes by (score desc, least member) can hold the 10 first documents, and per class
only its 10 least doc_ids; both limits are the top-k of the report and run as partial limits before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: A term is a maximal run of these characters after A-Z are lower-cased; documents per item.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Fixed values of the score: k1 as 1000 * tf / (tf + k1 * m / 1000) with 8 / 1000, and b as 75 / 100.
K1_MILLI, B_PERCENT = 8, 75
#: Item terms that are broadcast to the class postings: bytes of (item, term, weight) rows; beyond it a shuffle join.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The terms of a text, in order and with repeats; empty for a null."""
    lowered = F.translate(text.cast("string"), UPPER, LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(TERM), 0), F.array().cast("array<string>"))


def _bounded(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a saved table) marked for broadcast when its rows measure at most limit bytes."""
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).head()["b"]
    return F.broadcast(df) if size <= limit else df


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id",
                  text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score, n_members): for each item the `top` documents of highest score above 0.

    Statistics cover every row of docs: N rows with at least one term, L all their terms, df rows holding a term.
    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is 25 + (75 * n * N) div L; its score
    sums weight * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's terms with their repeats. Equal scores go by
    ascending doc_id; rank counts from 1. n_members is the size of the document's class (documents of equal bag and m).

    Defined cases: a null or empty text has no terms and never scores; a row with a null doc_id counts in the
    statistics but is never reported; repeated rows are separate documents (the same doc_id may be ranked twice);
    items with a null text or no terms, and items whose score is 0 for every document, have no rows; empty tables
    give no rows. Extra columns of docs and items are ignored, whatever their names.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), terms_of(F.col(text)).alias("terms"))
    q = items.select(F.col(item_id).alias("item_id"), terms_of(F.col(text)).alias("terms"))

    # Item vocabulary with each term's repeats per item; a bounded, stated query set.
    item_terms = saved(q.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term")
                       .agg(F.count("*").alias("q_count")), "search-item-terms")
    vocab = saved(item_terms.select("term").distinct(), "search-vocab")
    vocab = _bounded(vocab, F.octet_length("term") + 16)

    # One pass over the texts: each row's length, and its terms counted per row, those outside the vocabulary as one
    # null term; a row without terms keeps one null row. Words of a row are counted before the shuffle.
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("terms").cast("long").alias("n"), "terms")
    d = d.select("row", "doc_id", "n", F.explode_outer("terms").alias("term"))
    d = d.join(vocab.withColumn("known", F.lit(True)), "term", "left")
    d = d.select("row", "doc_id", "n", F.when(F.col("known"), F.col("term")).alias("term"))
    tf = saved(d.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf")), "search-tf")
    bags = tf.groupBy("row", "doc_id", "n").agg(
        F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))).alias("bag"))
    bags = saved(bags, "search-rows")

    stats = bags.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).head()
    n_docs, n_terms = int(stats["N"]), int(stats["L"])
    if n_terms == 0:
        return spark.createDataFrame([], "item_id " + items.schema[item_id].dataType.simpleString()
                                     + ", rank int, doc_id long, score long, n_members long")
    weights = tf.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.col("df") * 2.0 + 1.0))).cast("long").alias("w"))
    m = F.expr(f"{100 - B_PERCENT} + ({B_PERCENT} * n * {n_docs}L) div {n_terms}L")

    # Classes: rows whose bag holds a term, keyed by the hash of (m, bag) and verified by the bag itself.
    bags = bags.where((F.size("bag") > 0) & F.col("doc_id").isNotNull()).select("doc_id", m.alias("m"), "bag")
    bags = bags.withColumn("key", F.xxhash64("m", "bag"))
    classes = saved(bags.groupBy("key", "m", "bag").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_members"))
                    .select(F.monotonically_increasing_id().alias("cls"), "key", "m", "bag", "least", "n_members"),
                    "search-classes")

    # Each class scored once against every item: class postings x broadcast item terms with their weights.
    wq = saved(item_terms.join(weights, "term").where(F.col("w") > 0), "search-weighted")
    wq = _bounded(wq, F.octet_length("term") + 48)
    postings = classes.select("cls", "m", F.explode("bag").alias("p")).select("cls", "m", "p.term", "p.tf")
    part = F.expr(f"(1000000000L * tf) div (1000L * tf + {K1_MILLI}L * m)")
    scored = postings.join(wq, "term").select("item_id", "cls", (F.col("q_count") * F.col("w") * part).alias("s"))
    scored = scored.groupBy("item_id", "cls").agg(F.sum("s").alias("score")).where(F.col("score") > 0)

    # The first `top` classes per item by (score desc, least member) hold its first `top` documents.
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), "least")
    chosen = scored.join(classes.select("cls", "least"), "cls").withColumn("r", F.row_number().over(by_item))
    chosen = saved(chosen.where(F.col("r") <= top).drop("r", "least"), "search-chosen")

    # Members of the chosen classes (at most items x top of them, broadcast), the `top` least doc_ids of each, limited
    # before the shuffle, so a class of a third of all rows sends at most `top` rows from each task.
    keys = saved(classes.join(chosen.select("cls").distinct(), "cls", "left_semi").select("cls", "key", "m", "bag", "n_members"),
                 "search-chosen-classes")
    keys = _bounded(keys, F.size("bag") * 24 + 64)
    members = bags.join(keys, ["key", "m", "bag"])
    first = Window.partitionBy("cls").orderBy("doc_id")
    members = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top)
    found = chosen.join(members.select("cls", "doc_id", "n_members"), "cls")
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score", "n_members")
