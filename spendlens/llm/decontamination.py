"""Benchmark decontamination by a stored positional inverted index of the training texts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved, small, unused

#: Characters between words (A-Z are lower-cased before), and the words of a window.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Contaminated documents whose counts and item ids are broadcast to the documents; more are joined by a shuffle.
BROADCAST_RESULTS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; empty for a null."""
    text = text.cast("string")
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() would change letters beyond A-Z too
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def phrase_hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def test_windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, words, grp, items): each distinct window of the items; grp numbers the set of items that hold it."""
    parts = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    parts = parts.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("words"))
    parts = parts.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return parts.select(phrase_hash(F.col("words")).alias("h"), "words", F.xxhash64("items").alias("grp"), "items")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (key, term, pos) of the given terms in the whole texts of docs (key, text), stored in the shared folder."""
    words = docs.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return saved(words.join(small(terms), "term"), "postings").select("key", "term", "pos")


def contaminated_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, hits, n_hit, items) for docs (key, text) in which some window of an item occurs.

    hits are (h, s, len, grp): the window, its first word in the document from 0, its words, its items' group. The counts
    of every test term over all training texts come first: a window with a term that no text holds is gone, the two rarest
    places of every other choose its lists. Only postings of these terms are stored. Each list's positions less the place
    are possible starts; those on both lists are checked word by word against the text.
    """
    windows = saved(test_windows(items, size, item_id, item_text), "windows")
    terms = saved(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    everything = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = everything.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = saved(counts, "term-counts")

    places = windows.select("h", "grp", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    places = places.join(counts, "term")  # inner: a term without postings leaves its windows incomplete
    rank = Window.partitionBy("h").orderBy("n", "off")
    ranked = places.select("*", F.row_number().over(rank).alias("rank"), F.count("*").over(Window.partitionBy("h")).alias("known"))
    ranked = ranked.where("known = len and rank <= 2")
    entry = F.struct("h", "off", "len", "grp")
    lists = ranked.groupBy("term").agg(
        F.collect_list(F.when(F.col("rank") == 1, entry)).alias("first"),
        F.collect_list(F.when((F.col("rank") == 2) | (F.col("len") == 1), entry)).alias("second"),
    )
    lists = saved(lists, "lists")
    postings = positional_index(docs, lists.select("term"))

    def starts(places: str) -> Column:
        at = F.transform(places, lambda x: F.struct(x["h"].alias("h"), (F.col("pos") - x["off"]).alias("s"), x["len"].alias("len"), x["grp"].alias("grp")))
        return F.flatten(F.collect_list(at))

    lists = F.broadcast(lists) if lists.count() <= 20_000 else lists
    per_doc = postings.join(lists, "term").groupBy("key").agg(starts("first").alias("a"), starts("second").alias("b"))
    found = per_doc.select("key", F.array_intersect("a", "b").alias("found")).where(F.size("found") > 0)
    found = saved(found, "candidates")
    texts = docs.join(small(found.select("key")), "key", "left_semi").dropDuplicates(["key"])
    # Written once: the optimizer would otherwise fold the split into the lambda below and split the text again for
    # every candidate, which costs candidates x length.
    texts = saved(texts.join(found, "key").select("key", "found", words_of(F.col("text")).alias("words")), "candidate-words")
    hits = F.filter("found", lambda x: (x["s"] >= 0) & (phrase_hash(F.slice("words", F.greatest(x["s"], F.lit(0)) + 1, x["len"])) == x["h"]))
    exact = texts.select("key", hits.alias("hits")).where(F.size("hits") > 0)

    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["len"]).alias("e"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    exact = saved(exact.select("key", "hits", covered.cast("long").alias("n_hit")), "hits")
    groups = windows.select("grp", F.explode("items").alias("item")).distinct()
    of_doc = exact.select("key", F.explode(F.array_distinct(F.transform("hits", lambda x: x["grp"]))).alias("grp")).join(groups, "grp")
    of_doc = of_doc.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return exact.join(of_doc, "key", "left")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of docs with its own columns and n_words, n_hit, items (sorted item ids as strings), contaminated.

    A window is `size` consecutive words of an item, or all of its words if fewer. Null and empty texts have no words and
    no windows; items without id take part but are not named. Rows of one doc_id are judged each by its own text, repeated
    rows alike; columns of the names added are replaced. Empty tables give no hits.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text).cast("string"))  # a null id is a value of its own
    added = ("n_words", "n_hit", "items", "contaminated")
    own = docs.drop(*added)
    name = unused(own, "_key")
    keyed = own.select("*", key.alias(name), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    spans = contaminated_spans(keyed.select(F.col(name).alias("key"), F.col(text).alias("text")), items, size, item_id, item_text)
    spans = saved(spans.select(F.col("key").alias(name), "n_hit", "items"), "contaminated")
    rows = keyed.join(F.broadcast(spans) if spans.count() <= BROADCAST_RESULTS else spans, name, "left")
    return rows.select(
        *[F.col(f"`{c}`") for c in own.columns],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
