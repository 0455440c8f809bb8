"""Secret scans: candidate strings, and a random forest trained from labelled findings that removes false positives.

DataFrame functions and Spark's own forest only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved, small, unused

SPACES = r"[\x20\x09-\x0D]+"
#: A candidate is a run of these characters, or any value that is assigned beside a word that speaks of credentials.
LEAST = 16
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Words beside a value that speak of credentials, and path parts that speak of examples.
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private)"
#: What may stand between such a word and its value; a value in quotes is all between them, another ends before closing marks.
ASSIGNED = KEYWORDS + r"[\w.\-\[\]]*['\"\])]*\s*[=:]+>?\s*"
VALUE = r"(?:\"([^\"]+)|'([^']+)|([^\s'\"]+?)(?=[.,;)}\]'\"]*$|['\"]))"
EXAMPLES = r"(?i)(test|example|sample|fixture|mock|doc)"
#: Words of the dictionary, by how often they stand in the corpus; the list is part of the plan.
DICTIONARY = 400
#: Labelled findings of each kind that the forest is fitted on, the first by hash; TREES and DEPTH bound its size.
TRAIN_ROWS, TREES, DEPTH, SEED = 10_000, 24, 6, 11
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "distinct", "transitions", "entropy", "hex", "coverage", "example_path",
    "keyword_before", "keyword_inside", "assigned", "quoted", "before_length", "after_length",
)


class Scanner(NamedTuple):
    words: list[str]
    forest: RandomForestClassificationModel | None
    constant: float  # the score where only one kind of finding was labelled


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words of three to six letters, counted over all whole texts; at most `most` reach the driver."""
    words = docs.select(F.explode(F.split(F.lower("text"), SPACES)).alias("w")).where(F.length("w").between(3, 7))
    words = words.select(F.regexp_extract("w", r"^([a-z]{3,6})[.,]?$", 1).alias("w")).where("w != ''")
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()
    return [r["w"] for r in top]


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, kept, "")) / F.length(value)


def _assigned(before: Column, word: Column) -> Column:
    """The values in a word that are assigned to a word that speaks of credentials, in the word itself or right before it."""
    inside = [F.regexp_extract_all(word, F.lit(ASSIGNED + VALUE), F.lit(g)) for g in (2, 3, 4)]
    opening = F.when(before.rlike(ASSIGNED + "$"), "=").when(before.rlike(KEYWORDS + r"[\w.\-\[\]]*['\"\])]*$") & word.rlike("^[=:]"), "")
    rest = F.concat(opening, word)  # null where no such word stands before
    behind = [F.coalesce(F.regexp_extract(rest, "^[=:]+>?" + VALUE, g), F.lit("")) for g in (1, 2, 3)]
    return F.filter(F.concat(*inside, F.array(*behind)), lambda x: x != "")


def findings(docs: DataFrame, words: list[str]) -> DataFrame:
    """A row per candidate in docs (key, doc_id, text, source): word (its place among the words, from 0), value, features."""
    split = F.split("text", SPACES)
    each = docs.select("key", "doc_id", "source", split.alias("ws")).select("key", "doc_id", "source", "ws", F.posexplode("ws").alias("word", "w"))
    near = lambda d: F.coalesce(F.get("ws", F.col("word") + d), F.lit(""))
    signed = F.col("w").rlike("[=:]") | near(-1).rlike("[=:]>?$")
    each = each.where(((F.length("w") >= LEAST) & F.col("w").rlike(CANDIDATE)) | signed)
    runs = F.regexp_extract_all("w", F.lit(CANDIDATE), F.lit(0))
    named = F.when(signed, _assigned(F.concat_ws(" ", near(-2), near(-1)), F.col("w"))).otherwise(F.array().cast("array<string>"))
    each = each.select(
        "key", "doc_id", "source", "word", "w", near(-2).alias("b2"), near(-1).alias("b1"), near(1).alias("a1"),
        F.explode(F.array_distinct(F.concat(runs, named))).alias("value"),
    )
    v, w = F.col("value"), F.col("w")
    front = F.call_function("substring_index", w, v, F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    chars = F.split(v, "")
    share = lambda x: F.size(F.filter(chars, lambda c: c == x)) / F.size(chars)
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x)))
    known = F.lit(0.0)
    if words:
        pattern = "(" + "|".join(sorted(words, key=lambda x: (-len(x), x))) + ")"
        known = 1 - F.length(F.regexp_replace(F.lower(v), pattern, "")) / F.length(v)
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return each.select(
        "key", "doc_id", "word", "value",
        F.length(v).cast("double").alias("length"),
        _share(v, "[^0-9]").alias("digits"), _share(v, "[^A-Z]").alias("uppers"), _share(v, "[^a-z]").alias("lowers"),
        _share(v, "[A-Za-z0-9]").alias("signs"),
        F.size(F.array_distinct(chars)).cast("double").alias("distinct"),
        ((F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(v)).alias("transitions"),
        entropy.alias("entropy"),
        yes(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        known.alias("coverage"),
        yes(F.col("source").cast("string").rlike(EXAMPLES)).alias("example_path"),
        yes(F.concat_ws(" ", "b2", "b1").rlike(KEYWORDS)).alias("keyword_before"),
        yes(front.rlike(KEYWORDS)).alias("keyword_inside"),
        yes(F.concat("b1", front).rlike(r"[=:]['\"]?$")).alias("assigned"),
        yes(front.rlike("['\"]$")).alias("quoted"),
        F.length("b1").cast("double").alias("before_length"), F.length("a1").cast("double").alias("after_length"),
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none were reviewed by hand: 1 for a value of letters and digits that is assigned to a word
    that speaks of credentials, 0 for one of letters or digits alone that is not assigned; findings in between have no label."""
    named = (F.col("keyword_before") + F.col("keyword_inside") > 0) & (F.col("assigned") > 0)
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1)
    label = F.when(named & mixed, 1.0).when(~mixed & (F.col("assigned") == 0), 0.0)
    return found.withColumn("label", label).where("label is not null")


def train(labelled: DataFrame, words: list[str]) -> Scanner:
    """Fit the forest on findings with a label of 0 or 1: at most TRAIN_ROWS of each, chosen by hash of their contents.

    Of one kind alone nothing can be learned: every finding then gets that label as its score, and 0 without any.
    """
    first = F.xxhash64("doc_id", "word", "value")
    kinds = [labelled.where(F.col("label") == x).orderBy(first, "doc_id", "word", "value").limit(TRAIN_ROWS) for x in (0.0, 1.0)]
    rows = saved(kinds[0].union(kinds[1]).select(*FEATURES, "label"), "labelled")
    seen = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        return Scanner(words, None, max(seen, default=0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return Scanner(words, forest.fit(vectors.select("features", "label")), 0.0)


def scored(found: DataFrame, scanner: Scanner) -> DataFrame:
    if scanner.forest is None:
        return found.withColumn("score", F.lit(scanner.constant))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    out = scanner.forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return out.select(*found.columns, "score")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.xxhash64("doc_id", text).alias("key"), "doc_id", text.alias("text"), source.alias("source"))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, doc_id, word, value, score, is_secret) for every candidate in every row of docs (doc_id, text, source).

    labelled holds reviewed findings with the features and a label; without it the rules of rule_labels name them. Null and
    empty texts have no candidates; a null source is a path that says nothing; repeated rows give repeated findings, and
    so does one value at two places. Tables without candidates give no rows. Other columns are ignored.
    """
    keyed = _keyed(docs)
    words = dictionary(keyed)
    found = saved(findings(keyed, words), "findings")
    out = scored(found, train(rule_labels(found) if labelled is None else labelled, words))
    return out.select("key", "doc_id", "word", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by `mark`, a short one only where no letter or digit adjoins it; all columns and rows stay, and n_chars, if there, is counted anew."""
    key, values = unused(docs, "_key"), unused(docs, "_values")
    found = scan_secrets(docs).where("is_secret").groupBy(F.col("key").alias(key))
    longest_first = F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a))
    found = saved(found.agg(longest_first.alias(values)), "secrets")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("text").cast("string")))
    ids = small(found.select(key))
    hit = keyed.join(ids, key, "left_semi").join(found, key)
    alone = lambda x: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    literal = F.lit(mark.replace("\\", "\\\\").replace("$", r"\$"))
    put = lambda acc, x: F.when(F.length(x) >= LEAST, F.replace(acc, x, F.lit(mark))).otherwise(F.regexp_replace(acc, alone(x), literal))
    hit = hit.withColumn("text", F.aggregate(values, F.col("text").cast("string"), put))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.char_length("text").cast("long"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(ids, key, "left_anti").select(*own).unionByName(hit.select(*own))
