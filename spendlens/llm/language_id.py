"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import ready
from .words import blocks

#: N-grams of one to four bytes are hashed into so many counters; this bounds the model whatever the corpus.
COUNTERS = 1 << 16
SIZES = (1, 2, 3, 4)
#: A label table with more languages than this is refused: the model would not fit the driver.
MOST_LANGUAGES = 200
#: Code length for more than five languages, where the code with every split in two would be too long.
CODE_BITS = 31
UNDETERMINED = "und"
#: Distance from the best codeword beyond which a text is far; short texts scatter more, by FAR_SHORT over the root of their n-grams.
FAR, FAR_SHORT = 0.45, 3.0
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, entries -1 and 1
    weights: np.ndarray  # counters x bits: log odds of the bit's two sides
    trust: np.ndarray  # weight of each bit's loss
    usual: np.ndarray | None = None  # languages x bits: mean log odds of an n-gram in the language's own texts


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1. Up to five languages: a bit for every split in two; else columns at a fixed random seed,
    the best of many draws by the smallest distance of two codewords."""
    if n <= 5:
        sides = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s] or [(0,)]
        return np.array([[1 if i in s else -1 for s in sides] for i in range(n)], np.int8)
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, CODE_BITS))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(2)[np.triu_indices(n, 1)].min()
        if apart > most:
            best, most = code, apart
    return best


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[[*range(65), *range(91, 97), *range(123, 128)]] = 32  # signs, digits and white space are alike
    return fold


_FOLD = _fold()


def _grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, counter of the n-gram from each byte on), not minding where texts end."""
    folded, h = _FOLD[raw], np.zeros(len(raw), np.uint32)
    for n in SIZES:
        if len(raw) < n:
            return
        h = h[: len(raw) - n + 1] + (folded[n - 1 :] + np.uint32(n)) * _FACTORS[n - 1]
        yield n, ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each counter is met in the texts of each language. One row per task, language and counter
    is shuffled, so a language that holds most rows costs no more than another."""
    ready(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, end, raw, offsets in blocks(batch.column("text")):
                names = sorted(set(langs[first:end]))
                owner = np.repeat(np.array([names.index(x) for x in langs[first:end]], np.int64), np.diff(offsets))
                for n, gram in _grams(raw):
                    got = np.bincount(owner[: len(gram)] * COUNTERS + gram, minlength=len(names) * COUNTERS).reshape(-1, COUNTERS)
                    for name, row in zip(names, got, strict=True):
                        if name not in sums:
                            if len(sums) >= MOST_LANGUAGES:
                                raise ValueError(f"more than {MOST_LANGUAGES} languages")
                            sums[name] = np.zeros(COUNTERS, np.int64)
                        sums[name] += row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(row[at])})

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a text and a language. At most MOST_LANGUAGES x COUNTERS counts reach the driver.

    Each bit's classifier compares the n-gram distributions of the languages on its two sides, each language weighing the
    same. Its trust is how well it tells the languages' own distributions apart.
    """
    found = gram_counts(docs, text, lang).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), COUNTERS))
    counts[np.searchsorted(languages, found["lang"].to_numpy(str)), found["gram"].to_numpy()] = found["n"].to_numpy()
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(languages) else counts
    code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int8)
    weights = np.zeros((COUNTERS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        one, other = code[:, bit] == 1, code[:, bit] == -1
        if one.any() and other.any():
            weights[:, bit] = np.log(share[one].mean(0)) - np.log(share[other].mean(0))
            margin = code[:, bit] * (share @ weights[:, bit])
            trust[bit] = max(0.05, float(np.tanh(10 * margin.min())))
    return Model(languages, code, weights, trust / trust.sum() if len(trust) else trust, share @ weights)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its score, lead over the next) per row of summed log odds: the codeword with the least logistic loss,
    each bit weighing by its trust; scores are a soft minimum over the languages' losses."""
    agree = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -agree) * model.trust).sum(2)
    scores = np.exp(loss.min(1, keepdims=True) - loss)
    scores /= scores.sum(1, keepdims=True)
    best = scores.argmax(1)
    top = np.sort(scores, 1)
    lead = top[:, -1] - (top[:, -2] if scores.shape[1] > 1 else 0)
    return best, top[:, -1], lead


def distances(model: Model, margins: np.ndarray, grams: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How far each text is from its best codeword, by mean log odds of its n-grams: 0 where every bit speaks for the language
    as clearly as its own training texts do, about 1 where the bits say nothing, more where they speak against it."""
    if model.usual is None:
        return np.zeros(len(margins))
    code, usual = model.code[best], model.usual[best]
    clear = np.abs(usual) > 1e-9  # one language alone has nothing to be told from
    agree = margins / np.maximum(grams, 1)[:, None] * code / np.where(clear, np.abs(usual), 1.0)
    return (np.where(clear, np.maximum(1 - agree, 0), 0) * model.trust).sum(1)


def _has_letter(raw: np.ndarray) -> bool:
    low = raw | 32
    return bool(((low >= 97) & (low <= 122)).any()) or any(map(str.isalpha, bytes(raw[raw >= 128]).decode("utf-8", "ignore")))


def predict(docs: DataFrame, model: Model, text: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """docs with lang_pred, score (0 to 1), ambiguous, distance and far added, by the whole text alone.

    `und` with score 0 for a null text, one without letters, or if nothing was learned. ambiguous: the two best codewords
    are nearly as close as each other (their scores differ by less than ambiguous_below), or the text is `und`. Ties go to
    the language first in the alphabet. distance is that of `distances` (null for `und`); far: it exceeds FAR by more than
    chance explains in a text of that length. Repeated rows are predicted alike; columns of these five names are replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous", "distance", "far")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COUNTERS x bits floats

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, lead = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n)
            distance, slack = np.full(n, np.nan), np.zeros(n)
            for first, end, raw, offsets in blocks(batch.column(text).cast(pa.string())):
                if not model.languages:
                    break
                full = np.flatnonzero(np.diff(offsets) > 0)
                margins, grams = np.zeros((end - first, model.code.shape[1])), np.zeros(end - first)
                for size, gram in _grams(raw):
                    rows = full[offsets[full + 1] - offsets[full] >= size]
                    if not len(rows):
                        continue
                    grams[rows] += offsets[rows + 1] - offsets[rows] - size + 1
                    took = np.zeros((len(raw) + 1, 1))  # prefix sums, a bit at a time
                    for bit in range(model.code.shape[1]):
                        np.cumsum(model.weights[gram, bit], dtype=np.float64, out=took[1 : len(gram) + 1, 0])
                        margins[rows, bit] += took[offsets[rows + 1] - size + 1, 0] - took[offsets[rows], 0]
                best, top, gap = decode(model, margins)
                apart = distances(model, margins, grams, best)
                for row in full:
                    if _has_letter(raw[offsets[row] : offsets[row + 1]]):
                        lang[first + row], score[first + row], lead[first + row] = model.languages[best[row]], top[row], gap[row]
                        distance[first + row], slack[first + row] = apart[row], FAR_SHORT / np.sqrt(grams[row])
            out = {name: batch.column(name) for name in batch.schema.names}
            out |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(lead < ambiguous_below)}
            told = ~np.isnan(distance)
            out |= {"distance": pa.array(distance, mask=~told), "far": pa.array(told & (distance > FAR + slack))}
            yield pa.record_batch(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predicted, f"{fields}, lang_pred string, score double, ambiguous boolean, distance double, far boolean")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: a fixed quarter by the checksum of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
