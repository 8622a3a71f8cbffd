"""Operator 7. Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts the hashed n-grams of each language in a bounded sample of labelled documents; the sums have at
most languages x buckets rows. The matrix of log probabilities (languages x buckets, 32-bit) is broadcast; it has at
most ``MODEL_BYTES``: more than 256 languages hash to fewer buckets, half as many for twice the languages. Scoring
gathers the rows of a text's n-grams, a sparse list of bucket numbers, in numpy.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Lengths of the n-grams, and the number of buckets they hash to.
GRAMS = (2, 3)
BUCKETS = 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: The bound of the sample that a model is fitted on: documents of each language (about).
FIT_DOCUMENTS = 4_000
#: Characters worked on at once.
CHUNK = 1 << 18
#: The size of a model, and the buckets that it has at least; what needs more is no language column.
MODEL_BYTES = 64 << 20
LEAST_BUCKETS = 1 << 10
UNKNOWN = "und"

_SPACE, _BREAK = 32, 0
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Normalized characters, the numbers of their text and of their part of one, and how many characters from there
    on were in the part before, some texts (or a part of one) at a time.

    Letters in lower case, each run of others one space, a space at both ends; texts end with ``_BREAK``. A longer
    text is cut every ``CHUNK`` characters; the next part begins with the last ones again, so no n-gram is lost.
    """
    parts, owners, known, size = [], [], [], 0
    longest = max(GRAMS)
    for i, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        last_space, carry, again = True, np.array([_SPACE], np.uint32), 0
        for at in range(0, len(text), CHUNK):
            chars = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = np.where(_letters()[chars], chars, _SPACE).astype(np.uint32)
            space = chars == _SPACE
            before = np.r_[last_space, space[:-1]]
            last_space = bool(space[-1])
            chars = np.r_[carry, chars[~(space & before)]]
            held = np.maximum(again - np.arange(len(chars)), 0)
            if at + CHUNK >= len(text):
                chars = np.r_[chars, np.array([_BREAK] if last_space else [_SPACE, _BREAK], np.uint32)]
                held = np.r_[held, np.zeros(len(chars) - len(held), held.dtype)]
            else:
                carry = chars[-(longest - 1) :]
                again = len(carry)
            parts.append(chars)
            owners.append(i)
            known.append(held)
            size += len(chars)
            if size >= CHUNK:
                yield _joined(parts, owners, known)
                parts, owners, known, size = [], [], [], 0
    if parts:
        yield _joined(parts, owners, known)


def _joined(parts: list[np.ndarray], owners: list[int], known: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    sizes = [len(p) for p in parts]
    return np.concatenate(parts), np.repeat(owners, sizes), np.repeat(np.arange(len(parts)), sizes), np.concatenate(known)


def grams(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each n-gram and the number of its text."""
    for chars, owner, part, known in _chunks(texts):
        wide = chars.astype(np.uint64)
        for n in GRAMS:
            if len(chars) < n:
                continue
            size = len(chars) - n + 1
            # an n-gram lies in one part, and counts in the first that has all of it
            key, whole = wide[:size].copy(), (chars[:size] != _BREAK) & (known[:size] < n)
            for k in range(1, n):
                key = (key << np.uint64(21)) | wide[k : k + size]
                whole &= (chars[k : k + size] != _BREAK) & (part[k : k + size] == part[:size])
            key = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield ((key[whole] >> np.uint64(40)) & np.uint64(buckets - 1)).astype(np.int64), owner[:size][whole]


@dataclass
class Model:
    languages: list[str]
    #: languages x buckets, float32
    log_probability: np.ndarray
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ``und`` and 0 for a text without letters."""
        found = np.zeros((len(texts), len(self.languages)))
        any_letter = np.zeros(len(texts), bool)
        for buckets, owner in grams(texts, self.log_probability.shape[1]):
            for k in range(len(self.languages)):
                found[:, k] += np.bincount(owner, self.log_probability[k][buckets], len(texts))
        for i, text in enumerate(texts):
            any_letter[i] = bool(text) and any(map(str.isalpha, text))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found += self.log_prior
        best = found.argmax(axis=1)
        posterior = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if a else UNKNOWN for a, b in zip(any_letter, best, strict=True)], np.where(any_letter, posterior, 0.0)


def fit(labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """A model from ``labelled(doc_id, text, lang)``; rows without lang or text take no part.

    Every value of lang is a language. Sample: the documents of a language whose hashed doc_id and text are under the
    share that gives about ``fit_documents`` of them. Repeated rows count as often as they come. Without labelled
    rows the model knows no language and answers ``und``.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = MODEL_BYTES // 4 // LEAST_BUCKETS
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: their model is too large to broadcast")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    size = BUCKETS
    while len(languages) * size * 4 > MODEL_BYTES:
        size //= 2
    n_of = {r["lang"]: r["n"] for r in counts}
    whole = 1 << 20
    share = F.from_json(F.lit(json.dumps({lang: min(whole, math.ceil(whole * fit_documents / n)) for lang, n in n_of.items()})), "map<string,int>")
    sample = usable.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", F.col("text").cast("string")), F.lit(whole)) < F.element_at(share, F.col("lang")))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * size, np.int32)
        for batch in (part for w in batches for part in slices(w, 0)):
            of = np.array([number[x] for x in batch.column(1).to_pylist()])
            for buckets, owner in grams(batch.column(0).to_pylist(), size):
                at, n = np.unique(of[owner] * size + buckets, return_counts=True)
                total[at] += n.astype(np.int32)
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    partial = sample.select(F.col("text").cast("string"), "lang").mapInArrow(count, "lang int, bucket int, n long")
    sums = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a model's worth of rows at most
    total = np.full((len(languages), size), SMOOTHING)
    total[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    prior = np.array([n_of[x] for x in languages], float)
    return Model(languages, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score. Every whole text is scored by itself; null text or one without letters
    is ``und`` with 0. Repeated rows are scored each, and all columns are kept (columns named lang_pred or score
    are replaced); no rows give no rows."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in slices(whole, place)):
            languages, scores = own.score(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; a null doc_id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op7_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
