"""Language identification by multinomial naive Bayes over hashed character n-grams.

A batch of texts becomes one sparse matrix (row, bucket, count) in numpy, which
is multiplied with the broadcast matrix of log probabilities (256 KB for each
language); the log share of a language's training rows is its prior.

Nulls and texts without a letter are ``und`` with score 0; very long texts are
scored whole, block by block; rows are independent, so repeats and ties behave
alike, and extra columns are kept (those named as the outputs are replaced).
Without any labelled row every text is ``und``; an empty table stays empty.
Equal likelihoods go to the language that sorts first.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import small_batches

UNDETERMINED = "und"
BUCKET_BITS = 16
GRAMS = (1, 2, 3)
#: Fitting reads about so many labelled rows at most, chosen by a hash of their id.
MAX_TRAINING_DOCS = 20_000
#: Languages that a task counts at once; their counts go on, and it begins anew.
LANGUAGES_AT_ONCE = 100
BLOCK = 1 << 19
#: Grams whose evidence counts in full for the score; longer texts are no surer than this.
SCORE_GRAMS = 60


class Model(NamedTuple):
    languages: list[str]
    log_prob: np.ndarray  # float32[buckets, languages]
    prior: np.ndarray  # float64[languages]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(text: str):
    """Bucket numbers of all n-grams, an array for each block and length.

    Letters are lower-cased; whatever lies between two runs of them is one
    space. The result is empty for a text without letters.
    """
    letters = _letters()
    for low in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[low : low + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        real = letters[codes]
        keep = real.copy()
        keep[1:] |= real[:-1]
        codes = np.concatenate(([32], np.where(real, codes, 32)[keep])).astype(np.uint32)
        if not real.any():
            continue
        for n in GRAMS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                yield h >> np.uint32(32 - BUCKET_BITS)


def bounded_sample(labelled: DataFrame, id_col: str, max_docs: int) -> DataFrame:
    """About ``max_docs`` rows at most, by a hash of the id; all, if there are no more."""
    rows = labelled.count()
    if rows <= max_docs:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) < int(max_docs / rows * (1 << 40)))


def _counts(batches):
    """``lang, bucket, n`` of a task's texts; bucket -1 counts the texts."""

    def told(sums):
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in sums:
                if len(sums) >= LANGUAGES_AT_ONCE:
                    yield from told(sums)
                    sums = {}
                sums[lang] = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
            sums[lang][0] += 1
            for h in gram_buckets(text):
                bucket, n = np.unique(h, return_counts=True)
                sums[lang][bucket + 1] += n
    yield from told(sums)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAINING_DOCS, smoothing: float = 0.5) -> Model:
    """Learn from the rows whose label and text are not null.

    Tasks add up their own counts; the driver gets one count for each language
    and bucket, so what it holds grows with the languages, not with the rows.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    sample = bounded_sample(known, "id", max_docs).select("text", "lang")
    table = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    sums = np.zeros(((1 << BUCKET_BITS) + 1, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    sums[table["bucket"].to_numpy() + 1, [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    docs, sums = sums[0], sums[1:] + smoothing
    if not languages:
        return Model(languages, sums.astype(np.float32), docs)
    return Model(languages, np.log(sums / sums.sum(0)).astype(np.float32), np.log(docs / docs.sum()))


def classify_texts(model: Model, texts) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its tempered posterior."""
    texts = list(texts)
    total, size = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)

    def multiply(rows, buckets):
        """Add (row, bucket, 1 for each occurrence) times the matrix; ``rows`` are in order."""
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        total[rows[starts]] += np.add.reduceat(model.log_prob.take(buckets, 0), starts, 0, np.float64)
        size[rows[starts]] += np.diff(starts, append=len(rows))

    rows, buckets, n = [], [], 0
    for k, text in enumerate(texts if model.languages else []):
        for h in gram_buckets(text or ""):
            rows.append(np.full(len(h), k))
            buckets.append(h)
            n += len(h)
        if n >= BLOCK:
            multiply(np.concatenate(rows), np.concatenate(buckets))
            rows, buckets, n = [], [], 0
    if n:
        multiply(np.concatenate(rows), np.concatenate(buckets))
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    odds = (total - total.max(1, keepdims=True)) * np.minimum(1.0, SCORE_GRAMS / np.maximum(size, 1))[:, None]
    names = [model.languages[i] if n else UNDETERMINED for i, n in zip(total.argmax(1).tolist(), size.tolist())]
    return names, np.where(size > 0, 1 / np.exp(odds).sum(1), 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the tempered posterior).

    A map without any shuffle; the matrix is broadcast, its size bounded by
    the number of languages.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(column: pa.Array) -> pa.Array:
        names, scores = classify_texts(shared.value, (x.as_py() for x in column))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_guess")]
    return docs.select(*kept, guess(text).alias("_guess")).select(*kept, "_guess.lang_pred", "_guess.score")
