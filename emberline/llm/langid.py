"""Language identification: multinomial naive Bayes over hashed character n-grams.

The corpus is counted by executors into (language, hash bucket) sums; the driver turns those - languages x buckets numbers at
most - into a matrix of log-probabilities and broadcasts it (buckets x languages x 4 bytes, 1 MB with the defaults and
eight languages). Scoring takes the texts of a chunk as the rows of a sparse matrix (row offsets plus column numbers, each n-gram
one entry of value 1) and multiplies it with the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, chunks, column, slices

UNDETERMINED = "und"
ORDERS = (1, 2, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    """Log share of each language in the labelled rows."""
    log_prob: np.ndarray
    """buckets x languages."""


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _grams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at every place of the joined texts, and where each text begins and ends there.

    Three spaces part the texts, and a text's n-grams start from the space before it to its last character: none
    reaches into another text, so a result does not depend on what else is in the chunk.
    """
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer(("   " + "   ".join(texts) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = 3 + np.concatenate(([0], np.cumsum(lengths + 3)[:-1])) - 1
    bounds = np.stack((start, start + lengths + 1), axis=1).ravel()
    mask = np.uint32(buckets - 1)
    for n in ORDERS:
        h = codes[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + np.uint32(n)
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[i : len(codes) - n + 1 + i] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        yield h & mask, bounds


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = 1 << 15, alpha: float = 0.5, docs_per_language: int = 4000) -> LanguageModel:
    """Counts n-grams by language over the rows of docs with text and language.

    docs_per_language bounds the sample: of a language with more rows, those are taken whose hashed key falls under
    that share, so that its expected number is docs_per_language. Priors come from all rows. Rows without text or
    language are left out; without any row the model has no language and predicts none.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = sorted((r[0], r[1]) for r in rows.groupBy(lang).count().collect())
    languages = [x for x, _ in found]
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    share = F.lit(0.0)
    for name, n in found:
        share = F.when(F.col(lang) == name, min(1.0, docs_per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    at = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), buckets), np.int64)
        for batch in slices(batches):
            langs, texts = column(batch, "lang"), [t.lower() for t in column(batch, "text")]
            for a, b in chunks(texts):
                number = np.array([at[x] for x in langs[a:b]])
                for grams, bounds in _grams(texts[a:b], buckets):
                    kept = np.repeat(np.stack((number, np.full(len(number), -1)), axis=1).ravel(), np.diff(np.append(bounds, len(grams))))
                    grams = grams[bounds[0] :]
                    for i in np.unique(number):
                        sums[i] += np.bincount(grams[kept == i], minlength=buckets)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j], pa.int64())], names=["l", "b", "n"])

    counts = np.zeros((buckets, len(languages)))
    sums = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["b"].to_numpy(), sums["l"].to_numpy()] = sums["n"].to_numpy()
    counts += alpha
    log_prob = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    totals = np.array([n for _, n in found], float)
    return LanguageModel(languages, np.log(totals / totals.sum()), log_prob)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its posterior probability for each text."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    lowered = [texts[i].lower() for i in rows]
    for a, b in chunks(lowered):
        total = np.tile(model.prior, (b - a, 1))
        for grams, bounds in _grams(lowered[a:b], len(model.log_prob)):
            edges = np.minimum(bounds, len(grams) - 1)
            for j in range(len(model.languages)):
                total[:, j] += np.add.reduceat(model.log_prob[:, j][grams], edges, dtype=np.float64)[::2]
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        for k, (best, p) in enumerate(zip(share.argmax(axis=1), share.max(axis=1), strict=True)):
            names[rows[a + k]], scores[rows[a + k]] = model.languages[best], float(p)
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred).

    A text that is null, empty or without a letter gets `und` and 0. Ties go to the language that sorts first. Rows are judged one by one, so repeated
    rows alike, and an empty table gives no rows. Input columns named lang_pred or score are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batch: pa.RecordBatch) -> list[pa.Array]:
        names, scores = score_texts(shared.value, column(batch, text))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, label, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
