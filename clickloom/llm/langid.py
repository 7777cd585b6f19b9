"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters becomes one blank, and the
1-, 2- and 3-grams of code points are hashed to 2^15 columns.  Learning counts the
columns by language on Spark; the matrix of smoothed log-probabilities (languages
x columns) goes to all tasks, and a slice of documents is scored by gathering its
n-grams' rows and adding them up per document.

The model is fitted on a bounded sample, `PER_LANGUAGE` documents of each
language; prediction reads all of every text.

Defined cases: a null text, or one without letters, is `und` with score 0;
nothing to learn from makes every document `und`; repeated rows are scored
alike; ties go to the first language by name; null languages are not learned.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts
from clickloom.llm.sampling import labelled_sample

#: Documents of each language in the training sample.
PER_LANGUAGE = 4_000
COLUMNS_LOG2, GRAMS = 15, (1, 2, 3)
#: A document counts as this many n-grams at most, so that scores of long texts are not all 1.
EVIDENCE = 100
#: Code points handled at a time.
CHUNK = 1 << 18


class Letters:
    """Normal form of a text as code points."""

    def __init__(self):
        form = np.full(1 << 16, 32, np.int64)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                form[i] = ord(low) if len(low) == 1 else i
        self.form = form

    def of(self, text: bytes) -> np.ndarray:
        """Letters in lower case, one blank before, between and after them; empty without letters."""
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
        out = self.form[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            c = chr(points[i])
            out[i] = ord(c.lower()[:1]) if c.isalpha() else 32
        out = np.concatenate(([32], out, [32]))
        return out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))] if (out != 32).any() else out[:0]


def gram_columns(points: np.ndarray):
    """For each n, the column of every n-gram."""
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            return
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :].astype(np.uint64)
        if n in GRAMS:
            mixed = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - COLUMNS_LOG2)).astype(np.int64)


def chunked(points: np.ndarray):
    """Pieces of a long text that share no n-gram and lose none: (piece, its own positions)."""
    for at in range(0, len(points), CHUNK):
        yield points[at : at + CHUNK + max(GRAMS) - 1], CHUNK


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: log-probabilities, columns x languages
    weights: np.ndarray


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows given."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_t")
    )
    sample = labelled_sample(rows.where("_lang is not null"), "_lang", "_id", per_language)

    def count(slices):
        letters = Letters()
        for batch in slices:
            sums = {}
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                own = sums.setdefault(lang, np.zeros((1 << COLUMNS_LOG2) + 1, np.int64))
                own[-1] += 1
                if text:
                    for piece, size in chunked(letters.of(text)):
                        for columns in gram_columns(piece):
                            own[:-1] += np.bincount(columns[:size], minlength=1 << COLUMNS_LOG2)
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "at", "n"]
                )

    counted = over_texts(sample, "_t", ["_lang"], count, "lang string, at long, n long")
    table = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), (1 << COLUMNS_LOG2) + 1))
    for i, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts[i, own["at"].to_numpy(np.int64)] = own["n"].to_numpy(float)
    documents, counts = counts[:, -1], counts[:, :-1] + 0.5
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T if languages else np.zeros((1 << COLUMNS_LOG2, 0))
    return Model(languages, np.log(documents / max(1.0, documents.sum())), np.ascontiguousarray(weights))


def score(texts: list[bytes | None], model: Model, letters: Letters) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text; a batch's n-grams are summed per text at once."""
    rows, starts, texts_at, grams, pending = [], [], [], np.zeros(len(texts)), 0
    sums = np.zeros((len(texts), len(model.languages)))

    def flush():
        if rows:
            gathered = model.weights[np.concatenate(rows)]
            np.add.at(sums, texts_at, np.add.reduceat(gathered, starts, axis=0))
            rows.clear()
            starts.clear()
            texts_at.clear()

    for i, text in enumerate(texts):
        for piece, size in chunked(letters.of(text)) if text and model.languages else ():
            for columns in gram_columns(piece):
                columns = columns[:size]
                starts.append(pending)
                texts_at.append(i)
                rows.append(columns)
                pending += len(columns)
                grams[i] += len(columns)
            if pending >= CHUNK:
                flush()
                pending = 0
    flush()
    known = grams > 0
    if not known.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    mean = sums / np.maximum(grams, 1)[:, None] * np.minimum(grams, EVIDENCE)[:, None] + model.prior
    best = mean.argmax(axis=1)
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    confidence = np.where(known, 1 / share.sum(axis=1), 0.0)
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], confidence


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (the id), `lang_pred` and `score` of every whole text.

    Spark broadcasts the model with the function, 256 KB a language.
    """
    keep = keep or [id_col]

    def run(slices):
        letters = Letters()
        for batch in slices:
            langs, scores = score(batch.column("_text").to_pylist(), model, letters)
            columns = [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {kind(docs, c)}" for c in keep)
    return over_texts(docs, text_col, keep, run, f"{fields}, lang_pred string, score double")
