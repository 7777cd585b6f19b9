"""Quality rules by distribution divergence.

Base rules count words, repeated lines and repeated three-word windows.  The
method compares two histograms of a document with those of each language in the
corpus, by Jensen-Shannon distance: character classes, and common words (those
with a share of at least `COMMON` of a language's words; the rest is one bin).
The language whose reference is nearest counts, so a missing or wrong language
tag does no harm.  A histogram is judged only if the document is long enough.

References are exact sums over all documents.  Slices pass on words with half of
COMMON of their own words.  Those of a common word add up to half of COMMON of the
corpus at least, since what is not passed on is less than the other half; so a
bounded number of candidates is left, and a second pass counts these.

Defined cases: a null text has no words and fails the base rules; without any
language tag there are no references, and only the base rules decide; repeated
rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts, stored
from clickloom.llm.decontaminate import words_of

#: Least share of a common word.
COMMON = 0.004
#: Largest distance of character classes; that of common words is the first number, and for chance the second over
#: the root of the number of words.
MOST_CLASSES, MOST_WORDS = 0.28, (0.10, 2.3)
#: Least characters and words for a verdict.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Base rules: least words, and the largest share of words in repeated windows, in percent.
BASE_WORDS, BASE_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
KINDS = ("lower", "upper", "digit", "space", "sentence", "symbol", "other")


@dataclass
class References:
    languages: list[str]
    #: languages x character classes, as shares
    classes: np.ndarray
    #: each common word of any language with its column
    words: dict[bytes, int]
    #: languages x columns, as shares; what is missing from 1 is the bin of other words
    shares: np.ndarray


class Classes:
    """Character classes of a text."""

    def __init__(self):
        table = np.full(1 << 16, 6, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                table[i] = 1 if c.isupper() else 0
            elif c.isdigit():
                table[i] = 2
            elif c.isspace():
                table[i] = 3
        for c in ".,;:!?'\"()-":
            table[ord(c)] = 4
        for c in "#*$%&|<>@^_~=+\\/{}[]`":
            table[ord(c)] = 5
        self.table = table

    def count(self, text: bytes) -> np.ndarray:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
        return np.bincount(self.table[np.minimum(points, 0xFFFF)], minlength=len(KINDS))


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    solid = b"".join(words)
    chars = len(solid) - len(solid.translate(None, bytes(b for b in range(256) if b & 0xC0 != 0x80)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, covered = {}, bytearray(len(words))
        for i, w in enumerate(windows):
            first = seen.setdefault(w, i)
            if first != i:
                covered[i : i + 3] = covered[first : first + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common: float = COMMON) -> References:
    """Exact character-class and common-word shares of each language, over all documents."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_t"))
    rows = rows.where("_lang is not null")

    names = ["lang", "what", "word", "n"]
    schema = "lang string, what string, word binary, n long"

    def emit(rows):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.int64()))]
        return [pa.RecordBatch.from_arrays(columns, names=names)] if rows else []

    def first(slices):
        classes = Classes()
        for batch in slices:
            words, kinds = {}, {}
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                if text:
                    words.setdefault(lang, Counter()).update(words_of(text))
                    kinds[lang] = kinds.get(lang, 0) + classes.count(text)
            rows = []
            for lang, own in words.items():
                total = own.total()
                rows += [(lang, "word", w, n) for w, n in own.items() if n >= common / 2 * total]
                rows.append((lang, "total", b"", total))
                rows += [(lang, "class", b"%d" % i, int(n)) for i, n in enumerate(kinds[lang])]
            yield from emit(rows)

    found = over_texts(rows, "_t", ["_lang"], first, schema)
    counted = stored(found.groupBy("lang", "what", "word").agg(F.sum("n").alias("n")), "shares")
    totals, kinds = {}, {}
    for r in counted.where("what <> 'word'").collect():
        if r.what == "total":
            totals[r.lang] = r.n
        else:
            kinds.setdefault(r.lang, np.zeros(len(KINDS)))[int(bytes(r.word))] = r.n

    def least(share):
        out = F.lit(0.0)
        for lang in totals:
            out = F.when(F.col("lang") == lang, F.lit(share * totals[lang])).otherwise(out)
        return out

    # At most 2 / common words of a language can pass.
    likely = counted.where(F.col("what") == "word").where(F.col("n") >= least(common / 2)).select("word").distinct()
    wanted = {bytes(r.word) for r in likely.collect()}

    def second(slices):
        for batch in slices:
            out = {}
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                if text:
                    out.setdefault(lang, Counter()).update(w for w in words_of(text) if w in wanted)
            yield from emit([(lang, "word", w, n) for lang, own in out.items() for w, n in own.items()])

    exact = over_texts(rows, "_t", ["_lang"], second, schema)
    languages = sorted(totals)
    kept = exact.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least(common)).collect()
    words = {w: i for i, w in enumerate(sorted({bytes(r.word) for r in kept}))}
    shares = np.zeros((len(languages), len(words)))
    for r in kept:
        shares[languages.index(r.lang), words[bytes(r.word)]] = r.n / totals[r.lang]
    classes = np.array([kinds[k] / kinds[k].sum() for k in languages]).reshape(-1, len(KINDS))
    return References(languages, classes, words, shares)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of p to q, from 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def nearest(counts: np.ndarray, totals: np.ndarray, shares: np.ndarray, rest: bool) -> np.ndarray:
    """Distance of each row of counts to the nearest reference; with `rest`, words a language has not are one bin."""
    best = np.ones(len(counts))
    own = counts / np.maximum(totals, 1)[:, None]
    for q in shares:
        at = q > 0 if rest else np.ones(len(q), bool)
        p, q = own[:, at], q[at]
        if rest:
            p, q = np.column_stack((p, 1 - p.sum(axis=1))), np.append(q, 1 - q.sum())
        best = np.minimum(best, distance(np.clip(p, 0, 1), np.clip(q, 0, 1)))
    return best


def judge(
    docs: DataFrame,
    refs: References,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    most_classes: float = MOST_CLASSES,
    most_words: tuple[float, float] = MOST_WORDS,
) -> DataFrame:
    """Kept columns, the counts, both distances (null where not judged), base_failed and kept."""
    keep = keep or [id_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]

    def run(slices):
        classes = Classes()
        for batch in slices:
            texts = batch.column("_text").to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            kinds = np.array([classes.count(t or b"") for t in texts]).reshape(-1, len(KINDS))
            hits, totals = np.zeros((len(texts), len(refs.words))), np.zeros(len(texts))
            for i, text in enumerate(texts):
                words = words_of(text)
                totals[i] = len(words)
                at = [c for c in map(refs.words.get, words) if c is not None]
                if at:
                    hits[i] = np.bincount(at, minlength=len(refs.words))
            chars = kinds.sum(axis=1)
            far_classes = nearest(kinds, chars, refs.classes, False)
            far_words = nearest(hits, totals, refs.shares, True)
            no_classes = (chars < LEAST_CHARS) | (not refs.languages)
            no_words = (totals < LEAST_WORDS) | (not refs.languages)
            failed = (base[:, 0] < BASE_WORDS) | (100 * base[:, 4] > BASE_REPEATED * base[:, 0])
            limit = most_words[0] + most_words[1] / np.sqrt(np.maximum(totals, 1))
            kept = ~failed & (no_classes | (far_classes <= most_classes)) & (no_words | (far_words <= limit))
            columns = [*(batch.column(c) for c in keep), *(pa.array(base[:, i]) for i in range(5))]
            columns += [pa.array(far_classes, mask=no_classes), pa.array(far_words, mask=no_words), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    fields = ", ".join(f"`{c}` {kind(docs, c)}" for c in keep)
    counts = ", ".join(f"{n} long" for n in names[:5])
    return over_texts(
        docs, text_col, keep, run, f"{fields}, {counts}, class_distance double, word_distance double, base_failed boolean, kept boolean"
    )
