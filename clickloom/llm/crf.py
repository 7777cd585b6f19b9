"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its evidence are its own shares of capitals, symbols,
marks, repeated words and so on, and the same of the lines before and after; a
weight per pair of neighbouring labels ties lines together.  Forward-backward
gives each line's marginal probability of being good, and the length-weighted mean
of the marginals, with that of the worst line, becomes the document's score.

Labels are given for documents only.  Learning starts with the document's label on
all its lines; then lines of bad documents that look as good as those of good ones
are called good, and the field is fitted again.  A last logistic step maps the
aggregates to the probability of label 1.

The model is fitted on a bounded sample: `PER_LABEL` documents of each label, and
of each a run of at most `MOST_LINES` lines from a place chosen by a hash of the
text.  Scoring reads all lines of every text.

Defined cases: null and empty texts, or texts of blank lines only, have score 0;
nothing to learn from gives the score 0.5 to all others; repeated rows score
alike; an empty table gives no rows; extra columns are ignored.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clickloom.llm.common import kind, over_texts
from clickloom.llm.fitting import apply_logistic, logistic, sigmoid
from clickloom.llm.toxicity import sample_of

PER_LABEL, MOST_LINES = 1_000, 100
ROUNDS, RATE, RIDGE = 80, 0.2, 1e-3
#: Cells of a padded batch in forward-backward.
CELLS = 1 << 18

UPPER, LOWER_ = bytes(range(65, 91)), bytes(range(97, 123))
SYMBOLS, DIGITS = b"#*$%&|<>@^_~=+\\/{}[]`", bytes(range(48, 58))
OWN = 17
WIDTH = 3 * OWN + 2


def line_features(lines: list[bytes]) -> np.ndarray:
    """The own features of each line of a document."""
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    x = np.zeros((len(lines), OWN))
    for i, line in enumerate(lines):
        words = line.split()
        n, k = len(line), len(words)
        if not k:
            x[i, 0] = 1
            continue
        upper = n - len(line.translate(None, UPPER))
        lower = n - len(line.translate(None, LOWER_))
        x[i, 1:12] = (
            upper / (upper + lower + 1),
            (n - len(line.translate(None, SYMBOLS))) / n,
            (n - len(line.translate(None, DIGITS))) / n,
            line.count(b"!") / k,
            line.count(b"|") / k,
            len(set(words)) / k,
            sum(map(bytes.isupper, words)) / k,
            seen[line] > 1,
            line.rstrip()[-1:] in b".!?",
            min(1.0, n / k / 20),
            np.log1p(k) / 5,
        )
    x[:, 12:17] = np.sqrt(x[:, (1, 2, 3, 4, 5)])
    x[:, 6] = np.where(x[:, 0] > 0, 0, (1 - x[:, 6]) * 2)
    return x


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after, and flags for the ends."""
    none = np.zeros((1, OWN))
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack((x, np.vstack((none, x[:-1])), np.vstack((x[1:], none)), ends))


def marginals(scores: list[np.ndarray], ties: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Forward-backward over documents: P(good) of each line, expected label pairs, log-partition.

    `scores` holds each line's log-odds for good; `ties` the weights of label pairs.
    """
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    pairs, total = np.zeros((2, 2)), 0.0
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(scores[order[stop]]) <= CELLS:
            stop += 1
        group = order[at:stop]
        at = stop
        lengths = np.array([len(scores[i]) for i in group])
        steps = int(lengths.max())
        e = np.zeros((len(group), steps, 2))
        for r, i in enumerate(group):
            e[r, : lengths[r], 1] = scores[i]
        live = np.arange(steps) < lengths[:, None]
        forward = np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, steps):
            step = np.logaddexp(forward[:, t - 1, :1] + ties[0], forward[:, t - 1, 1:] + ties[1]) + e[:, t]
            forward[:, t] = np.where(live[:, t, None], step, forward[:, t - 1])
        backward = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            after = e[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(ties[:, 0] + after[:, :1], ties[:, 1] + after[:, 1:])
            backward[:, t] = np.where(live[:, t + 1, None], step, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - z[:, None], 0))
        for a in range(2):
            for b in range(2):
                both = forward[:, :-1, a] + ties[a, b] + e[:, 1:, b] + backward[:, 1:, b] - z[:, None]
                pairs[a, b] += np.exp(np.minimum(both, 0))[live[:, 1:]].sum()
        total += z.sum()
        for r, i in enumerate(group):
            out[i] = good[r, : lengths[r]]
    return out, pairs, total


def fit(x: list[np.ndarray], y: list[np.ndarray], weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of line labels by gradient steps with momentum and scaling (Adam)."""
    rows, labels = np.vstack(x), np.concatenate(y)
    cuts = np.cumsum([len(a) for a in x])[:-1]
    seen = np.zeros((2, 2))
    for own in y:
        np.add.at(seen, (own[:-1], own[1:]), 1)
    value = np.concatenate((weights, ties.ravel()))
    first, second = np.zeros_like(value), np.zeros_like(value)
    for k in range(1, ROUNDS + 1):
        weights, ties = value[:-4], value[-4:].reshape(2, 2)
        good, pairs, _ = marginals(np.split(rows @ weights[:-1] + weights[-1], cuts), ties)
        wrong = labels - np.concatenate(good)
        slope = np.concatenate((rows.T @ wrong, [wrong.sum()], (seen - pairs).ravel())) / len(rows) - RIDGE * value
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        value = value + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return value[:-4], value[-4:].reshape(2, 2)


@dataclass
class Model:
    weights: np.ndarray
    ties: np.ndarray
    final: np.ndarray


def lines_of(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text and text.strip() else []


def aggregates(good: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean and worst marginal of each document, as clipped log-odds."""
    mean = [float((g * n).sum() / n.sum()) for g, n in zip(good, lengths)]
    worst = [float(g[n > 1].min()) if (n > 1).any() else float(g.min()) for g, n in zip(good, lengths)]
    p = np.clip(np.column_stack((mean, worst)), 1e-3, 1 - 1e-3)
    return np.log(p) - np.log(1 - p)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
) -> Model:
    """Fit on a bounded sample of the labelled rows given."""
    sample = sample_of(docs, labels, label_col, id_col, text_col, per_label)

    def run(slices):
        for batch in slices:
            rows, sizes = [], []
            for text in batch.column("_text").to_pylist():
                lines = lines_of(text)
                at = zlib.crc32(text or b"") % max(1, len(lines) - MOST_LINES + 1)
                x = with_neighbours(line_features(lines))[at : at + MOST_LINES] if lines else np.zeros((0, WIDTH))
                rows.append(x.astype("<f4").tobytes())
                sizes.append(np.array([len(line) + 1 for line in lines[at : at + MOST_LINES]], "<f4").tobytes())
            columns = [batch.column("_label"), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "x", "n"])

    got = over_texts(sample, "_t", ["_label"], run, "y int, x binary, n binary").toPandas()
    got = got[got["n"].map(len) > 0].sort_values(["y", "x"])
    y = got["y"].to_numpy(np.int64)
    weights, ties = np.zeros(WIDTH + 1), np.zeros((2, 2))
    if not len(y) or y.min() == y.max():
        return Model(weights, ties, np.zeros(3))
    x = [np.frombuffer(b, "<f4").reshape(-1, WIDTH).astype(float) for b in got["x"]]
    n = [np.frombuffer(b, "<f4").astype(float) for b in got["n"]]

    def scored():
        return marginals([a @ weights[:-1] + weights[-1] for a in x], ties)[0]

    weights, ties = fit(x, [np.full(len(a), label) for a, label in zip(x, y)], weights, ties)
    # What lines of good documents look like by themselves; a bad document keeps its worst line bad.
    alone = [sigmoid(a @ weights[:-1] + weights[-1]) for a in x]
    usual = np.median(np.concatenate([a for a, label in zip(alone, y) if label == 1]))
    relabelled = []
    for a, label in zip(alone, y):
        own = np.ones(len(a), np.int64)
        if label == 0:
            own[(a < usual / 2) | (a == a.min())] = 0
        relabelled.append(own)
    weights, ties = fit(x, relabelled, weights, ties)
    return Model(weights, ties, logistic(aggregates(scored(), n), y.astype(float), 0.1))


def score_texts(texts: list[bytes | None], model: Model) -> np.ndarray:
    lines = [lines_of(t) for t in texts]
    some = [i for i, own in enumerate(lines) if own]
    out = np.zeros(len(texts))
    if some:
        scores = [with_neighbours(line_features(lines[i])) @ model.weights[:-1] + model.weights[-1] for i in some]
        good, _, _ = marginals(scores, model.ties)
        lengths = [np.array([len(line) + 1.0 for line in lines[i]]) for i in some]
        out[some] = apply_logistic(aggregates(good, lengths), model.final)
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and `score`, the probability of label 1, of every whole text."""
    keep = keep or [id_col]

    def run(slices):
        for batch in slices:
            scores = score_texts(batch.column("_text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {kind(docs, c)}" for c in keep)
    return over_texts(docs, text_col, keep, run, f"{fields}, score double")
