"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and writes symbols: insult (with a weight),
threat, target, negation, reported speech, clause end, or other.  Insults are
words and word stems learned from labelled documents, weighted by log-odds; the
small closed classes are fixed lists.  Four transducers follow the symbols, each
with a short memory: target and threat (a target near by), negation (its scope),
and reported speech (until the clause ends).  They are composed into one table of
states, so a text is read once.  An insult or threat closes a match whose kind
says what surrounds it; matches are summed by kind, and a logistic model learned
from the same labelled documents weighs the kinds.  So a negated or quoted insult
counts as much as the labels say it does.

The lexicon and the model are fitted on a bounded sample, `PER_LABEL` documents
of each label, equal texts once; scoring reads all of every text.

Defined cases: null and empty texts score as texts without a match; nothing to
learn from gives the score 0.5 to all; repeated rows score alike; an empty table
gives no rows; extra columns are ignored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts
from clickloom.llm.fitting import apply_logistic, logistic
from clickloom.llm.sampling import labelled_sample

#: Documents of each label in the training sample.
PER_LABEL = 4_000
#: Least log-odds and log-likelihood ratio of a learned stem, and most stems.
LEAST_ODDS, LEAST_RATIO, MOST_STEMS = 3.5, 25.0, 4_000
#: The same for stems that good documents have too, but once where bad ones repeat them: their number in a text tells.
FAINT_ODDS, FAINT_RATIO = 1.5, 60.0
#: A stem stays if it stands in this share of bad documents with these log-odds, or explains so many that no other does.
LEAST_SUPPORT, CLEAR_ODDS, LEAST_LEFT = 0.05, 4.5, 3
#: Letters of stems learned beside whole words.
STEMS = (4, 5, 6)
#: Words over which targets, threats and negations reach.
REACH, SCOPE = 4, 3
REMEMBERED = 400_000
#: Features of a text.
WIDTH = 15

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: The closed classes (fixed values).
WORDS = {
    TARGET: "you your yours yourself u ur he she they him her them his du dich dir dein ihr euch tu toi te vous votre ton tú tu usted vosotros",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie pas jamais ne nunca ni",
    REPORT: "said says say wrote writes called calls quoted claimed told according sagte schrieb dit écrit dijo escribió",
    THREAT: "kill hurt destroy beat punch shoot stab murder töten schlagen tuer frapper matar golpear",
}
CLOSED = {w: symbol for symbol, words in WORDS.items() for w in words.split()}
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"


def component(near: int, on: int):
    """A transducer that remembers symbol `on` for `near` words (0: until the clause ends)."""

    def move(state: int, symbol: int) -> int:
        if symbol == END:
            return 0
        if symbol == on:
            return near or 1
        return max(0, state - 1) if near else state

    return move


def composed() -> tuple[list[list[int]], list[list[int]]]:
    """The product of all components: next state and output (a kind of match, or -1) by state and symbol.

    A kind is 1 for a threat, plus 2 near a target, plus 4 in a negation, plus 8 in reported speech.
    """
    parts = [component(REACH, TARGET), component(SCOPE, NEGATION), component(0, REPORT)]
    states = {(0, 0, 0): 0}
    moves, outputs = [], []
    queue = list(states)
    for state in queue:
        row, out = [], []
        for symbol in range(7):
            after = tuple(f(s, symbol) for f, s in zip(parts, state))
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            row.append(states[after])
            hit = symbol in (INSULT, THREAT)
            out.append((symbol == THREAT) + 2 * (state[0] > 0) + 4 * (state[1] > 0) + 8 * (state[2] > 0) if hit else -1)
        moves.append(row)
        outputs.append(out)
    return moves, outputs


@dataclass
class Model:
    #: Stems (a word as "=word") with their log-odds.
    stems: dict[str, float]
    weights: np.ndarray


class Lexicon(dict):
    """Raw token -> (symbol, weight, whether a clause ends), remembered up to a bound; None for plain words."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, token: str):
        word = token.strip(MARKS)
        end = token[-1] in ".!?;:"
        weight = max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)
        symbol = INSULT if weight else CLOSED.get(word, OTHER)
        out = (symbol, weight, end) if symbol or end else None
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out
        return out


def stems_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)] if len(word) > 2 else []


class Grammar:
    def __init__(self, stems: dict[str, float]):
        self.lexicon = Lexicon(stems)
        self.moves, self.outputs = composed()

    def matches(self, text: bytes | None) -> list[tuple[int, float]]:
        """(kind, weight) of every match in a text."""
        if not text:
            return []
        tokens = text.decode("utf-8", "replace").lower().split()
        get, moves, outputs = self.lexicon.__getitem__, self.moves, self.outputs
        found, state, last = [], 0, -1
        for i, read in enumerate(map(get, tokens)):
            if read is None:
                continue
            symbol, weight, end = read
            # Plain words between; every memory but reported speech is over after REACH of them.
            for _ in range(min(i - last - 1, REACH)):
                state = moves[state][OTHER]
            last = i
            out = outputs[state][symbol]
            if out >= 0:
                found.append((out, weight or 1.0))
            state = moves[state][symbol]
            if end:
                state = moves[state][END]
        return found

    def features(self, text: bytes | None) -> np.ndarray:
        """For clear insults, threats and faint insults: strongest match, number, and those near targets, negated and reported."""
        x = np.zeros(WIDTH)
        for out, weight in self.matches(text):
            at = 5 if out & 1 else 0 if weight >= LEAST_ODDS else 10
            x[at] = max(x[at], weight)
            x[at + 1] += 1
            for k in range(3):
                x[at + 2 + k] += out >> (k + 1) & 1
        return np.log1p(x)


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """A bounded sample of labelled texts (`_label` 0 or 1, `_t`), equal texts of a label once."""
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    marks = marks.where("_label in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = labelled_sample(marks, "_label", "_id", per_label)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t"))
    # At most a few times per_label ids, so the documents need not move.
    return texts.join(F.broadcast(chosen), "_id").select("_label", "_t").distinct()


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
) -> Model:
    """Fit on a bounded sample of the labelled rows given."""
    sample = sample_of(docs, labels, label_col, id_col, text_col, per_label).cache()
    totals = {r._label: r.n for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model({}, np.zeros(WIDTH + 1))

    def count(slices):
        for batch in slices:
            sums = (Counter(), Counter())
            for label, text in zip(batch.column("_label").to_pylist(), batch.column("_text").to_pylist()):
                words = {t.strip(MARKS) for t in (text or b"").decode("utf-8", "replace").lower().split()}
                sums[label].update({s for w in words for s in stems_of(w)})
            keys = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([own[k] for k in keys], pa.int64()) for own in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["stem", "good", "bad"])

    counted = over_texts(sample, "_t", ["_label"], count, "stem string, good long, bad long")
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    both = (F.col("bad") + F.col("good")) / (bad + good)
    ratio = 2 * (F.col("bad") * F.log(p / both) + F.col("good") * F.log(q / both))
    learned = (
        counted.groupBy("stem")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .withColumns({"odds": F.log(p) - F.log(q), "ratio": ratio})
        .where(
            ((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
            | ((F.col("odds") >= FAINT_ODDS) & (F.col("ratio") >= FAINT_RATIO))
        )
        .orderBy(F.desc("ratio"), "stem")
        .limit(MOST_STEMS)
        .collect()
    )
    stems = chosen_stems(sample, {r.stem: r.odds for r in learned})
    x, y = collected_features(sample, lambda: Grammar(stems).features, WIDTH)
    sample.unpersist()
    return Model(stems, logistic(x, y))


def chosen_stems(sample: DataFrame, candidates: dict[str, float]) -> dict[str, float]:
    """Candidates that explain bad documents which no better one explains.

    Near copies of a bad document make all its rare words look bad; once its
    insult is taken, nothing is left for those words to explain.
    """
    number = {s: i for i, s in enumerate(candidates)}

    def run(slices):
        for batch in slices:
            rows = []
            for text in batch.column("_text").to_pylist():
                words = {t.strip(MARKS) for t in (text or b"").decode("utf-8", "replace").lower().split()}
                rows.append(sorted({number[s] for w in words for s in stems_of(w) if s in number}))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "has"])

    got = over_texts(sample, "_t", ["_label"], run, "y int, has array<int>").toPandas()
    names, out = list(candidates), {}
    has = np.zeros((len(got), len(names)), bool)
    for i, own in enumerate(got["has"]):
        has[i, own] = True
    bad = has[got["y"].to_numpy() == 1]
    support = bad.sum(axis=0) / max(1, len(bad))
    odds = np.array(list(candidates.values()))
    # Frequent and clear stems stay, whether or not others stand beside them.
    for i in np.flatnonzero((support >= LEAST_SUPPORT) & (odds >= CLEAR_ODDS)):
        out[names[i]] = candidates[names[i]]
        bad[bad[:, i]] = False
    while names:
        left = bad.sum(axis=0) * odds * (bad.sum(axis=0) >= LEAST_LEFT)
        best = int(left.argmax())
        if left[best] <= 0:
            break
        out[names[best]] = candidates[names[best]]
        bad[bad[:, best]] = False
    return out


def collected_features(sample: DataFrame, make, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a bounded sample."""

    def run(slices):
        features = make()
        for batch in slices:
            rows = [features(t).tolist() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    got = over_texts(sample, "_t", ["_label"], run, "y int, x array<double>").toPandas()
    return np.array(got["x"].tolist()).reshape(-1, width), got["y"].to_numpy(float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, `score` and n_matches of every whole text."""
    keep = keep or [id_col]

    def run(slices):
        grammar = Grammar(model.stems)
        for batch in slices:
            x = np.array([grammar.features(t) for t in batch.column("_text").to_pylist()]).reshape(-1, WIDTH)
            scores = apply_logistic(x, model.weights)
            n = np.rint(np.expm1(x[:, [1, 6, 11]]).sum(axis=1)).astype(np.int64)
            columns = [*(batch.column(c) for c in keep), pa.array(scores), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "n_matches"])

    fields = ", ".join(f"`{c}` {kind(docs, c)}" for c in keep)
    return over_texts(docs, text_col, keep, run, f"{fields}, score double, n_matches long")
