"""Collocations by relational mining of sorted occurrence relations (SETM).

An occurrence is (document, place, word), sorted by document and place; places
count words from 0 and leave one out between pieces, so words stand side by side
in one piece exactly if their places follow each other.  The relation is kept as
one row per document with its words and the gaps between their places as two
packed values, so the JVM moves bytes and no elements, and written to the shared
folder once per phrase length.  Counts of phrases stay on the executors' disks.

One length to the next:

- merge-join: the relation meets itself at the next place, which gives the
  occurrences of phrases one word longer (documents are whole rows, so the two
  sorted sides are neighbours in one array);
- group-count: phrases are counted exactly inside a task, dealt by Spark over the
  parts of a hash table, and added up part by part.  Pairs, of which most are rare,
  are first counted by hash: two or three bytes for each place of the table go
  between tasks, and only pairs whose place was met `least` times are spelt out;
- semi-join: only occurrences of phrases with `least` occurrences stay.  A bitmap
  of bounded size stands for the frequent phrases; what it lets through by chance
  is counted like the rest and found to be rare.

All counts are exact.  A phrase is frequent only if its two parts that lack one
word are, so nothing frequent is lost on the way.

Defined cases: null and empty texts have no words; a null language is `und`; ids
and extra columns are not read, so repeated rows count again; an empty table gives
no rows; ties in the order go to the smaller phrase.  A very long text is one row
of the relation, as it is one value of the table.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, arrow_rows, over_texts, stored
from clickloom.llm.marks import Marks, marks

LEAST, LONGEST, BEST = 100, 5, 2000
#: A-Z to a-z, and `[.,;:!?\x0A-\x0D]` to one mark.
PIECES = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else LOWER[b] for b in range(256))
#: Words, and bytes of texts, handled at a time.
WORDS, TEXT_BYTES = 1 << 18, 2 << 20
#: Places of one part of the hash table, words a place should hold at most, most parts, and pairs a task holds.
PART, LOAD, PARTS, HELD = 1 << 16, 4, 1 << 13, 1 << 20
RELATION = "lang string, gaps binary, words string"
COUNTED = "lang string, phrase string, n long"


def read_words(slices):
    """Occurrences of the words of texts, some TEXT_BYTES at a time."""
    for batch in slices:
        lang = pc.fill_null(batch.column("_lang"), "und")
        start, words, ends, size = 0, [], [0], 0
        texts = batch.column("_text").to_pylist()
        for i, text in enumerate(texts):
            if text:
                words += text.translate(PIECES).replace(b".", b" . ").split()
                size += len(text)
            ends.append(len(words))
            if size >= TEXT_BYTES or i + 1 == len(texts):
                yield Occurrences(lang.slice(start, i + 1 - start), *placed(words, ends))
                start, words, ends, size = i + 1, [], [0], 0


def placed(tokens: list[bytes], ends: list[int]) -> tuple[pa.ListArray, pa.ListArray]:
    """Places and words of documents from their tokens, which hold the marks between pieces too."""
    words, ends = pa.array(tokens, pa.binary()), np.array(ends)
    at = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    keep = pc.not_equal(words, b".").to_numpy(zero_copy_only=False)
    new = pa.array(np.append(0, np.cumsum(keep))[ends].astype(np.int32))
    chosen = words.filter(pa.array(keep)).cast(pa.string())
    return pa.ListArray.from_arrays(new, pa.array(at[keep].astype(np.int32))), pa.ListArray.from_arrays(new, chosen)


class Occurrences:
    """A slice of the relation as flat arrays, sorted by document and place."""

    def __init__(self, lang: pa.Array, at: pa.ListArray, word: pa.ListArray):
        import xxhash

        self.lang, self.ends = lang, at.offsets.to_numpy().astype(np.int64) - at.offsets[0].as_py()
        self.doc = np.repeat(np.arange(len(lang)), np.diff(self.ends))
        self.at = at.flatten().to_numpy()
        self.words = word.flatten()
        coded = self.words.dictionary_encode()
        langs = lang.dictionary_encode()
        own = langs.indices.to_numpy()[self.doc].astype(np.int64) if len(self.doc) else np.zeros(0, np.int64)
        #: Words of one language and spelling have one number.
        self.id, kinds = pd.factorize(own * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
        spelt, tongues = coded.dictionary.to_pylist(), langs.dictionary.to_pylist()
        size = max(1, len(spelt))
        named = (xxhash.xxh3_64_intdigest(f"{tongues[k // size]} {spelt[k % size]}") for k in kinds.tolist())
        self.hash = np.fromiter(named, np.uint64, len(kinds))
        place = self.doc.astype(np.int64) << 32 | self.at
        #: Words that stand directly before the next one.
        self.joined = np.append(np.diff(place) == 1, False)[: len(place)]

    def frequent(self, k: int, of: Marks) -> np.ndarray:
        """Where phrases of k words start that are marked as frequent."""
        n = len(self.id)
        starts = np.ones(n, bool)
        key = self.hash[self.id]
        for j in range(1, k):
            starts[: n - j] &= self.joined[j - 1 : n - 1]
            starts[n - j :] = False
            later = np.zeros(n, np.uint64)
            later[: n - j] = self.hash[self.id[j:]]
            key = extend(key, later)
        return starts & of(key.view(np.int64))

    def places(self, starts: np.ndarray, k: int, parts: int) -> np.ndarray:
        """Places of the phrases of k words at the given starts in a hash table of some parts."""
        key = self.hash[self.id[starts]]
        for j in range(1, k):
            key = extend(key, self.hash[self.id[starts + j]])
        return (key >> np.uint64(32) & np.uint64(parts * PART - 1)).astype(np.int64)

    def extended(self, k: int, of: Marks | None) -> np.ndarray:
        """Starts of phrases of k words whose two parts of k - 1 words are frequent."""
        if k == 1:
            return np.arange(len(self.id))
        part = self.frequent(k - 1, of)
        return np.flatnonzero(part[:-1] & part[1:] & self.joined[:-1])

    def counts(self, starts: np.ndarray, k: int, parts: int = 0) -> pa.RecordBatch:
        """Phrases of k words at the given starts with their numbers of occurrences, and their parts of the hash table."""
        key = self.id[starts]
        for j in range(1, k):
            key, _ = pd.factorize(key * (len(self.hash) + 1) + self.id[starts + j])
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        one = starts[one]
        phrase = pc.binary_join_element_wise(*(self.words.take(pa.array(one + j)) for j in range(k)), " ")
        columns = [self.lang.take(pa.array(self.doc[one])), phrase, pa.array(n.astype(np.int64))]
        names = ["lang", "phrase", "n"]
        if parts:
            columns, names = [*columns, pa.array(self.places(one, k, parts) // PART)], [*names, "part"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def kept(self, keep: np.ndarray) -> pa.RecordBatch:
        """The packed relation with some of its occurrences; documents without any are left out."""
        size = np.bincount(self.doc[keep], minlength=len(self.lang))
        stay = np.flatnonzero(size)
        ends = np.append(0, np.cumsum(size[stay])).astype(np.int32)
        word = pa.ListArray.from_arrays(pa.array(ends), self.words.take(pa.array(np.flatnonzero(keep))))
        return packed(self.lang.take(pa.array(stay)), ends, self.at[keep], word)


def packed(lang: pa.Array, ends: np.ndarray, at: np.ndarray, word: pa.ListArray) -> pa.RecordBatch:
    """Rows of the relation: gaps between a document's places as 32-bit numbers, and its words with blanks between."""
    gaps = np.diff(at, prepend=0).astype("<i4")
    gaps[ends[:-1]] = at[ends[:-1]]
    blobs = pa.Array.from_buffers(pa.binary(), len(lang), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(gaps)])
    return pa.RecordBatch.from_arrays([lang, blobs, pc.binary_join(word, " ")], names=["lang", "gaps", "words"])


def unpacked(batches):
    """Rows of the relation with their places and words as parallel arrays, WORDS at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("gaps")).to_numpy() // 4
        for a, b in spans(sizes):
            lang, gaps, words = batch.slice(a, b - a).columns
            size, gap = sizes[a:b], np.frombuffer(b"".join(gaps.to_pylist()), "<i4")
            ends = np.append(0, np.cumsum(size))
            run, first = np.cumsum(gap, dtype=np.int64), ends[:-1]
            at = (run - np.repeat(run[first] - gap[first], size)).astype(np.int32)
            at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at))
            yield pa.RecordBatch.from_arrays([lang, at, pc.split_pattern(words, " ")], names=["lang", "at", "word"])


def extend(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    z = key * np.uint64(0x9E3779B97F4A7C15) + word
    z ^= z >> np.uint64(31)
    return z * np.uint64(0xD6E8FEB86659FD93)


def slices_of(batches):
    """Occurrences of batches of the relation, WORDS at a time."""
    for batch in batches:
        for a, b in spans(pc.list_value_length(batch.column("at")).to_numpy()):
            yield Occurrences(*(batch.column(c).slice(a, b - a) for c in ("lang", "at", "word")))


def spans(size: np.ndarray):
    """Runs of documents of the given numbers of words that hold WORDS words, or one document."""
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > WORDS:
            yield start, i
            start, held = i, 0
        held += n
    if held:
        yield start, len(size)


def counted_once(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept on the executors' disks.

    For small tables dealt over many tasks: files in the shared folder can cost forks of the executor, as a local file
    system sets the rights of each by a command.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def part_rows(places: np.ndarray, least: int) -> pa.RecordBatch:
    """A row for each part of the hash table that is met: its places and their numbers, which end at `least`."""
    place, n = np.unique(places, return_counts=True)
    at, n = (place % PART).astype("<u2"), np.minimum(n, least).astype(np.min_scalar_type(least))
    part, first = np.unique(place // PART, return_index=True)
    ends = np.append(first, len(place)).tolist()
    columns = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:])] for x in (at, n)]
    arrays = [pa.array(part.astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "at", "n"])


def possible_pairs(relation: DataFrame, marked, n: int, least: int) -> tuple:
    """(marks, parts): places of the hash table that pairs among n words meet `least` times, and the table's parts.

    A pair with `least` occurrences is always on such a place, and others can be.
    """
    parts, least = 1, max(1, least)
    while parts * PART * LOAD < n and parts < PARTS:
        parts *= 2

    def fill(batches):
        of, held, size = Marks(marked.value), [], 0
        for occurrences in slices_of(unpacked(batches)):
            held.append(occurrences.places(occurrences.extended(2, of), 2, parts).astype(np.int32))
            size += len(held[-1])
            if size >= HELD:
                yield part_rows(np.concatenate(held), least)
                held, size = [], 0
        if size:
            yield part_rows(np.concatenate(held), least)

    def add(batches):
        kind, part, table = np.min_scalar_type(least), None, np.zeros(PART, np.int64)

        def full():
            places = np.flatnonzero(table >= least) + part * PART
            return pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

        for batch in batches:
            for own, at, times in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n"))):
                if own != part:
                    if part is not None:
                        yield full()
                    part, table[:] = own, 0
                table[np.frombuffer(at, "<u2")] += np.frombuffer(times, kind)
        if part is not None:
            yield full()

    rows = relation.mapInArrow(fill, "part long, at binary, n binary").repartition("part").sortWithinPartitions("part")
    places = counted_once(rows.mapInArrow(add, "place long"))
    possible = marks(places, "place")
    places.unpersist()
    return possible, parts


def count_rows(counts: list[pa.RecordBatch]):
    """A row for each part of the hash table: the added counts of its phrases as one Arrow batch."""
    added = pa.Table.from_batches(counts).group_by(["part", "lang", "phrase"]).aggregate([("n", "sum")]).sort_by("part")
    part, first = np.unique(added["part"].to_numpy(), return_index=True)
    (batch,) = added.select(["lang", "phrase", "n_sum"]).combine_chunks().to_batches() or [None]
    ends = np.append(first, len(added)).tolist()
    blobs = [batch.slice(a, b - a).serialize().to_pybytes() for a, b in zip(ends, ends[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(blobs, pa.binary())], names=["part", "counts"])


def added_by_part(relation: DataFrame, counted, least: int) -> DataFrame:
    """(lang, phrase, n) of phrases with `least` occurrences; `counted` gives the counts and parts of slices.

    Counts of a part meet in one task as Arrow batches; parts hold a bounded number of words on average.
    """

    def deal(batches):
        held, size = [], 0
        for counts in counted(batches):
            if counts.num_rows:
                held.append(counts)
                size += counts.num_rows
            if size >= HELD // 2:
                yield count_rows(held)
                held, size = [], 0
        if held:
            yield count_rows(held)

    def add(batches):
        part, held, form = None, [], pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_sum", pa.int64())])

        def full():
            n = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("n_sum", "sum")])
            n = n.filter(pc.greater_equal(n["n_sum_sum"], least)).select(["lang", "phrase", "n_sum_sum"])
            return n.rename_columns(["lang", "phrase", "n"]).combine_chunks().to_batches()

        for batch in batches:
            for own, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                if own != part:
                    if held:
                        yield from full()
                    part, held = own, []
                held.append(pa.ipc.read_record_batch(counts.as_buffer(), form))
        if held:
            yield from full()

    rows = relation.mapInArrow(deal, "part long, counts binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(add, COUNTED)


def phrase_marks(frequent: DataFrame):
    """A broadcast bitmap of the hashes of phrases."""

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                words = (xxhash.xxh3_64_intdigest(f"{lang} {w}") for w in phrase.split(" "))
                words = [np.array([w], np.uint64) for w in words]
                key = words[0]
                for w in words[1:]:
                    key = extend(key, w)
                out.append(key.view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])

    return marks(frequent.select("lang", "phrase").mapInArrow(run, "h long"), "h")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases with `least` occurrences; (lang, n) of all words."""
    named = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))

    def count_words(slices):
        for occurrences in read_words(slices):
            yield occurrences.counts(occurrences.extended(1, None), 1)

    words = stored(added(over_texts(named, "text", ["_lang"], count_words, COUNTED)), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    found = [frequent.withColumn("words", F.lit(1))]
    marked = phrase_marks(frequent)

    def pairs(slices, marked=marked):
        """The first relation: frequent words beside one another."""
        of = Marks(marked.value)
        for occurrences in read_words(slices):
            keep = np.zeros(len(occurrences.id), bool)
            starts = occurrences.extended(2, of)
            keep[starts] = keep[starts + 1] = True
            yield occurrences.kept(keep)

    relation = stored(over_texts(named, "text", ["_lang"], pairs, RELATION), "occurrences", compression="zstd")
    size = totals.agg(F.sum("n")).first()[0] or 0
    possible, parts = possible_pairs(relation, marked, size, least) if longest > 1 else (None, 0)
    for k in range(2, longest + 1):

        def count(batches, k=k, marked=marked):
            of, among = Marks(marked.value), Marks(possible.value)
            for occurrences in slices_of(unpacked(batches)):
                starts = occurrences.extended(k, of)
                if k == 2:
                    starts = starts[among(occurrences.places(starts, 2, parts))]
                yield occurrences.counts(starts, k, parts)

        frequent = counted_once(added_by_part(relation, count, least))
        found.append(frequent.withColumn("words", F.lit(k)))
        if k == longest:
            break
        marked = phrase_marks(frequent)

        def semi_join(batches, k=k, marked=marked):
            of = Marks(marked.value)
            for occurrences in slices_of(unpacked(batches)):
                starts = np.flatnonzero(occurrences.frequent(k, of))
                keep = np.zeros(len(occurrences.id), bool)
                for j in range(k):
                    keep[starts + j] = True
                yield occurrences.kept(keep)

        relation = stored(relation.mapInArrow(semi_join, RELATION), "occurrences", compression="zstd")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("lang", "phrase", "words", "n"), totals


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    best: int = BEST,
) -> DataFrame:
    """Each language's `best` phrases by how much more often their parts meet than by chance.

    A phrase of a occurrences among n words, cut into parts of l and r, scores
    floor(1000 * a * n / (l * r)); its lowest-scoring cut counts (ties: the first).
    A phrase goes if a longer frequent one around it occurs as often.
    """
    with arrow_rows(docs.sparkSession):
        found, totals = frequent_phrases(docs, text_col, lang_col, least, longest)
    part = F.col("part")
    several = found.where("words > 1").withColumn("part", F.split("phrase", " "))

    def joined(first, size):
        return F.array_join(F.slice("part", first, size), " ")

    # A longer phrase that occurs as often means that one with a single word more does.
    around = found.where("words > 2").withColumn("part", F.split("phrase", " "))
    inner = F.array(joined(F.lit(1), F.size(part) - 1), joined(F.lit(2), F.size(part) - 1))
    inside = around.select("lang", F.explode(inner).alias("phrase"), "n").distinct()
    alone = several.join(inside, ["lang", "phrase", "n"], "left_anti")

    cuts = alone.select(
        "lang", "phrase", F.col("n").alias("a"), "part", F.explode(F.sequence(F.lit(1), F.size(part) - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut",
        joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.size(part) - F.col("cut")).alias("rest"),
    )
    sides = (
        cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )
    a, l, r, n = (F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n"))
    sides = sides.withColumn("up", (F.lit(1000).cast("decimal(38,0)") * a * n).cast("decimal(38,0)")).withColumn(
        "down", (l * r).cast("decimal(38,0)")
    )
    scored = sides.withColumn("score", F.expr("up div down"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        lowest.select("lang", "phrase", "m.*")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= best)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
