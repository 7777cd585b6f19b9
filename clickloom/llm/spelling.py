"""Spelling variants: words one edit apart, by dynamic programming over the sorted vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  Near words of SHORTEST or more code points share their first or their
last SHARED ones, whichever the edit leaves alone, so the vocabulary is sorted
twice: as it is, and with all words reversed.  Words that share SHARED code points
lie next to each other in one of the two.

The words of one stretch are read in sorted order.  A word's edit matrix against
all words of the stretch has a row for each of its code points, and one edit away
only three cells of a row matter (the band).  The rows of the prefix a word shares
with the one before it (their LCP) are used again; words no longer within one edit
of that prefix leave the rows below it, and when none is left, all words with that
prefix are skipped.  Where a `FEW` are left, they are compared with the word read as
they are.

A long stretch is dealt over several tasks by its words' hash: each task holds
`CHUNK` of them and reads the sorted stretch past them, so memory is bounded and a
stretch that holds a third of the vocabulary is shared out.

Defined cases: null and empty texts have no runs; a null id counts as empty text
in the checksum; repeated rows count again; ties go to the smallest form in
code-point order; an empty table gives no rows; extra columns are ignored.  A very
long text only adds to the counts of its runs.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, kind, over_texts, stored

#: Code points of the shortest words; least occurrences; how much more frequent a form is.
SHORTEST, LEAST, RATIO = 7, 2, 10
#: Code points that a near pair shares at one of its ends: with one edit, 2 * SHARED < SHORTEST.
SHARED = 3
#: Words of one stretch in a task; words for which no further row is worth its while.
CHUNK, FEW = 20_000, 4
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def misspelt(prefix: int, run: str, every: int = 31) -> str:
    """The run, less one code point where its checksum says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of SHORTEST code points or more with LEAST occurrences."""

    def run(slices):
        for batch in slices:
            counts = Counter()
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                if not text:
                    continue
                own = Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace")))
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    if len(word) >= SHORTEST:
                        word = misspelt(prefix, word)
                        if len(word) >= SHORTEST:
                            counts[word] += n
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    named = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    counted = over_texts(named, "text", ["_id"], run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST)


def one_edit(a: str, b: str) -> bool:
    """Whether two words that share SHARED code points differ by exactly one edit."""
    if len(a) > len(b):
        a, b = b, a
    i = SHARED
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


class Scan:
    """The banded edit matrices of one sorted stretch against a chunk of its words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words])
        width = int(self.size.max()) + 3
        #: Code points from column 1 on; 0 stands for none.
        self.points = np.zeros((len(words), width), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(len(words)), self.size)
        self.points[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size) + 1] = flat
        #: By depth: words still within one edit, and their cells for a prefix shorter by one, equal, longer by one.
        start = np.broadcast_to(np.array([1, 0, 1], np.int8), (len(words), 3))
        self.rows = [(np.arange(len(words)), start)]
        self.before = ""

    def below(self, point: int, depth: int):
        """The next row, for the code point at `depth` of the word read."""
        own, old = self.rows[-1]
        if depth > self.points.shape[1] - 3:  # longer than all words of the chunk
            return own[:0], old[:0]
        # The prefixes have depth, depth + 1 and depth + 2 code points; 0 means that a word has no such prefix.
        here = self.points[own[:, None], depth + np.arange(3)]
        new = old + (here != point)
        np.minimum(new[:, :2], old[:, 1:] + 1, out=new[:, :2])
        for k in (1, 2):
            np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
        new[here == 0] = 2
        left = (new < 2).any(axis=1)
        return own[left], new[left]

    def near(self, word: str) -> list[int]:
        """The chunk's words exactly one edit from the next word of the stretch."""
        lcp = SHARED
        for a, b in zip(word[SHARED:], self.before[SHARED:]):
            if a != b:
                break
            lcp += 1
        self.before = word
        del self.rows[lcp - SHARED + 1 :]
        while len(self.rows) <= len(word) - SHARED and len(self.rows[-1][0]) > FEW:
            depth = SHARED + len(self.rows) - 1
            self.rows.append(self.below(ord(word[depth]), depth))
        own, cells = self.rows[-1]
        if len(self.rows) <= len(word) - SHARED:
            return [i for i in own.tolist() if one_edit(self.words[i], word)]
        turn = self.size[own] - len(word) + 1
        fits = (turn >= 0) & (turn < 3)
        own, turn, cells = own[fits], turn[fits], cells[fits]
        return own[cells[np.arange(len(own)), turn] == 1].tolist()


def scan_stretches(batches):
    """Near pairs of rows sorted by key, chunk, reading and word; a chunk's own words come before the stretch."""
    key, held, scan = None, [], None
    for batch in batches:
        out = [[], [], []]
        for backwards, stretch, chunk, reading, word, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (backwards, stretch, chunk) != key:
                key, held, scan = (backwards, stretch, chunk), [], None
            if not reading:
                held.append(word)
                continue
            if not held:
                continue
            if scan is None:
                scan = Scan(held)
            for i in scan.near(word):
                own = held[i]
                if backwards and own[-SHARED:] == word[-SHARED:]:
                    continue  # they also share their first code points, so the forward stretch has them
                for values, v in zip(out, (own[::-1], word[::-1], n) if backwards else (own, word, n)):
                    values.append(v)
        columns = [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])


def near_pairs(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, near, near_n) of all ordered pairs one edit apart among (word, n)."""
    both = words.select(F.lit(False).alias("backwards"), "word", "n").union(
        words.select(F.lit(True), F.reverse("word"), "n")
    )
    keyed = both.select("backwards", F.substring("word", 1, SHARED).alias("stretch"), "word", "n")
    chunks = keyed.groupBy("backwards", "stretch").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = keyed.join(chunks.where("chunks > 0"), ["backwards", "stretch"])
    own = dealt.select("backwards", "stretch", F.pmod(F.xxhash64("word"), "chunks").cast("int").alias("chunk"), F.lit(False).alias("reading"), "word", "n")
    read = dealt.select("backwards", "stretch", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True), "word", "n")
    keys = ["backwards", "stretch", "chunk"]
    rows = own.union(read).repartition(*keys).sortWithinPartitions(*keys, "reading", "word")
    return rows.mapInArrow(scan_stretches, f"word {kind(words, 'word')}, near string, near_n long")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's most frequent near word, if frequent enough, and the last form.

    A form occurs `ratio` times as often as its word, so the way to the root is
    short; each round doubles the part of it that is known.
    """
    words = stored(vocabulary(docs, id_col, text_col), "words")
    best = near_pairs(words, chunk).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near_n = -F.col("best.less")
    enough = near_n >= ratio * F.col("n")
    linked = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, near_n).alias("form_n"),
        ),
        "forms",
    )
    most, length = words.agg(F.max("n")).first()[0] or 0, 0
    while most >= ratio:
        most, length = most // ratio, length + 1
    paths = linked.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(length.bit_length()):
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return linked.join(paths, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
