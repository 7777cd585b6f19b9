"""Best-fit packing of token sequences by exact complements.

Lengths are whole numbers up to the capacity, so the packing is planned on the
histogram of lengths: at most `capacity` counts reach the driver, however many
documents there are.  Planning indexes the lengths at hand; for the largest
length left it looks up a single length, a pair or a triple whose sum is exactly
the gap, and consumes as many copies of that combination as the counts allow.
What has no exact complement goes by best fit.  Each step uses up a length, so
there are at most a few thousand patterns; documents are then dealt to patterns
by their rank among documents of equal length.

Defined cases: a null or empty text is the end token alone; an added token of the
tokenizer's file that stands in a text becomes its own id; runs of whitespace may have
any length; repeated rows are packed once each; an empty table gives no rows; extra columns are ignored.
"""

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts, stored

#: Distinct words whose ids a task remembers.
REMEMBERED = 400_000

#: The pre-token pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The characters that \s means in PATTERN, and the run of them from which a text is cut before tiktoken's regex sees it:
#: that regex keeps a state for each character of a run and fails at about a million.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE_RUN = 10_000
SPACE_RUN = re.compile(f"[{SPACES}]*+")


def load_bpe(path: str):
    """The byte-level BPE of a tokenizers JSON file; ids equal those of `tokenizers`."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in blanks or stand as whole words only are not supported")
    # Byte-level vocabularies write a byte as a printable character: itself, or the next one from U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


class WordIds(dict):
    """Packed little-endian 32-bit ids of a blank-led word, remembered up to a bound."""

    def __init__(self, encoding):
        super().__init__()
        self.short, self.whole = encoding.encode_ordinary, encoding._encode_single_piece
        #: Added tokens with their packed ids, and the pattern that cuts a text at them, the longest first.
        self.added = {t: np.array([encoding.encode_single_token(t)], "<u4").tobytes() for t in encoding.special_tokens_set}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> list[int]:
        """Ids of a text; what PATTERN takes of a long whitespace run (all but the last character before others) goes past it."""
        out, at = [], 0
        for start, stop in long_runs(text):
            stop -= stop < len(text)
            out += self.short(text[at:start])
            out += self.whole(text[start:stop])
            at = stop
        return out + self.short(text[at:])

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encode(word), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def long_runs(text: str):
    """(start, stop) of whitespace runs of SAFE_RUN characters or more; each holds a place that SAFE_RUN divides."""
    stop = 0
    if len(text) < SAFE_RUN:
        return
    for i in range(0, len(text), SAFE_RUN):
        if i >= stop and text[i] in SPACES:
            low = max(stop, i - SAFE_RUN)
            start, stop = low + len(text[low:i].rstrip(SPACES)), SPACE_RUN.match(text, i).end()
            if stop - start >= SAFE_RUN:
                yield start, stop


def text_ids(text: str, words: WordIds) -> bytes:
    """Ids of a text and of the added tokens in it, as `tokenizers` gives them by default."""
    if not any(map(text.__contains__, words.added)):
        return packed_ids(text, words)
    return b"".join(words.added[p] if i % 2 else packed_ids(p, words) for i, p in enumerate(words.cut.split(text)))


def packed_ids(text: str, words: WordIds) -> bytes:
    """Ids of a text, added tokens read as plain characters.  Pre-tokens never cross a single blank before a non-blank, so such words stand alone."""
    parts = text.split(" ")
    if len(parts) > 2 and all(p and not p[0].isspace() for p in parts[1:]):
        get = words.__getitem__
        return get(parts[0]) + b"".join(map(get, [" " + p for p in parts[1:]]))
    return np.array(words.encode(text), "<u4").tobytes()


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `capacity` tokens: a longer document's first piece takes the remainder.

    `chunk` is the task that made a piece and `nth` its index among that task's
    pieces of equal length.  `ids` (little-endian 32-bit) come if `keep_ids`.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", "chunk", "nth"] + ["ids"] * keep_ids

    def run(slices):
        import zlib

        from pyspark import TaskContext

        words = WordIds(load_bpe(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        chunk = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices:
            which, piece, starts, lengths, crcs, nths, ids = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                data = (text_ids(text.decode("utf-8", "replace"), words) if text else b"") + end
                n = len(data) // 4
                cut = n % capacity or capacity
                edges = [0, *range(cut, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = data[4 * a : 4 * b]
                    which.append(row)
                    piece.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(own))
                    nths.append(seen[b - a])
                    seen[b - a] += 1
                    if keep_ids:
                        ids.append(own)
            columns = [
                batch.column(id_col).take(pa.array(which, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(crcs, pa.int64()),
                pa.array([chunk] * len(which), pa.int64()),
                pa.array(nths, pa.int64()),
            ] + [pa.array(ids, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        f"`{id_col}` {kind(docs, id_col)}, piece int, start long, length long, ids_crc32 long, chunk long, nth long"
        + ", ids binary" * keep_ids
    )
    return over_texts(docs, text_col, [id_col], run, schema)


def exact_combination(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """A length, pair or triple at hand whose sum is `gap`, larger lengths first; counts are respected."""
    if gap < len(have) and have[gap] > 0:
        return (gap,)
    ok = have > 0

    def pair(total: int, most: int) -> tuple[int, int] | None:
        low, high = (total + 1) // 2, min(total - 1, most)
        if high < low:
            return None
        x = np.arange(high, low - 1, -1)
        for i in np.flatnonzero(ok[x] & ok[total - x]):
            a, b = int(x[i]), int(total - x[i])
            if a != b or have[a] > 1:
                return a, b
        return None

    if found := pair(gap, len(have) - 1):
        return found
    for x in np.flatnonzero(ok[: max(gap - 1, 0)])[::-1]:
        x = int(x)
        if 3 * x < gap:
            break
        have[x] -= 1
        ok[x] = have[x] > 0
        found = pair(gap - x, x)
        have[x] += 1
        ok[x] = True
        if found:
            return (x, *found)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces counted."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    patterns = []

    def consume(lengths: tuple[int, ...]) -> None:
        used = np.bincount(lengths, minlength=capacity + 1)
        at = np.flatnonzero(used)
        times = int((have[at] // used[at]).min())
        have[at] -= used[at] * times
        patterns.append((lengths, times))

    if have[capacity]:
        consume((capacity,))
    for largest in range(capacity - 1, 0, -1):
        while have[largest] > 0:
            have[largest] -= 1
            found = exact_combination(have, capacity - largest)
            have[largest] += 1
            if not found:
                break
            consume((largest, *found))
    for largest in range(capacity - 1, 0, -1):
        while have[largest] > 0:
            left, gap, own = have.copy(), capacity, []
            best = largest
            while best:
                own.append(best)
                left[best] -= 1
                gap -= best
                fits = np.flatnonzero(left[: gap + 1] > 0)
                best = int(fits[-1]) if len(fits) else 0
            consume(tuple(own))
    return patterns


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces with the sequence they go to and their offset there."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counted = pieces.groupBy("chunk", "length").agg(F.count("*").alias("_n"))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    # For each length, ranges of ranks: the first rank, its sequence, and the offset in it.
    first, sequence, offset = [], [], []
    used = dict.fromkeys(totals, 0)
    base = 0
    for lengths, times in plan(totals, capacity):
        place = 0
        for length in lengths:
            first.append((length << 44) + used[length])
            sequence.append(base)
            offset.append(place)
            used[length] += times
            place += length
        base += times
    order = np.argsort(np.array(first, np.int64), kind="stable")
    first, sequence, offset = (np.array(x, np.int64)[order] for x in (first, sequence, offset))

    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("chunk", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["chunk", "length"]).select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("chunk", "nth")],
        (F.col("_before") + F.col("nth")).alias("_rank"),
    )
    names = [f"`{c}`" for c in ranked.columns if c != "_rank"]

    # Only lengths and ranks go to Python, not the token ids.
    @F.arrow_udf("sequence_id long, offset long")
    def deal(length: pa.Array, rank: pa.Array) -> pa.Array:
        key = (np.asarray(length) << 44) + np.asarray(rank)
        at = np.searchsorted(first, key, "right") - 1
        columns = [pa.array(sequence[at] + key - first[at]), pa.array(offset[at])]
        return pa.StructArray.from_arrays(columns, names=["sequence_id", "offset"])

    return ranked.withColumn("_place", deal("length", "_rank")).select(*names, "_place.sequence_id", "_place.offset")
