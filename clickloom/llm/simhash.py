"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

Fingerprints of 64 bits link at `MOST` = 4 or fewer differing bits.  A
fingerprint is cut into segments a and b of 23 bits and c of 18.  The perfect
binary Golay code puts every 23-bit word within three bits of exactly one of
4096 codewords, so decoding a segment and its 23 one-bit neighbours gives at most
six codeword numbers, and segments that differ in two bits or fewer share one:
some word is within one bit of both.  By pigeonhole, of at most four errors

- none in c: a or b has at most two          -> c, and codewords of a or of b
- some in c, none in a: b has at most two     -> a, and codewords of b
  or three in b and one in c                  -> a, and an exact half of c
- the same with a and b exchanged
- some in each, one in c: a and b have at most two
                                              -> codewords of a and b, and an exact half of c
- one in a, one in b, two in c                -> exact halves of a and b, and an exact third of c

so linked fingerprints share at least one of some 95 keys of 29 bits or more.
Distances are verified.

Hot buckets: equal fingerprints are merged before.  Each bucket first links its
members to its smallest one, and the components of those links are found: once
for the few keys that hold a whole segment, then for the others, where buckets of
one component are left out.  Only buckets that still hold several components
compare members of different components, so a dense group of near copies is never
expanded into pairs.

Defined cases: null and empty texts have fingerprint zero; fewer words than a
shingle are one shingle; repeated rows share a component; a null id never names a
component unless all its ids are null; an empty table gives no rows; extra
columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import BITS, LOWER, bitmap, kind, over_texts, stored
from clickloom.llm.graph import components

MOST = 4
#: The generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1 (a fixed value).
GENERATOR = 0b110001110101


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of XXH64-hashed word shingles; a bit is set if over half of them set it."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops[size - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    array = np.array(hashes, "<u8")
    for at in range(0, len(array), 4096):
        part = array[at : at + 4096]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(array), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The kept columns (the id) and `fp`, the fingerprint as a signed long."""
    keep = keep or [id_col]

    def run(slices):
        for batch in slices:
            fps = np.array([fingerprint(t, size) for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return over_texts(docs, text_col, keep, run, ", ".join(f"`{c}` {kind(docs, c)}" for c in keep) + ", fp long")


class Golay:
    """Decoding of 23-bit words by their syndromes."""

    def __init__(self):
        top = np.zeros(1 << 12, np.int64)  # remainders of the upper twelve bits
        for value in range(1 << 12):
            rest = value << 11
            for bit in range(22, 10, -1):
                if rest >> bit & 1:
                    rest ^= GENERATOR << (bit - 11)
            top[value] = rest
        self.top = top
        self.error = np.zeros(1 << 11, np.int64)
        ones = [0, *(1 << i for i in range(23))]
        for x in ones:
            for y in ones:
                for z in ones:
                    e = x | y | z
                    self.error[top[e >> 11] ^ (e & 0x7FF)] = e
        self.flips = np.array(ones, np.int64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The codeword number (its upper twelve bits) of each word."""
        return (words ^ self.error[self.top[words >> 11] ^ (words & 0x7FF)]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """Six columns: numbers of the codewords of a word and of its one-bit neighbours, padded with -1."""
        all_ = np.sort(self.numbers(words[:, None] ^ self.flips), axis=1)
        new = np.concatenate((np.ones((len(words), 1), bool), all_[:, 1:] != all_[:, :-1]), axis=1)
        out = np.full((len(words), 6), -1, np.int64)
        rows, cols = np.nonzero(new)
        place = (np.cumsum(new, axis=1) - 1)[rows, cols]
        out[rows, place] = all_[rows, cols]
        return out


def fuzzy_keys(fps: np.ndarray, golay: Golay, long: bool, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the fingerprints' keys: the some 26 with a whole segment (long), the rest (wide)."""
    bits = fps.view(np.uint64)
    a = (bits & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = (bits >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (bits >> np.uint64(46)).astype(np.int64)
    near_a, near_b = golay.near(a), golay.near(b)
    rows, keys = [], []

    def add(family: int, exact: np.ndarray, *near: np.ndarray) -> None:
        """Keys of a family: exact bits and one codeword number of each segment of `near`."""
        value, ok = exact[:, None], np.ones((len(exact), 1), bool)
        for n in near:
            value = ((value[:, :, None] << 12) | n[:, None, :]).reshape(len(exact), -1)
            ok = (ok[:, :, None] & (n >= 0)[:, None, :]).reshape(len(exact), -1)
        at, which = np.nonzero(ok)
        rows.append(at)
        keys.append((family << 56) | value[at, which])

    if long:
        add(1, c, near_a)
        add(2, c, near_b)
        add(3, a, near_b)
        add(4, b, near_a)
        for k in range(2):
            half = c >> 9 * k & 0x1FF
            add(5 + k, a << 9 | half)
            add(7 + k, b << 9 | half)
    if wide:
        for k in range(2):
            add(9 + k, c >> 9 * k & 0x1FF, near_a, near_b)
        for i in range(12):
            # One error in a, one in b, two in c: halves of a and b and a third of c are exact.
            left, right = a >> 12 * (i % 2) & 0xFFF, b >> 12 * (i // 2 % 2) & 0xFFF
            add(11 + i, (left << 12 | right) << 6 | c >> 6 * (i // 4) & 0x3F)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(labels: DataFrame, long: bool, wide: bool, wanted: DataFrame | None = None) -> DataFrame:
    """(key, fp, root) for the keys of distinct fingerprints; most of those outside `wanted` (key) are left out."""
    bits = None
    if wanted is not None:
        spot = F.col("key").bitwiseXOR(F.shiftright("key", 23)).bitwiseXOR(F.shiftright("key", 40)).bitwiseAND(F.lit(BITS - 1))
        bits = labels.sparkSession.sparkContext.broadcast(bitmap(wanted.select(spot.alias("h"))))

    def run(batches):
        golay = Golay()
        words = None if bits is None else np.frombuffer(bits.value, np.int64)
        for batch in batches:
            values, roots = np.asarray(batch.column("fp")), np.asarray(batch.column("root"))
            for at in range(0, len(values), 2000):
                part, own = np.ascontiguousarray(values[at : at + 2000]), roots[at : at + 2000]
                rows, keys = fuzzy_keys(part, golay, long, wide)
                if words is not None:
                    h = (keys ^ keys >> 23 ^ keys >> 40) & (BITS - 1)
                    here = words[h >> 6] >> (h & 63) & 1 == 1
                    rows, keys = rows[here], keys[here]
                columns = [pa.array(keys), pa.array(part[rows]), pa.array(own[rows])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "root"])

    # One row becomes a hundred: spread the few before, over as many tasks as a shuffle has.
    spread = labels.select("fp", "root").repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return spread.mapInArrow(run, "key long, fp long, root long")


def near(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MOST


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """(key, first) of buckets that hold several components, with their smallest fingerprint."""
    parts = rows.groupBy("key").agg(F.min("fp").alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    return parts.where("low <> high").select("key", "first")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (a, b) between roots."""
    to = components(links).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return stored(labels.join(to, "root", "left").select("fp", F.coalesce("_to", "root").alias("root")), "labels")


def linked(fps: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints `fp`; fingerprints of a component have the same root."""
    labels = stored(fps.select("fp", F.col("fp").alias("root")), "labels")
    held = []
    for long, wide in ((True, False), (False, True)):
        mixed = stored(mixed_buckets(keyed(labels, long, wide)), "buckets")
        members = stored(keyed(labels, long, wide, mixed).join(mixed, "key"), "members")
        held.append(members.select("key", "fp"))
        stars = members.where(near("fp", "first")).join(labels.select(F.col("fp").alias("first"), F.col("root").alias("to")), "first")
        labels = relabelled(labels, stars.select(F.col("root").alias("a"), F.col("to").alias("b")))

    # Where a bucket is still mixed, members of different components are compared.
    members = held[0].union(held[1]).join(labels, "fp")
    members = stored(members.join(mixed_buckets(members).select("key"), "key"), "mixed")
    left = members.select("key", F.col("fp").alias("x"), F.col("root").alias("a"))
    right = members.select("key", F.col("fp").alias("y"), F.col("root").alias("b"))
    more = left.join(right, "key").where((F.col("a") < F.col("b")) & near("x", "y")).select("a", "b").distinct()
    return relabelled(labels, more)


def near_duplicates(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, `fp` and `component_id`, the smallest id reachable over links."""
    marks = stored(fingerprints(docs, size, id_col, text_col), "fingerprints")
    lowest = marks.groupBy("fp").agg(F.min(id_col).alias("_low"))
    roots = stored(lowest.join(linked(lowest.select("fp")), "fp"), "roots")
    names = roots.groupBy("root").agg(F.min("_low").alias("component_id"))
    return marks.join(roots.join(names, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def fingerprint_text(fp: str = "fp") -> F.Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
