"""Removal of long repeated passages by bucket-pointer refinement over Spark.

A byte goes if a string of `length` bytes that covers it also starts elsewhere.

Candidates.  Windows of `length` bytes are led by the smallest hashed q-gram among
their first `spread_of(length)` positions; windows with the same leader form a
range.  Equal windows have equal leaders at equal offsets, so they meet in the
bucket of the string that all windows of a range share.  A first pass counts these
buckets; ranges alone in theirs have no window that repeats and go no further (a
bitmap of bounded size tells them apart; a full one only costs time).

Refinement inside a slice.  Positions start in buckets of equal 8-byte strings;
a bucket's pointer is the place where it starts in sorted order.  A bucket is
refined by sorting its positions on the pointers at the offset behind the bytes
it already covers; the updated pointers serve all refinements of the next round,
so that the depth doubles (8, 16, 32, ...), and positions alone in their bucket
are settled.  The pointers at the two ends of a range tell exactly which ranges of
the slice have the same bytes.

Refinement across slices.  Pointers mean nothing in another slice, so one range of
each kind goes on under a 128-bit BLAKE2b digest of its bytes:

- the same digest twice: all windows repeat;
- else other ranges in the bucket of the leader: refined once more, by sorting on
  the digests of the single windows;
- else no window repeats.

Equal ranges and windows are merged inside each slice before a shuffle, so no key
has more rows than there are slices, however often a passage occurs; whether a
bucket holds several kinds of ranges is a map-side combined count.  Texts meet
their results by a digest; texts without repeats take no part in that join.

Defined cases: null and empty texts have no bytes; repeated rows repeat each
other's text like any other copy; an empty table gives no rows; extra columns
are ignored or, with `keep`, carried along.  Nothing depends on the order of rows,
so there are no ties to break.  A very long text is scanned in blocks and refined
in pieces of `PIECE` bytes; its maximal runs are one array, as the text is one value.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts, slices, stored
from clickloom.llm.marks import Marks, marks

#: Bytes of a repeat; bytes at a leader that tell whether shorter passages are shared.
LENGTH, BRIEF = 400, 100
#: Bytes of an initial bucket.
Q = 8
#: Windows handled at a time; bytes of a text that travel together.
BLOCK, PIECE = 1 << 19, 1 << 20
PLACE = np.uint64((1 << 24) - 1)


def spread_of(length: int) -> int:
    """Windows that may share a leader; ranges have fewer than 128 of them."""
    return min(112, length // 3)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two 8-byte words; it only chooses leaders, so it may collide."""
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z += y * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, from minima ahead and behind within blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(texts: list[bytes], length: int, block: int):
    """(bytes, pieces) with about `block` windows; a piece is (text, offset in it, place in the bytes, windows)."""
    parts, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, block):
            n = min(block, len(text) - length + 1 - at)
            parts.append(text[at : at + n + length - 1])
            pieces.append((i, at, size, n))
            size += n + length - 1
            if size >= block:
                yield np.frombuffer(b"".join(parts), np.uint8), pieces
                parts, pieces, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), pieces


def ranges(texts: list[bytes], length: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Ranges of windows with the same leader: text, first and last window, leader's place."""
    spread = spread_of(length)
    out = {k: [] for k in ("text", "first", "last", "lead")}
    for data, pieces in blocks(texts, length, block):
        words = words_at(data)
        hashed = mix(words[:-8], words[8:])
        ordered = (hashed & ~PLACE) | np.arange(len(hashed), dtype=np.uint64)
        leader = (window_minima(ordered, spread) & PLACE).astype(np.int64)
        at = np.concatenate([np.arange(p, p + n) for _, _, p, n in pieces])
        lead = leader[at]
        cut = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1))))
        first, last, lead = at[cut], at[np.append(cut[1:], len(at)) - 1], lead[cut]
        text, offset, place, _ = np.array(pieces, np.int64).T
        own = np.searchsorted(place, first, "right") - 1
        move = offset[own] - place[own]
        for k, v in zip(out, (text[own], first + move, last + move, lead + move)):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def buckets(texts: list[bytes], r: dict[str, np.ndarray], size: int) -> np.ndarray:
    """Hashes of the `size` bytes at the leaders; they only choose candidates."""
    import xxhash

    named = (xxhash.xxh3_64_intdigest(texts[i][a : a + size]) for i, a in zip(r["text"].tolist(), r["lead"].tolist()))
    return np.fromiter(named, np.uint64, len(r["lead"])).view(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays, with the end appended."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def pointers(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of all positions: equal if and only if the `depth` bytes there are equal.

    `depth` is Q times a power of two.  Positions whose bytes end sooner have a pointer of some bucket.
    """
    word = words_at(data)
    active = np.argsort(word)
    starts = runs(word[active])
    pointer = np.empty(len(word), np.int64)
    pointer[active] = np.repeat(starts[:-1], np.diff(starts))
    covered = Q
    while covered < depth:
        size = np.diff(starts)
        active = active[np.repeat(size > 1, size)]
        active = active[active + covered < len(pointer)]
        key = pointer[active] << 32 | pointer[active + covered]
        order = np.argsort(key)
        active, key = active[order], key[order]
        bucket = key >> 32
        starts = runs(key)
        # A part of a bucket points to its own start; the bucket's first part keeps the old pointer.
        by_bucket = runs(bucket)
        base = np.repeat(by_bucket[:-1], np.diff(by_bucket))[starts[:-1]]
        pointer[active] = np.repeat(bucket[starts[:-1]] + starts[:-1] - base, np.diff(starts))
        covered *= 2
    return pointer


def equal_ranges(texts: list[bytes], r: dict[str, np.ndarray], length: int, block: int = BLOCK) -> np.ndarray:
    """For each range the index of one with the same bytes; ranges of different blocks are not compared."""
    depth = Q
    while 2 * depth <= length:
        depth *= 2
    n = len(r["text"])
    same = np.arange(n)
    start = 0
    while start < n:
        parts, place, size, i = [], [], 0, start
        stop, text = 0, -1  # the bytes taken so far of the present text
        while i < n and size < block:
            own, first, end = r["text"][i], r["first"][i], r["last"][i] + length
            if own != text or first > stop:
                parts.append(texts[own][first:end])
                place.append(size)
                size += end - first
            else:
                place.append(size - (stop - first))
                parts.append(texts[own][stop:end])
                size += end - stop
            text, stop, i = own, end, i + 1
        pointer = pointers(np.frombuffer(b"".join(parts) + b"\0" * Q, np.uint8), depth)
        at = np.array(place)
        wide = (r["last"] - r["first"])[start:i] + length
        keys = [pointer[at + np.minimum(k, wide - depth)] for k in range(0, length + 128, depth)] + [wide]
        order = np.lexsort(keys)
        starts = runs(*(k[order] for k in keys))
        same[start + order] = start + np.repeat(order[starts[:-1]], np.diff(starts))
        start = i
    return same


def merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [first, stop) as maximal runs."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > stop[:-1]
    at = np.flatnonzero(new)
    return first[at], stop[np.append(at[1:], len(first)) - 1]


def digest(text: bytes) -> bytes:
    """A text's identity: 128 bits that nobody can aim at."""
    return hashlib.blake2b(text, digest_size=16).digest()


def identifiers(strings) -> np.ndarray:
    """The digests of byte strings as two columns of numbers."""
    return np.frombuffer(b"".join(digest(s) for s in strings), "<i8").reshape(-1, 2)


def whole_runs(batches, key: str):
    """Record batches of sorted rows as tables, cut only where `key` changes."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        column = table.column(key).to_numpy()
        if not len(column) or column[0] == column[-1]:
            held = table
            continue
        cut = int(np.searchsorted(column, column[-1]))
        yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def text_key(col: str = "t"):
    """The leading 8 bytes of a digest as a number, as Marks.has() reads them."""
    high = F.conv(F.hex(F.substring(col, 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(col, 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def long_texts(batch, length: int) -> list[bytes]:
    """The texts of a batch that have a window."""
    return [t for t in batch.column("_text").to_pylist() if t is not None and len(t) >= length]


def repeated_buckets(docs: DataFrame, text_col: str, length: int, sizes: list[int]) -> DataFrame:
    """(size, bucket): of the strings of the given sizes at leaders, the buckets with several ranges."""

    def run(slices):
        for batch in slices:
            texts = long_texts(batch, length)
            r = ranges(texts, length)
            for size in sizes:
                found, count = np.unique(buckets(texts, r, size), return_counts=True)
                columns = [pa.array(np.full(len(found), size, np.int32)), pa.array(found), pa.array(np.minimum(count, 2).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["size", "bucket", "n"])

    counted = over_texts(docs, text_col, [], run, "size int, bucket long, n int").groupBy("size", "bucket").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("size", "bucket")


RANGE = "bucket long, whole long, check long, t binary, first long, last long, n int"


def range_rows(docs: DataFrame, text_col: str, length: int, wanted) -> DataFrame:
    """A row per distinct range of the wanted buckets and slice; n = 0 marks bytes [first, last) that repeat within it."""
    names = [part.split()[0] for part in RANGE.split(", ")]

    def run(slices):
        of = Marks(wanted.value)
        for batch in slices:
            texts = long_texts(batch, length)
            r = ranges(texts, length)
            # Every window of a range holds the bytes behind its leader up to this size.
            r["bucket"] = buckets(texts, r, length - spread_of(length))
            keep = of(r["bucket"])
            r = {k: v[keep] for k, v in r.items()}
            if not len(r["text"]):
                continue
            same = equal_ranges(texts, r, length)
            rep, which, count = np.unique(same, return_inverse=True, return_counts=True)
            spots = zip(*(r[k][rep].tolist() for k in ("text", "first", "last")))
            name = identifiers(texts[i][a : b + length] for i, a, b in spots)
            # Equal ranges of different blocks meet by their digests.
            order = np.lexsort((name[:, 1], name[:, 0]))
            starts = runs(name[order, 0], name[order, 1])
            total = np.add.reduceat(count[order], starts[:-1])
            again = np.empty(len(rep), bool)
            again[order] = np.repeat(total > 1, np.diff(starts))
            again = again[which]
            one = order[starts[:-1]]
            ids = pa.array([digest(t) for t in texts], pa.binary())
            at = rep[one]
            columns = [pa.array(r["bucket"][at]), pa.array(name[one, 0]), pa.array(name[one, 1]), ids.take(pa.array(r["text"][at]))]
            columns += [pa.array(r["first"][at]), pa.array(r["last"][at]), pa.array(np.minimum(total, 2).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            # What repeats here is settled; the runs of each text go on as they are.
            text, first, stop = (x[again] for x in (r["text"], r["first"], r["last"] + length))
            step = int(stop.max(initial=0)) + 1
            first, stop = merged(first + text * step, stop + text * step)
            text = first // step
            key = name[np.zeros(len(text), np.int64), 0] + np.arange(len(text))  # any, to spread the rows
            columns = [pa.array(key)] * 3 + [ids.take(pa.array(text)), pa.array(first % step), pa.array(stop % step)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(text), np.int32))], names=names)

    return over_texts(docs, text_col, [], run, RANGE)


def settle_ranges(length: int):
    """Of rows sorted by bucket and digest: n = 0 for repeated bytes, and one row for each range with its n."""

    def run(batches):
        for part in whole_runs(batches, "whole"):
            n = part.column("n").to_numpy()
            yield from part.filter(pa.array(n == 0)).to_batches()
            part = part.filter(pa.array(n > 0))
            if not part.num_rows:
                continue
            n = part.column("n").to_numpy()
            starts = runs(*(part.column(c).to_numpy() for c in ("whole", "check")))
            total = np.add.reduceat(n, starts[:-1])
            # Rows with n = 2 were settled inside their slice.
            found = part.filter(pa.array(np.repeat(total > 1, np.diff(starts)) & (n == 1)))
            found = found.set_column(5, "last", pa.array(found.column("last").to_numpy() + length))
            found = found.set_column(6, "n", pa.array(np.zeros(found.num_rows, np.int32)))
            left = part.take(pa.array(starts[:-1]))
            left = left.set_column(6, "n", pa.array(np.minimum(total, 2).astype(np.int32)))
            for out in (found, left):
                yield from out.to_batches()

    return run


def text_pieces(docs: DataFrame, text_col: str, length: int, wanted) -> DataFrame:
    """(t, piece, _text): the wanted texts, once a slice, in pieces that hold the ranges that start in them."""

    def run(slices):
        of = Marks(wanted.value)
        for batch in slices:
            texts = {digest(t): t for t in batch.column("_text").to_pylist() if t is not None and len(t) >= length}
            for key, text in texts.items():
                if of.has(key):
                    at = range(0, len(text), PIECE)
                    rows = [[key] * len(at), [k // PIECE for k in at], [text[k : k + PIECE + length + 128] for k in at]]
                    columns = [pa.array(v, f) for v, f in zip(rows, (pa.binary(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "piece", "_text"])

    return over_texts(docs, text_col, [], run, "t binary, piece long, _text binary")


WINDOW = "window long, check long, ref long, weight int"


def window_rows(joined: DataFrame, length: int) -> DataFrame:
    """A row per window of the ranges to refine: (digest in two halves, ref, weight).

    ref = range id << 8 | window in the range, or -1 where the range is settled;
    weight 2 stands for several, weight 0 for a window found to repeat here.
    """
    names = ["window", "check", "ref", "weight"]

    def table_of(parts):
        name, ref, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((name[:, 1], name[:, 0]))
        name, ref, weight = name[order], ref[order], weight[order]
        starts = runs(name[:, 0], name[:, 1])
        rep, count = starts[:-1], np.diff(starts)
        total = np.minimum(np.add.reduceat(weight, rep), 2).astype(np.int32)
        own = np.where(count > 1, -1, ref[rep])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name[rep, 0], name[rep, 1], own, total)], names=names)
        again = np.repeat(count > 1, count) & (ref >= 0)
        columns = (name[again, 0], name[again, 1], ref[again], np.zeros(int(again.sum()), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    def run(batches):
        for batch in slices(batches):
            parts, held = [], 0
            rows = zip(batch.column("_text").to_pylist(), batch.column("piece").to_pylist(), batch.column("todo").to_pylist())
            for text, piece, items in rows:
                for w in items:
                    first, k = w["first"] - piece * PIECE, w["last"] - w["first"] + 1
                    name = identifiers(text[a : a + length] for a in range(first, first + k))
                    ref = (w["id"] << 8) + np.arange(k) if w["n"] == 1 else np.full(k, -1, np.int64)
                    parts.append((name, ref, np.full(k, w["n"], np.int32)))
                    held += k
                    if held >= BLOCK:
                        yield from table_of(parts)
                        parts, held = [], 0
            if parts:
                yield from table_of(parts)

    return joined.mapInArrow(run, WINDOW)


def settle_windows(batches):
    """Of rows sorted by digest: the refs of windows that repeat."""
    for part in whole_runs(batches, "window"):
        window, check, ref, weight = (part.column(c).to_numpy() for c in ("window", "check", "ref", "weight"))
        out = [ref[weight == 0]]
        live = weight > 0
        window, check, ref, weight = (x[live] for x in (window, check, ref, weight))
        if len(ref):
            starts = runs(window, check)
            total = np.repeat(np.add.reduceat(weight, starts[:-1]), np.diff(starts))
            out.append(ref[(total > 1) & (ref >= 0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["ref"])


SPANS = "array<struct<first: bigint, stop: bigint>>"
SPANS_KIND = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def maximal(batches):
    """Texts with their spans merged to maximal runs."""
    for batch in batches:
        spans = batch.column("spans")
        size = pc.list_value_length(spans).to_numpy()
        flat = spans.flatten()
        first, stop = (flat.field(c).to_numpy() for c in ("first", "stop"))
        text, step = np.repeat(np.arange(len(size)), size), int(stop.max(initial=0)) + 1
        first, stop = merged(first + text * step, stop + text * step)
        ends = np.searchsorted(first, np.arange(len(size) + 1) * step).astype(np.int32)
        runs_ = pa.StructArray.from_arrays([pa.array(first % step), pa.array(stop % step)], names=["first", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.ListArray.from_arrays(pa.array(ends), runs_)], names=["t", "spans"])


SHARED = "whole long, check long, t binary, lead long, n int"


def shared_places(docs: DataFrame, text_col: str, length: int, brief: int, wanted) -> DataFrame:
    """(t, n_shared): for texts with a leader whose `brief` bytes stand elsewhere too, the number of such leaders."""
    names = [part.split()[0] for part in SHARED.split(", ")]

    def run(slices):
        of = Marks(wanted.value)
        for batch in slices:
            texts = long_texts(batch, length)
            r = ranges(texts, length)
            _, once = np.unique(r["text"] << 40 | r["lead"], return_index=True)  # a leader may have a range in two blocks
            r = {k: v[once] for k, v in r.items()}
            keep = of(buckets(texts, r, brief))
            text, lead = r["text"][keep], r["lead"][keep]
            if not len(text):
                continue
            name = identifiers(texts[i][a : a + brief] for i, a in zip(text.tolist(), lead.tolist()))
            order = np.lexsort((name[:, 1], name[:, 0]))
            starts = runs(name[order, 0], name[order, 1])
            count = np.diff(starts)
            n = np.empty(len(order), np.int32)
            n[order] = np.repeat(np.where(count > 1, 0, 1), count)
            ids = pa.array([digest(t) for t in texts], pa.binary())
            columns = [pa.array(name[:, 0]), pa.array(name[:, 1]), ids.take(pa.array(text)), pa.array(lead), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            # What stands here more than once is settled; one row stands for it in other slices.
            one = order[starts[:-1][count > 1]]
            columns = [pa.array(name[one, 0]), pa.array(name[one, 1]), pa.nulls(len(one), pa.binary()), pa.array(lead[one])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(one), 2, np.int32))], names=names)

    def settle(batches):
        for part in whole_runs(batches, "whole"):
            n = part.column("n").to_numpy()
            starts = runs(*(part.column(c).to_numpy() for c in ("whole", "check")))
            total = np.repeat(np.add.reduceat(n, starts[:-1]), np.diff(starts))
            yield from part.filter(pa.array((n == 1) & (total > 1))).select(["t", "lead"]).to_batches()

    rows = stored(over_texts(docs, text_col, [], run, SHARED), "shared")
    open_ = rows.where("n > 0").repartition("whole", "check").sortWithinPartitions("whole", "check")
    found = open_.mapInArrow(settle, "t binary, lead long").union(rows.where("n = 0").select("t", "lead"))
    return found.distinct().groupBy("t").agg(F.count("*").alias("n_shared"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, wanted=None) -> DataFrame:
    """(t, spans): for texts with repeats of `length` bytes, their digest and the covered maximal runs [first, stop).

    `wanted` is a bitmap of the buckets that hold several ranges, if it is known.
    """
    if length < 64:
        raise ValueError("repeats of fewer than 64 bytes have no leaders")
    if wanted is None:
        size = length - spread_of(length)
        wanted = marks(stored(repeated_buckets(docs, text_col, length, [size]), "buckets"), "bucket")
    rows = range_rows(docs, text_col, length, wanted)
    rows = rows.repartition("whole", "check").sortWithinPartitions("whole", "check")
    found = stored(rows.mapInArrow(settle_ranges(length), RANGE).withColumn("id", F.monotonically_increasing_id()), "ranges")
    left = found.where("n > 0")
    mixed = left.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1").select("bucket")
    todo = stored(
        left.join(mixed, "bucket")
        .groupBy("t", F.expr(f"first div {PIECE}").alias("piece"))
        .agg(F.collect_list(F.struct("id", "first", "last", "n")).alias("todo")),
        "todo",
    )
    pieces = text_pieces(docs, text_col, length, marks(todo.select(text_key().alias("h")), "h"))
    windows = window_rows(pieces.join(todo, ["t", "piece"]).select("_text", "piece", "todo"), length)
    windows = windows.repartition("window").sortWithinPartitions("window", "check")
    refs = windows.mapInArrow(settle_windows, "ref long")
    single = (
        refs.select(F.shiftright("ref", 8).alias("id"), F.col("ref").bitwiseAND(F.lit(255)).alias("k"))
        .join(found.where("n = 1").select("id", "t", F.col("first").alias("_from")), "id")
        .groupBy("id", "t", "_from")
        .agg(F.collect_set("k").alias("k"))
        .select("t", F.expr(f"transform(k, x -> named_struct('first', _from + x, 'stop', _from + x + {length}))").alias("s"))
    )
    ranges_ = found.where("n = 0").select("t", F.array(F.struct("first", F.col("last").alias("stop"))).alias("s"))
    spans = ranges_.union(single).groupBy("t").agg(F.flatten(F.collect_set("s")).alias("spans"))
    return stored(spans.mapInArrow(maximal, f"t binary, spans {SPANS}"), "spans")


def whole_characters(text: bytes, first: int, stop: int) -> tuple[int, int]:
    """The part of a byte run that holds whole UTF-8 characters only."""
    while first < stop and text[first] & 0xC0 == 0x80:
        first += 1
    while stop < len(text) and stop > first and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return first, stop


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    characters: bool = False,
    length: int = LENGTH,
    brief: int | None = None,
) -> DataFrame:
    """Kept columns, n_bytes, n_removed, n_shared, spans (maximal removed runs) and `kept`, the remaining bytes.

    With `characters` a run is narrowed to whole characters, so `kept` is text again.
    n_shared looks at shorter passages, which stay: the number of leaders, of which
    any 128 bytes hold one, whose `brief` bytes also start elsewhere (null without
    `brief`).  Any passage of 128 + `brief` bytes that stands twice in texts of
    `length` bytes or more counts.
    """
    keep = keep or ["doc_id"]
    if brief:
        sizes = [length - spread_of(length), brief]
        repeated = stored(repeated_buckets(docs, text_col, length, sizes), "buckets")
        long, short = (marks(repeated.where(F.col("size") == n), "bucket") for n in sizes)
        spans = repeated_spans(docs, text_col, length, long)
        spans = stored(shared_places(docs, text_col, length, brief, short).join(spans, "t", "full"), "shared")
    else:
        spans = repeated_spans(docs, text_col, length).select("t", F.lit(None).cast("long").alias("n_shared"), "spans")
    wanted = marks(spans.select(text_key().alias("h")), "h")
    fields = "".join(f"`{c}` {kind(docs, c)}, " for c in keep)
    none = 0 if brief else None
    result = f"{fields}n_bytes long, n_removed long, n_shared long, spans {SPANS}, kept binary"
    names = [*keep, "n_bytes", "n_removed", "n_shared", "spans", "kept"]

    def cut(batch, texts, n_shared, spans):
        sizes, removed, shared, all_spans, kept = [], [], [], [], []
        for text, n, own in zip(texts, n_shared, spans):
            text = text or b""
            gone = [(s["first"], s["stop"]) for s in own or ()]
            if characters:
                gone = [whole_characters(text, a, b) for a, b in gone]
            ends = [0, *(x for run in gone for x in run), len(text)]
            sizes.append(len(text))
            removed.append(sum(b - a for a, b in gone))
            shared.append(none if n is None else n)
            all_spans.append([{"first": a, "stop": b} for a, b in gone])
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])) if gone else text)
        columns = [*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (sizes, removed, shared))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(all_spans, SPANS_KIND), pa.array(kept, pa.binary())], names=names)

    def listed(batch, wanted):
        """The rows whose text may have repeats, and the others, with the digests of the texts."""
        of = Marks(wanted.value)
        keys = [digest(t) if t else None for t in batch.column("_text").to_pylist()]
        mine = pa.array([k is not None and of.has(k) for k in keys], pa.bool_())
        return pa.array(keys, pa.binary()), mine

    def meet(slices):
        for batch in slices:
            keys, mine = listed(batch, wanted)
            columns = [*(batch.column(c) for c in keep), keys, batch.column("_text")]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "t", "_text"]).filter(mine)

    def pass_by(slices):
        """Texts without repeats go past the join."""
        for batch in slices:
            _, mine = listed(batch, wanted)
            batch = batch.filter(pc.invert(mine))
            texts = batch.column("_text").to_pylist()
            yield cut(batch, texts, [None] * len(texts), [None] * len(texts))

    def after(batches):
        for batch in slices(batches):
            yield cut(batch, *(batch.column(c).to_pylist() for c in ("_text", "n_shared", "spans")))

    wanted = marks(spans.select(text_key().alias("h")), "h")
    hit = over_texts(docs, text_col, keep, meet, f"{fields}t binary, _text binary").join(spans, "t", "left")
    hit = hit.select(*(F.col(f"`{c}`") for c in keep), "_text", "n_shared", "spans").mapInArrow(after, result)
    return hit.union(over_texts(docs, text_col, keep, pass_by, result))
