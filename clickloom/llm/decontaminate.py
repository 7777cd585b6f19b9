"""Benchmark decontamination by Wu-Manber search over words.

The strings searched for are windows of consecutive benchmark words.  For each
window length, a block of two words has the shift it allows: how far the search
may jump when the block ends at the present word.  Blocks that no window holds
allow the longest jump, so most words of a clean text are never looked at.
Where the shift is zero, the hash of the last block picks a bucket of windows,
the first block narrows it, and a direct comparison confirms the occurrence.

The benchmark is taken in blocks of bounded size; documents pass through one
matcher per block, without a shuffle.

Defined cases: a null text has no words; an item without words has no windows;
an item with fewer words than a window is one window of its own length; items
that share a window are all reported; repeated items count once, and items with
a null id count as one item named by the empty string; repeated documents are
each reported; empty tables give no rows or no hits; extra columns are ignored.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import PLAIN_WORDS, as_bytes, kind, slices

#: Bytes of benchmark text held by one matcher.
BLOCK_BYTES = 16 << 20

SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split() if text else []


class Matcher:
    """Wu-Manber tables for windows of words, each with the ids of its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.numbers: dict[bytes, int] = {}
        for window in windows:
            for word in window:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.width = len(self.numbers) + 1
        by_length: dict[int, list] = {}
        for window, items in windows.items():
            by_length.setdefault(len(window), []).append(([self.numbers[w] for w in window], items))
        self.groups = [self._tables(m, group) for m, group in sorted(by_length.items())]

    def _block(self, ids: list[int], end: int, size: int) -> int:
        return ids[end - 1] * self.width + ids[end] if size == 2 else ids[end]

    def _tables(self, m: int, group: list) -> tuple:
        size = min(2, m)
        jump = m - size + 1
        shifts: dict[int, int] = {}
        buckets: dict[int, dict[int, list]] = {}
        for ids, items in group:
            for end in range(size - 1, m):
                block = self._block(ids, end, size)
                shifts[block] = min(shifts.get(block, jump), m - 1 - end)
            same_end = buckets.setdefault(self._block(ids, m - 1, size), {})
            same_end.setdefault(self._block(ids, size - 1, size), []).append((ids, items))
        return m, size, jump, shifts, buckets

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, stop) runs of words inside occurrences, and the items that occur."""
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        runs, found = [], set()
        for m, size, jump, shifts, buckets in self.groups:
            at, width = m - 1, self.width
            while at < len(ids):
                last = ids[at]
                if not last:  # no window holds this word
                    at += m
                    continue
                block = ids[at - 1] * width + last if size == 2 else last
                shift = shifts.get(block, jump)
                if shift:
                    at += shift
                    continue
                first = at - m + 1
                head = self._block(ids, first + size - 1, size)
                for window, items in buckets[block].get(head, ()):
                    if ids[first : at + 1] == window:
                        runs.append((first, at + 1))
                        found.update(items)
                at += 1
        return merged(runs), found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, stop in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def windows_of(items, window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window with the ids of its items, from (id, text as bytes)."""
    out: dict[tuple[bytes, ...], dict[str, None]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(tuple(words[i : i + size]), {})["" if item is None else str(item)] = None
    return {w: list(ids) for w, ids in out.items()}


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in parts of about `block_bytes`, each small enough for one matcher."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), as_bytes(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("text", "item"), F.lit(n))
    for k in range(n):
        yield [(r.item, bytes(r.text) if r.text is not None else None) for r in items.filter(part == k).collect()]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: n_words, n_hit, hit_spans (runs of words inside windows) and item_ids.

    `keep` lists the input columns to carry along, by default the id alone.
    """
    keep = keep or [id_col]
    # A kept text goes through Python once, as the bytes.
    back = {text_col: F.col("_text").cast("string").alias(text_col)} if kind(docs, text_col) == "string" else {}
    carried = [c for c in keep if c not in back]
    fields = "".join(f"`{c}` {kind(docs, c)}, " for c in carried)
    state = "n_words long, hit_spans array<struct<first: bigint, stop: bigint>>, item_ids array<string>"
    df = docs.select(*[F.col(f"`{c}`") for c in carried], as_bytes(text_col).alias("_text"))
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        matcher = Matcher(windows_of(items, window))

        def search(batches, matcher=matcher):
            for batch in slices(batches):
                earlier = batch.schema.get_field_index("hit_spans") >= 0
                spans = batch.column("hit_spans").to_pylist() if earlier else [[]] * batch.num_rows
                ids = batch.column("item_ids").to_pylist() if earlier else [[]] * batch.num_rows
                counts, all_spans, all_ids = [], [], []
                for text, had, known in zip(batch.column("_text").to_pylist(), spans, ids):
                    words = words_of(text)
                    runs, found = matcher.scan(words)
                    counts.append(len(words))
                    if had and runs:
                        runs = merged(runs + [(s["first"], s["stop"]) for s in had])
                    all_spans.append([{"first": a, "stop": b} for a, b in runs] if runs else had)
                    all_ids.append(sorted({*known, *found}))
                columns = [batch.column(c) for c in [*carried, "_text"]]
                columns += [pa.array(counts, pa.int64()), pa.array(all_spans, SPANS), pa.array(all_ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, "_text", "n_words", "hit_spans", "item_ids"])

        df = df.mapInArrow(search, f"{fields}_text binary, {state}")
    inside = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return df.select(*[back.get(c, F.col(f"`{c}`")) for c in keep], "n_words", inside.alias("n_hit"), "hit_spans", "item_ids")
