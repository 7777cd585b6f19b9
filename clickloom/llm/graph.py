"""Connected components of links between long node ids."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import stored

#: Links that one task contracts at a time.
LINKS = 250_000


def _state(links: DataFrame):
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the smallest node that each reaches over them."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        # Go on with the links between different roots.
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def contracted(links: DataFrame, n: int, most: int) -> DataFrame:
    """(node, root): each node of the n links with the smallest one reached over `most` links of its task."""

    def rows(held):
        node, root = _roots(*(np.concatenate(side) for side in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            for at in range(0, len(a), most):
                if size + len(part := a[at : at + most]) > most:
                    yield rows(held)
                    held, size = [], 0
                held.append((part, b[at : at + most]))
                size += len(part)
        if held:
            yield rows(held)

    return links.coalesce(max(1, -(-n // most))).mapInArrow(run, "node long, root long")


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the component's smallest node.

    Tasks first contract `most` links at a time by themselves; if there are no
    more, that is all.  Otherwise what they leave goes through alternating
    large-star and small-star steps: each node passes its smallest neighbour on,
    so long chains shrink to stars in logarithmically many rounds.  Each round is
    written to the shared folder.  Groups only form minima, which combine on the
    map side; the joins that follow can be split by key.
    """
    links = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    n = links.count()
    near = contracted(links, n, most)
    if n <= most:
        return near
    links = stored(near.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = stored(small, "links")
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
