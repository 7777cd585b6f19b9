"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to be taken c times, its source's target divided by
the source's size (or in proportion to a weight of its own).  The whole copies in
c are certain.  The rest is a probability p of one more copy, and the documents are
ranked by

    (u / (1 - u)) / (p / (1 - p)),    u uniform from a digest of the document's id:

the smallest ranks form a sample of fixed size with these unequal probabilities.
The size is counted in words, what the target leaves above the certain copies:
ranks are taken while they fit, then, in the same order, those that still fit into
the gap that the first document too large has left.

Running sums over a source come from a prefix scan: rows are range-partitioned by
source and rank and written; each part is summed, the sums of the parts before are
added to the running sums inside a part.  No source has to fit into one task.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is one of its own, last in order; a null id is a value like any other;
repeated rows are ranked alike, and some of them may be taken once more than
others; ranks that tie go by id, then by size; an empty table gives no rows; extra
columns are ignored.  A very long text is a document like any other, taken whole
or not.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import kind, over_texts, stored

#: Shares of the sources in turn, of all sizes to take, times that a document may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix"


def sizes(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns and `size`, the number of words `[^\\x20\\x09-\\x0D]+`."""

    def run(slices):
        for batch in slices:
            n = [len(text.split()) if text else 0 for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "size"])

    fields = "".join(f"`{c}` {kind(docs, c)}, " for c in keep)
    return over_texts(docs, text_col, keep, run, f"{fields}size long")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight) with `target`: `share` of all sizes by weight, at most `most` times the size.

    What is above a limit is shared again by weight among the sources below
    theirs, until none is above.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.count("*")
        ).first()
        if not row[2] or not row[1]:
            break
        raised = (share * total - float(most) * row[0]) / row[1]
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def running(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the running sum of `value` within `group` by `order`, from a scan over range partitions."""
    parts = stored(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    same = parts[group].eqNullSafe
    sums = parts.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_part", F.col(group).alias("_group"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = parts.withColumn("_own", inside).join(
        carried.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & same(F.col("_group"))
    )
    return summed.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_of", "_group", "_own", "_before")


def pareto_rank(key: Column, p: Column, seed: str = SEED) -> Column:
    """Random odds divided by inclusion odds."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    u = drawn / F.lit(float(1 << 52))
    return (u / (1 - u)) / (p / (1 - p))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    sized = stored(sizes(named, ["doc_id", "source"]), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one_each = by_source.select(
        "source", "source_size", F.col("source").isNull().alias("none"), F.lit(0).alias("all"), F.lit(1).alias("one")
    )
    nth = running(one_each, "all", ["none", "source"], "one", "nth")
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    aims = stored(targets(nth.select("source", "source_size", turn.alias("weight")), share, most), "targets")

    planned = sized.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int").alias("certain"),
    )
    left = F.col("target") - F.col("certain") * F.col("source_size")
    p = left / F.col("source_size")
    rank = pareto_rank(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), p)
    drawn = planned.where((left > 0) & (F.col("size") > 0)).withColumn("left", left).withColumn("rank", rank)
    order = ["rank", "doc_id", "size"]
    first = stored(running(drawn, "source", order, "size", "reached"), "first")
    fits = F.col("reached") <= F.col("left")
    took = first.groupBy("source").agg(F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("took"))
    rest = first.where(~fits).join(took.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rest = rest.withColumn("gap", F.col("left") - F.col("took")).drop("_source", "took", "reached")
    second = running(rest.where(F.col("size") <= F.col("gap")), "source", order, "size", "reached").where("reached <= gap")
    tried = running(rest.where(F.col("size") <= F.col("gap")), "source", order, "size", "reached")

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        copies = (F.col("certain") + extra.cast("int")).alias("copies")
        return rows.select("doc_id", "source", "size", "source_size", "target", copies)

    done = (
        out(planned.where(~((left > 0) & (F.col("size") > 0))), F.lit(0))
        .unionByName(out(first.where(fits), F.lit(1)))
        .unionByName(out(rest.where(F.col("size") > F.col("gap")), F.lit(0)))
        .unionByName(out(tried, F.col("reached") <= F.col("gap")))
    )
    return done.withColumn("taken", F.col("copies") * F.col("size"))
