import random

import pytest
from llm_cases import prose, rows_of

from clickloom.llm import mixing

ROW = "doc_id long, text string, source string, size string, target int, rank double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 0.5) for i, t, s in rows], ROW).repartition(5)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by source, sharing again what is above the limits until nothing is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not above:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return target


def cases():
    r = random.Random(1)
    rows = [(i, prose(i, r.randrange(1, 120)), r.choice(["a", "a", "b", "Z", "é", None, "c", "c", "c", "c", "c", "c"])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \n\t", None), (None, "one two", "a"), (None, None, None), (7, "again and again", "a")]
    rows += [(5, "same row", "b")] * 3 + [(3000, prose(3, 9000), "big"), (3001, "tiny", "big"), (3002, None, "empty")]
    return rows


def test_mix_meets_its_targets(spark):
    rows = cases()
    got = mixing.mix(frame(spark, rows))
    assert rows_of(got, *got.columns) == rows_of(mixing.mix(frame(spark, rows).repartition(2)), *got.columns)
    found = got.collect()
    assert len(found) == len(rows)
    sizes, taken, largest, target = {}, {}, {}, {}
    want = sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"]) for r in found) == want
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert {r.source: r.source_size for r in found} == sizes
    aims = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(aims[s])
        assert target[s] <= 2 * sizes[s]
        assert -largest[s] <= taken[s] - target[s] <= 1e-6, s
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert abs(taken["c"] - target["c"]) < 0.01 * target["c"]
    # Certain copies: all documents of a source are taken the floor or the ceiling of its share.
    for r in found:
        if r.source_size:
            assert r.copies in {int(r.target / r.source_size), int(r.target / r.source_size) + 1}
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def test_running_sums(spark):
    rows = [(g, k, k % 3) for g in (None, "a", "b") for k in range(50 if g == "a" else 3)]
    got = mixing.running(spark.createDataFrame(rows, "g string, k int, v int"), "g", ["k"], "v", "total")
    assert rows_of(got, "g", "k", "total") == sorted(((g, k, sum(j % 3 for j in range(k + 1))) for g, k, _ in rows), key=repr)


def test_inclusion_follows_the_odds(spark):
    """Documents with p = 0.8 are chosen more often than those with p = 0.2, in about that measure."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 2 == 0, 0.8).otherwise(0.2).alias("p"))
    ranked = rows.withColumn("rank", mixing.pareto_rank(F.col("k"), F.col("p"))).orderBy("rank").limit(2000)
    share = ranked.agg(F.avg((F.col("p") == 0.8).cast("int"))).first()[0]
    assert 0.76 < share < 0.84
