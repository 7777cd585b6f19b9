"""Products bought together: exact lists, whatever the basket sizes.

One method for all baskets, in two steps.

Head.  The ``HEAD`` most frequent products are counted with everything they share
a basket with: a basket of m products gives at most ``HEAD`` times m rows.  That
already bounds each list: if its n-th entry so far is better than a product could
ever be (a product cannot be found with another more often than it is found at
all), that product need not be counted for it.

Tail.  Baskets lose the products that can reach no list of theirs and whose own
lists no other product can reach.  What is left is cut into blocks of about
``CELL`` products by a hash.  Products meet in cells, pairs of blocks, so a basket
of thousands of products is worked on by many tasks and a cell is small.  The bound
drops pairs that matter to neither side, and partial sums leave the task.

Few baskets.  Where there are at most ``FEW`` baskets, each with many products, pairs
are not listed by basket: a product becomes one bit a basket, and a pair's count is
the bits both have.  Products with equal bits are found with everything equally
often, so only the smallest ids of them can be in a list.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import shuffled_over, written

HEAD, CELL = 32, 128
#: Baskets that fit into bits, products of a block of bits, most blocks, leaders among the products, and pairs of one task.
FEW, BLOCK, BLOCKS, LEADERS, TASK = 1024, 2048, 96, 2048, 1_000_000


def _members(items: DataFrame, count_repeats: bool = False) -> DataFrame:
    """(basket_id, product_id, times), a row per product of a basket, written once for all steps."""
    named = items.where(F.coalesce("product_id", F.lit("")) != "")
    times = F.count("*") if count_repeats else F.lit(1).cast("long")
    return written(named.groupBy("basket_id", "product_id").agg(times.alias("times")), "members")


def _pairs(members: DataFrame, item: Column, cell: int, tasks: int | None = None) -> DataFrame:
    """(a, b) for every two products of a basket, as ``item`` structs, a before b by product."""
    sizes = members.groupBy("basket_id").agg(F.ceil(F.count("*") / cell).cast("int").alias("_blocks")).where("_blocks > 1")
    dealt = members.join(sizes, "basket_id", "left").select(
        "basket_id", item.alias("_item"), F.coalesce("_blocks", F.lit(1)).alias("_blocks"),
        F.pmod(F.xxhash64("product_id"), F.coalesce("_blocks", F.lit(1))).cast("int").alias("_own"),
    )
    # A cell (i, j) holds a product of block i with all its partners of block j.
    left = dealt.select("basket_id", F.col("_own").alias("i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("j"), F.col("_item").alias("x"))
    right = dealt.select("basket_id", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("i"), F.col("_own").alias("j"), F.col("_item").alias("y"))
    if tasks:
        left, right = (side.repartition(tasks, "basket_id", "i", "j") for side in (left, right))
    both = left.join(right, ["basket_id", "i", "j"]).where(
        ((F.col("i") < F.col("j")) & (F.col("x.product_id") != F.col("y.product_id"))) | (F.col("x.product_id") < F.col("y.product_id"))
    )
    turned = F.col("x.product_id") > F.col("y.product_id")
    return both.select(
        F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b")
    )


def top_partners(
    items: DataFrame, n: int = 5, count_repeats: bool = False, head: int = HEAD, cell: int = CELL, few: int = FEW
) -> DataFrame:
    """For every product, the ``n`` products found most in the baskets that hold it.

    ``items`` has (basket_id, product_id) rows.  A partner counts once per
    basket, or with ``count_repeats`` once per row.  Ties go to the smaller id.
    """
    members = _members(items, count_repeats)
    if not count_repeats and members.select("basket_id").distinct().limit(few + 1).count() <= few:
        return _partners_of_equals(members, n, head, cell)
    return _listed_partners(members, n, count_repeats, head, cell)


def _partners_of_equals(members: DataFrame, n: int, head: int, cell: int) -> DataFrame:
    """top_partners() for few baskets: lists of the smallest ids of equal products serve the others too.

    Another product of the set has the list of the set's first product, with that product in it.
    """
    bits, words = _bits(members)
    bits = written(bits, "bits")
    kept = written(_first_of_equals(bits, words, n + 1), "equals")
    lists = written(_listed_partners(written(members.join(kept.select("product_id"), "product_id"), "kept"), n, False, head, cell), "lists")
    first = kept.groupBy(*words).agg(F.min("product_id").alias("product_id"))
    own = first.select(*words, F.col("product_id").alias("partner_id"), _total(words).alias("together"))
    ranked = Window.partitionBy(*words).orderBy(F.desc("together"), "partner_id")
    of_sets = (
        lists.join(first, "product_id").select(*words, "partner_id", "together").unionByName(own)
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)
    )
    others = bits.join(kept.select("product_id"), "product_id", "left_anti")
    columns = ["product_id", "partner_id", "together", "rank"]
    return lists.select(*columns).unionByName(others.join(of_sets, words).select(*columns))


def _listed_partners(members: DataFrame, n: int, count_repeats: bool, head: int, cell: int) -> DataFrame:
    """top_partners() of ``_members`` rows."""
    totals = members.groupBy("product_id").agg(F.sum("times").alias("total"))
    leaders = totals.orderBy(F.desc("total"), "product_id").limit(head).select(F.col("product_id").alias("leader"))
    marked = members.join(leaders, F.col("product_id") == F.col("leader"), "left")

    led = marked.where("leader is not null").select("basket_id", F.col("product_id").alias("partner_id"), F.col("times").alias("partner_times"))
    with_head = (
        marked.join(led, "basket_id")
        .where(F.col("product_id") != F.col("partner_id"))
        .groupBy("product_id", "partner_id", F.col("leader").isNotNull().alias("led"))
        .agg(F.sum("partner_times").alias("together"), F.sum("times").alias("back"))
    )
    # What a list must beat: its n-th entry among the leaders.
    ranked = Window.partitionBy("product_id").orderBy(F.desc("together"), "partner_id")
    bounds = (
        with_head.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") == n)
        .select("product_id", F.struct((-F.col("together")).alias("less"), F.col("partner_id").alias("id")).alias("bound"))
    )
    open_list = F.struct(F.lit(1).cast("long").alias("less"), F.lit("").alias("id"))
    known = totals.join(bounds, "product_id", "left").select(
        "product_id", "total", F.coalesce("bound", open_list).alias("bound"), F.struct((-F.col("total")).alias("less"), F.col("product_id").alias("id")).alias("best")
    )
    # Counted once a basket, a pair has no more than either product: where a list is at that
    # limit already, only smaller ids could still enter it.
    full = F.lit(not count_repeats) & (F.col("bound.less") == -F.col("total"))
    tail = marked.where("leader is null").drop("leader").join(known.withColumn("full", full), "product_id")
    # Structs compare by count, then id; the smaller is the better one.
    reach = tail.groupBy("basket_id").agg(
        F.max(F.when(~F.col("full"), F.col("bound"))).alias("_loosest"), F.max(F.when(F.col("full"), F.col("bound.id"))).alias("_last"),
        F.min("best").alias("_strongest"), F.min("product_id").alias("_first"),
    )
    offers = (F.col("best") < F.col("_loosest")) | (F.col("product_id") < F.col("_last"))
    seeks = F.when(F.col("full"), F.col("_first") < F.col("bound.id")).otherwise(F.col("_strongest") < F.col("bound"))
    wanted = tail.join(reach, "basket_id").where(F.coalesce(offers, F.lit(False)) | seeks)
    item = F.struct("product_id", "times", "bound", "total")

    def enters(product: str, partner: str) -> Column:
        most = F.col(f"{partner}.total") if count_repeats else F.least(F.col(f"{product}.total"), F.col(f"{partner}.total"))
        return F.struct((-most).alias("less"), F.col(f"{partner}.product_id").alias("id")) < F.col(f"{product}.bound")

    counted = (
        _pairs(wanted, item, cell)
        .where(enters("a", "b") | enters("b", "a"))
        .groupBy(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"))
        .agg(F.sum("a.times").alias("a_times"), F.sum("b.times").alias("b_times"))
    )

    def side(product: str, partner: str, times: str) -> Column:
        return F.struct(F.col(product).alias("product_id"), F.col(partner).alias("partner_id"), F.col(times).alias("together"))

    found = with_head.select("product_id", "partner_id", "together").unionByName(
        with_head.where(~F.col("led")).select(F.inline(F.array(side("partner_id", "product_id", "back"))))
    )
    found = found.unionByName(counted.select(F.inline(F.array(side("a", "b", "b_times"), side("b", "a", "a_times")))))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def _bits(members: DataFrame) -> tuple[DataFrame, list[str]]:
    """(product_id, w0, w1, …): one bit a basket, for few baskets; and the names of the words."""
    numbers = members.select("basket_id").distinct().withColumn("_n", F.row_number().over(Window.orderBy("basket_id")) - 1)
    words = [f"w{i}" for i in range(-(-numbers.count() // 64))]
    bit = F.expr("shiftleft(1L, _n % 64)")
    sums = [F.bit_or(F.when(F.floor(F.col("_n") / 64) == i, bit).otherwise(0)).alias(w) for i, w in enumerate(words)]
    return members.join(numbers, "basket_id").groupBy("product_id").agg(*sums), words


def _total(words: list[str]) -> Column:
    return reduce(add, [F.bit_count(w) for w in words]).cast("long")


def _first_of_equals(bits: DataFrame, words: list[str], n: int) -> DataFrame:
    """The ``n`` smallest ids of each set of products with equal bits."""
    place = F.row_number().over(Window.partitionBy(*words).orderBy("product_id"))
    return bits.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def _top_pairs_by_bits(members: DataFrame, n: int, leaders: int, block: int) -> DataFrame:
    """top_pairs() for few baskets: every two products that have enough baskets are compared by bits."""
    bits, words = _bits(members)
    # A pair of equal products, or of two such sets, comes after n pairs of smaller ids otherwise.
    kept = written(_first_of_equals(bits, words, n + 1).withColumn("total", _total(words)), "bits")
    best = [F.desc("together"), "product_a", "product_b"]

    def compared(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        shared = reduce(add, [F.bit_count(F.col(f"a.{w}").bitwiseAND(F.col(f"b.{w}"))) for w in words])
        return a.join(b, on & (F.least(F.col("a.total"), F.col("b.total")) >= least) & (shared >= least)).select(
            F.least("a.product_id", "b.product_id").alias("product_a"), F.greatest("a.product_id", "b.product_id").alias("product_b"),
            shared.cast("long").alias("together"),
        )

    least = 1
    first = kept.orderBy(F.desc("total"), "product_id").limit(leaders)
    head = compared(first, first, F.col("a.product_id") < F.col("b.product_id")).orderBy(*best).limit(n)
    found, lowest = head.agg(F.count("*"), F.min("together")).first()
    least = lowest if found == n else 1

    enough = kept.where(F.col("total") >= least)
    blocks = min(BLOCKS, max(1, -(-enough.count() // block)))
    dealt = enough.withColumn("_own", F.pmod(F.xxhash64("product_id"), F.lit(blocks)).cast("int"))
    cells = blocks * (blocks + 1)
    left = dealt.select("*", F.col("_own").alias("i"), F.explode(F.sequence("_own", F.lit(blocks - 1))).alias("j"))
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "_own")).alias("i"), F.col("_own").alias("j"))
    if blocks > 1:
        left, right = (side.repartition(cells, "i", "j") for side in (left, right))
    else:  # one cell, whose rows have a task each part
        left = left.repartition("product_id")
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.product_id") < F.col("b.product_id"))
    return compared(left, right, (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & once).orderBy(*best).limit(n)


def top_pairs(
    items: DataFrame, n: int = 10, head: int = HEAD, cell: int = CELL, few: int = FEW, leaders: int = LEADERS, block: int = BLOCK
) -> DataFrame:
    """The product pairs found together in most baskets.

    The n-th best pair among the most frequent products is the least that a pair
    must reach, so rarer products leave their baskets before any pair is listed.
    Products of few, wide baskets are compared by bits if that is less work.
    """
    members = _members(items)
    spark = members.sparkSession
    totals = members.groupBy("product_id").agg(F.count("*").alias("total"))
    best = [F.desc("together"), "product_a", "product_b"]

    def listed(chosen: DataFrame) -> tuple[int, int]:
        """Baskets, and the pairs they list."""
        sizes = chosen.groupBy("basket_id").agg(F.count("*").alias("m"))
        return sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("long")).first()

    baskets, pairs = listed(members)
    products = totals.count()
    if baskets <= few and products * (products - 1) // 2 * -(-baskets // 64) < pairs:
        return _top_pairs_by_bits(members, n, leaders, block)

    def counted(chosen: DataFrame, tasks: int | None = None) -> DataFrame:
        found = _pairs(chosen, F.struct("product_id"), cell, tasks)
        return found.groupBy(F.col("a.product_id").alias("product_a"), F.col("b.product_id").alias("product_b")).agg(
            F.count("*").alias("together")
        )

    first = totals.orderBy(F.desc("total"), "product_id").limit(head).select("product_id")
    least = counted(members.join(first, "product_id")).orderBy(*best).limit(n)
    found, lowest = least.agg(F.count("*"), F.min("together")).first()
    if found == n and lowest > 1:
        members = written(members.join(totals.where(F.col("total") >= lowest).select("product_id"), "product_id"), "enough")
        baskets, pairs = listed(members)
    tasks = -(-pairs // TASK)
    with shuffled_over(spark, tasks):
        return written(counted(members, tasks if tasks > 1 else None).orderBy(*best).limit(n), "pairs")
