"""M rows: features, models, patterns."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom.operators import features, models
from clickloom.session import written
from clickloom.sources import adapter
from contract.common import END, PRODUCTS_SQL, add, over_events

add(
    "m1_interactions",
    lambda s, d: features.interactions(
        adapter.events(s, d).withColumn(
            "product_id", F.when(F.col("event_type") != "checkout", F.col("product_id"))
        )
    ),
    over_events(
        """, r AS (SELECT user_id, product_id, CASE event_type WHEN 'pageview' THEN 1.0::DOUBLE WHEN 'add_to_cart' THEN 3.0
             WHEN 'purchase' THEN 8.0 ELSE 1.0 END AS w FROM ev WHERE event_type <> 'checkout'
          UNION ALL SELECT user_id, unnest(product_ids), 4.0 FROM ev WHERE event_type = 'checkout')
        SELECT user_id, product_id, sum(w) AS rating FROM r GROUP BY 1, 2"""
    ),
)
add(
    "m2_max_ratings",
    lambda s, d: features.max_ratings(adapter.events(s, d)),
    over_events(
        """SELECT user_id, product_id, max(CASE event_type WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'add_to_cart' THEN 3.0 ELSE 1.0 END) AS rating
        FROM ev WHERE event_type IN ('pageview', 'add_to_cart', 'purchase') GROUP BY 1, 2"""
    ),
)
CAPPED = """, cap AS (SELECT user_id, product_id, count(*) AS view_count,
    CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'add_to_cart' THEN 2 ELSE 1 END) AS BIGINT) AS w FROM ev GROUP BY 1, 2),
  rat AS (SELECT user_id, product_id, view_count, CASE WHEN w > 10 THEN 5.0::DOUBLE ELSE round(w * 5.0::DOUBLE / 10, 1) END AS rating FROM cap)"""
add("m3_capped_ratings", lambda s, d: features.capped_ratings(adapter.events(s, d)), over_events("SELECT * FROM rat", CAPPED))
add(
    "m21_rating_stats",
    lambda s, d: features.rating_stats(features.capped_ratings(adapter.events(s, d))),
    over_events(
        """SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT product_id) AS total_items,
        count(*) AS total_interactions, round(avg(rating), 4) AS avg_rating FROM rat""",
        CAPPED,
    ),
)


def _recommender(s, d):
    return models.fit_als(features.interactions(adapter.events(s, d)))


# Trained models have no SQL form.  These queries return what must hold of a
# model whatever its weights are, next to facts that SQL takes from the tables.
RATED = ", rat AS (SELECT DISTINCT user_id, product_id FROM ev)"


def _als_score(s, d):
    """Sizes of the training tables, and whether the fitted model beats the mean on the ratings it saw most of."""
    ratings = written(features.interactions(adapter.events(s, d)), "interactions")
    fitted, rmse = models.fit_als(ratings)
    known = ratings.join(fitted.users, "user_id").join(fitted.products, "product_id")
    missed = F.col("prediction").cast("double") - F.col("rating")
    error = fitted.als.transform(known).agg(F.sqrt(F.avg(missed * missed))).scalar()
    spread = ratings.agg(F.stddev_pop("rating")).scalar()
    counts = [F.count("*").alias("ratings"), F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("products")]
    indexed = fitted.users.agg(F.countDistinct("user_idx")).scalar(), fitted.products.agg(F.countDistinct("product_idx")).scalar()
    return ratings.agg(*counts).select(
        "*", (F.lit(rmse) < 2 * spread).alias("rmse_in_range"), (error < spread).alias("beats_the_mean"),
        indexed[0].alias("user_numbers"), indexed[1].alias("product_numbers"),
    )


add(
    "m4_als_rmse",
    _als_score,
    over_events(
        """SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products,
        count(*) > 0 AS rmse_in_range, count(*) > 0 AS beats_the_mean, count(DISTINCT user_id) AS user_numbers, count(DISTINCT product_id) AS product_numbers FROM rat""",
        RATED,
    ),
)


def _als_lists(s, d):
    """Per user: ranks 1 to n, known products, none twice, scores falling."""
    lists = models.als_top_n(_recommender(s, d)[0], 10, products=adapter.products(s, d))
    known = features.interactions(adapter.events(s, d)).select("product_id", F.lit(True).alias("known")).distinct()
    in_order = Window.partitionBy("user_id").orderBy("rank")
    falls = F.coalesce(F.col("score") <= F.lag("score").over(in_order) + 1e-6, F.lit(True))
    return lists.join(known, "product_id", "left").withColumn("falls", falls).groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("product_id").alias("products"), F.max("rank").alias("last_rank"),
        F.count("known").alias("known"), F.bool_and("falls").alias("in_order"),
    )


add(
    "m5_als_recommendations",
    _als_lists,
    over_events(
        """, n AS (SELECT least(10, count(DISTINCT product_id)) AS n FROM rat)
        SELECT DISTINCT user_id, n, n AS products, n AS last_rank, n AS known, n > 0 AS in_order FROM rat, n""",
        RATED,
    ),
)


def _similar(s, d):
    """Lists of similar items: every similarity is the product of the two factors, and none outside is larger."""
    fitted = _recommender(s, d)[0]
    asked = ["1", "2", "10"]
    lists = models.similar_items(fitted, asked, 10)
    factors = fitted.als.itemFactors.join(fitted.products.withColumnRenamed("product_idx", "id"), "id").select(
        "product_id", F.posexplode("features").alias("axis", "x")
    )
    other = factors.select(F.col("product_id").alias("similar_id"), "axis", F.col("x").alias("y"))
    products = factors.where(F.col("product_id").isin(asked)).join(other, "axis").where("product_id <> similar_id").groupBy(
        "product_id", "similar_id"
    ).agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("product"))
    both = products.join(lists, ["product_id", "similar_id"], "left")
    return both.groupBy("product_id").agg(
        F.count("rank").alias("n"),
        F.bool_and(F.coalesce(F.abs(F.col("similarity") - F.col("product")) < 1e-9, F.lit(True))).alias("equal"),
        (F.coalesce(F.max(F.when(F.col("rank").isNull(), F.col("product"))), F.lit(float("-inf"))) <= F.min("similarity") + 1e-9).alias("best"),
    )


add(
    "m6_similar_items",
    _similar,
    over_events(
        """, p AS (SELECT DISTINCT product_id FROM rat)
        SELECT product_id, least(10, (SELECT count(*) FROM p) - 1) AS n, TRUE AS equal, TRUE AS best FROM p WHERE product_id IN ('1', '2', '10')""",
        RATED,
    ),
)
add(
    "m4_dense_ids",
    lambda s, d: models.dense_index(adapter.unsessioned(s, d), "user_id", "idx").agg(
        F.count("*").alias("ids"), F.countDistinct("idx").alias("numbers"), F.min("idx").alias("lowest"),
        F.max("idx").alias("highest"),
    ),
    """SELECT count(DISTINCT user_id) AS ids, count(DISTINCT user_id) AS numbers, CAST(0 AS BIGINT) AS lowest,
    count(DISTINCT user_id) - 1 AS highest FROM events""",
)
BASIC = """SELECT user_id, count(*) AS total_events, count(DISTINCT session_id) AS sessions_count,
  round(count(*)::DOUBLE / count(DISTINCT session_id), 6) AS avg_events_per_session,
  round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*), 6) AS conversion_rate,
  round(count(*) FILTER (WHERE event_type = 'add_to_cart')::DOUBLE / count(*), 6) AS cart_rate FROM ev GROUP BY 1"""
add("m7_user_features_basic", lambda s, d: features.user_features_basic(adapter.events(s, d)), over_events(BASIC))
add(
    "m8_user_features",
    lambda s, d: features.user_features(adapter.events(s, d), END),
    over_events(
        """SELECT user_id, count(DISTINCT session_id) AS sessions, count(*) AS events,
        count(*) FILTER (WHERE event_type = 'pageview') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
        count(*) FILTER (WHERE event_type = 'checkout') AS checkouts, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
        round(coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0), 2) AS revenue,
        round(coalesce(avg(amount) FILTER (WHERE event_type = 'purchase'), 0), 9) AS aov,
        round((epoch(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) // 1000000) / 86400.0::DOUBLE, 4) AS recency_days FROM ev GROUP BY 1"""
    ),
)
add(
    "m9_customer_features",
    lambda s, d: features.customer_features(adapter.events(s, d)),
    over_events(
        """, u AS (SELECT user_id, count(*) AS te, count(DISTINCT CAST(ts AS DATE)) AS ad, count(DISTINCT event_type) AS ua,
          count(*) FILTER (WHERE event_type = 'purchase') AS p,
          coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(price AS DECIMAL(10, 2)) END)::DOUBLE, 0) AS s,
          count(*) FILTER (WHERE event_type = 'add_to_cart') AS c, count(*) FILTER (WHERE event_type = 'pageview') AS v,
          count(DISTINCT category) AS cat, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS age
          FROM ev GROUP BY 1 HAVING count(*) >= 5)
        SELECT user_id, te AS total_events, ad AS active_days, ua AS unique_actions, p AS purchases, round(s, 2) AS total_spend,
        c AS cart_adds, v AS page_views, cat AS categories_viewed, age AS customer_age_days,
        round(s / greatest(p, 1), 6) AS avg_order_value, round(p::DOUBLE / greatest(ad, 1), 6) AS purchase_frequency,
        round(c::DOUBLE / greatest(p, 1), 6) AS cart_abandon_ratio, round(te::DOUBLE / greatest(ad, 1), 6) AS daily_activity,
        round(cat::DOUBLE / greatest(ad, 1), 6) AS category_exploration FROM u"""
    ),
)


def _distances(model, table):
    """Per user: the assigned segment, and the squared distance to every centre in the model's own space."""
    centres = models.segment_centres(model, table.sparkSession).withColumnRenamed("segment", "other")
    rows = model.transform(table).select("user_id", "segment", vector_to_array("features").alias("x"))
    gaps = F.zip_with("x", "centre", lambda p, q: (p - q) * (p - q))
    return rows.join(centres, F.lit(True)).select(
        "user_id", "segment", "other", F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g).alias("far")
    )


def _nearest(model, table):
    """One row per user: whether the assigned centre is the nearest."""
    own = F.min(F.when(F.col("segment") == F.col("other"), F.col("far")))
    return _distances(model, table).groupBy("user_id").agg(
        F.countDistinct("segment").alias("segments"), (own <= F.min("far") * (1 + 1e-9) + 1e-9).alias("nearest")
    )


def _basic_segments(s, d):
    """Users and events over all segments: each user is in exactly one."""
    table = written(features.user_features_basic(adapter.events(s, d)), "features")
    model = models.fit_segments(table, features.BASIC_FEATURES, k=3)
    stats = models.segment_stats(model, table, ["total_events", "conversion_rate", "cart_rate"], digits=None)
    return stats.agg(
        F.sum("users").alias("users"),
        F.round(F.sum(F.col("avg_total_events") * F.col("users"))).cast("long").alias("events"),
        (F.count("*") <= 3).alias("at_most_three"),
    )


def _assigned(s, d):
    table = written(features.user_features(adapter.events(s, d), END), "features")
    model = models.fit_segments(table, features.FULL_FEATURES, k=5, scaled=True)
    kept = models.assign_segments(model, table).groupBy("user_id").agg(F.count("*").alias("rows"))
    return kept.join(_nearest(model, table), "user_id")


# The five naming rules in SQL, over the means of a segment's users.
LABEL = """CASE WHEN avg(purchase_frequency) > 0.5 AND avg(total_spend) > 1000 THEN 'High Value'
  WHEN avg(purchase_frequency) > 0.2 AND avg(total_spend) > 500 THEN 'Regular Buyer'
  WHEN avg(cart_adds) > 10 AND avg(cart_abandon_ratio) > 2 THEN 'Browser'
  WHEN avg(daily_activity) > 5 AND avg(categories_viewed) > 3 THEN 'Active Explorer' ELSE 'Occasional Visitor' END"""


def _labelled(s, d):
    """Per user: the label of the segment, checked against the rules over the segment's users."""
    table = written(features.customer_features(adapter.events(s, d)), "features")
    model, _, _ = models.best_segments(table, features.CUSTOMER_FEATURES)
    labels = models.label_segments(model, table)
    members = model.transform(table)
    due = members.groupBy("segment").agg(F.expr(LABEL).alias("due"), F.count("*").alias("size"))
    told = members.select("user_id", "segment").join(labels, "segment").join(due, "segment")
    return told.select("user_id", ((F.col("segment_label") == F.col("due")) & (F.col("users") == F.col("size"))).alias("label_holds"))


def _silhouettes(s, d):
    table = written(features.customer_features(adapter.events(s, d)), "features")
    _, best, scores = models.best_segments(table, features.CUSTOMER_FEATURES)
    rows = [(k, -1 <= v <= 1, (k == best) <= (v == max(scores.values()))) for k, v in scores.items()]
    tried = s.createDataFrame(rows, "k long, in_range boolean, chosen_is_best boolean")
    return tried.join(table.agg(F.count("*").alias("users")), F.lit(True))


CUSTOMERS = ", cu AS (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 5)"
add(
    "m10_basic_segments",
    _basic_segments,
    over_events("SELECT count(DISTINCT user_id) AS users, count(*) AS events, count(*) > 0 AS at_most_three FROM ev"),
)
add(
    "m11_segment_count",
    _silhouettes,
    over_events(
        "SELECT k, TRUE AS in_range, TRUE AS chosen_is_best, (SELECT count(*) FROM cu) AS users FROM range(2, 7) r(k)", CUSTOMERS
    ),
)
add("m12_labelled_segments", _labelled, over_events("SELECT user_id, TRUE AS label_holds FROM cu", CUSTOMERS))
add(
    "m13_assigned_segments",
    _assigned,
    over_events(
        "SELECT user_id, CAST(1 AS BIGINT) AS rows, count(DISTINCT user_id) AS segments, TRUE AS nearest FROM ev GROUP BY user_id"
    ),
)
add(
    "m14_session_features",
    lambda s, d: features.session_features(adapter.events(s, d)),
    over_events(
        """, x AS (SELECT session_id, arg_max(user_id, (ts, event_id)) AS user_id, min(ts) AS st,
          round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 3) AS duration,
          (count(*) FILTER (WHERE event_type = 'pageview'))::DOUBLE AS page_views, (count(*) FILTER (WHERE page LIKE '/p/%'))::DOUBLE AS product_views,
          (count(*) FILTER (WHERE event_type = 'add_to_cart'))::DOUBLE AS cart_adds, max((event_type = 'purchase')::INT)::DOUBLE AS label
          FROM ev GROUP BY 1)
        SELECT session_id, user_id, duration, page_views, product_views, cart_adds,
        coalesce(max(label) OVER (PARTITION BY user_id ORDER BY st, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS has_history,
        label FROM x"""
    ),
)


def _told_apart(told):
    """One row: whether scores rank purchases above other sessions, and beat the base rate by log-loss.

    The area under the curve is the rank sum over probabilities of four digits.
    """
    p = F.round("probability", 4)
    counts = told.groupBy(p.alias("p")).agg(F.sum("label").alias("sold"), F.sum(1 - F.col("label")).alias("other"))
    below = F.coalesce(F.sum("other").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranks = counts.select("sold", "other", (F.col("sold") * (below + F.col("other") / 2)).alias("won"))
    area = ranks.agg((F.sum("won") / (F.sum("sold") * F.sum("other"))).alias("area"))

    def loss(q):
        return -(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))

    rate = told.agg(F.avg("label").alias("rate"))
    losses = told.join(rate, F.lit(True)).agg(
        F.avg(loss(F.least(F.greatest("probability", F.lit(1e-6)), F.lit(1 - 1e-6)))).alias("own"), F.avg(loss(F.col("rate"))).alias("base")
    )
    return area.join(losses, F.lit(True)).select(((F.col("area") > 0.5) & (F.col("own") < F.col("base"))).alias("useful"))


def _tree(s, d):
    """Features with their importance in range, scores that tell purchases apart, the sessions and purchases learned from."""
    sessions = features.session_features(adapter.events(s, d))
    model, report = models.fit_tree(sessions, features.SESSION_FEATURES)
    rows = report.select("auc", "depth", "nodes", F.inline("importances"))
    whole = F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-6
    sound = (F.col("auc") > 0.5) & (F.col("depth") <= 5) & (F.col("nodes") <= 63) & F.col("importance").between(0, 1)
    seen = sessions.agg(F.count("*").alias("sessions"), F.sum("label").cast("long").alias("purchases"))
    checked = rows.select("feature", (sound & whole).alias("sound")).join(_told_apart(models.purchase_probability(model, sessions)), F.lit(True))
    return checked.select("feature", (F.col("sound") & F.col("useful")).alias("sound")).join(seen, F.lit(True))


def _logistic(s, d):
    """Per session: the label, a probability in range, the prediction that follows from it, scores that tell purchases apart."""
    sessions = features.session_features(adapter.events(s, d))
    columns = features.SESSION_FEATURES + ["has_history"]
    model, _ = models.fit_logistic(sessions, columns)
    told = models.purchase_probability(model, sessions)
    follows = F.col("prediction") == F.when(F.col("probability") > 0.5, 1.0).otherwise(0.0)
    return told.join(_told_apart(told), F.lit(True)).select(
        "session_id", "label", (F.col("probability").between(0, 1) & follows & F.col("useful")).alias("sound")
    )


SOLD = ", x AS (SELECT session_id, max((event_type = 'purchase')::INT)::DOUBLE AS label FROM ev GROUP BY 1)"
add(
    "m15_purchase_tree",
    _tree,
    over_events(
        """SELECT unnest(['duration', 'page_views', 'product_views', 'cart_adds']) AS feature, TRUE AS sound,
        count(*) AS sessions, CAST(sum(label) AS BIGINT) AS purchases FROM x""",
        SOLD,
    ),
)
add("m16_purchase_probability", _logistic, over_events("SELECT session_id, label, TRUE AS sound FROM x", SOLD))
PAGES = """, pg AS (SELECT DISTINCT session_id, CASE WHEN page LIKE '%/p/%' THEN '/product' WHEN page LIKE '%/category%' THEN '/category'
    ELSE split_part(page, '?', 1) END AS item FROM ev),
  ok AS (SELECT session_id FROM pg GROUP BY 1 HAVING count(*) >= 2),
  bk AS (SELECT pg.* FROM pg SEMI JOIN ok USING (session_id)), nb AS (SELECT count(*) AS t FROM ok),
  -- every item set as a bit mask over the few page families
  it AS (SELECT item, 1::BIGINT << (row_number() OVER (ORDER BY item) - 1) AS bit FROM (SELECT DISTINCT item FROM bk)),
  ms AS (SELECT session_id, CAST(sum(bit) AS BIGINT) AS m FROM bk JOIN it USING (item) GROUP BY 1),
  st AS (SELECT unnest(range(1, CAST(sum(bit) AS BIGINT) + 1)) AS m FROM it),
  fq AS (SELECT st.m, count(*) AS n, (SELECT string_agg(item, ',' ORDER BY item) FROM it WHERE (st.m & it.bit) > 0) AS items
    FROM st JOIN ms ON (ms.m & st.m) = st.m GROUP BY st.m HAVING count(*) >= (SELECT ceil(0.1 * t) FROM nb))"""


def _page_patterns(s, d):
    kept = features.page_baskets(adapter.events(s, d))
    model = models.fit_patterns(kept, 0.1, 0.3)
    return models.frequent_patterns(model, kept, n=None)


add(
    "m17_page_patterns",
    _page_patterns,
    over_events(
        "SELECT items, n AS frequency, round(n::DOUBLE / t, 4) AS support FROM fq, nb WHERE bit_count(m) >= 2",
        PAGES,
    ),
)


def _page_rules(s, d):
    model = models.fit_patterns(features.page_baskets(adapter.events(s, d)), 0.1, 0.3)
    return models.association_rules(model)


add(
    "m17_page_rules",
    _page_rules,
    over_events(
        """SELECT l.items AS antecedent, r.items AS consequent, round(w.n::DOUBLE / l.n, 6) AS confidence,
        round((w.n::DOUBLE / l.n) / (r.n::DOUBLE / t), 6) AS lift, round(w.n::DOUBLE / t, 6) AS support
        FROM fq w JOIN fq r ON bit_count(r.m) = 1 AND (w.m & r.m) = r.m JOIN fq l ON l.m = w.m - r.m, nb
        WHERE w.n::DOUBLE / l.n >= 0.3""",
        PAGES,
    ),
)
add(
    "m18_product_baskets",
    lambda s, d: features.product_baskets(adapter.events(s, d)),
    over_events(
        """SELECT event_id, CASE WHEN event_type = 'purchase' THEN product_id ELSE array_to_string(product_ids, ',') END AS items
        FROM ev WHERE event_type IN ('checkout', 'purchase')"""
    ),
)


def _affinity(s, d):
    kept = features.product_baskets(adapter.events(s, d))
    return models.fit_patterns(kept, 0.005, 0.2), kept


AFFINITY = """, bs AS (SELECT event_id, unnest(CASE WHEN event_type = 'purchase' THEN [product_id] ELSE product_ids END) AS item
    FROM ev WHERE event_type IN ('checkout', 'purchase')),
  nb AS (SELECT count(DISTINCT event_id) AS t FROM bs), one AS (SELECT item, count(*) AS n FROM bs GROUP BY 1),
  two AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM bs a JOIN bs b ON a.event_id = b.event_id AND a.item <> b.item GROUP BY 1, 2),
  three AS (SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS n FROM bs a JOIN bs b ON a.event_id = b.event_id AND a.item < b.item
     JOIN bs c ON a.event_id = c.event_id AND c.item <> a.item AND c.item <> b.item GROUP BY 1, 2, 3),
  ru AS (
    SELECT two.a AS antecedent, two.b AS consequent, two.n::DOUBLE / x.n AS cf, (two.n::DOUBLE / x.n) / (y.n::DOUBLE / t) AS lf, two.n::DOUBLE / t AS sp, two.a AS p1, CAST(NULL AS VARCHAR) AS p2
    FROM two JOIN one x ON x.item = two.a JOIN one y ON y.item = two.b, nb WHERE two.n >= ceil(0.005 * t) AND two.n::DOUBLE / x.n >= 0.2
    UNION ALL
    SELECT three.a || ',' || three.b, three.c, three.n::DOUBLE / p.n, (three.n::DOUBLE / p.n) / (y.n::DOUBLE / t), three.n::DOUBLE / t, three.a, three.b
    FROM three JOIN two p ON p.a = three.a AND p.b = three.b JOIN one y ON y.item = three.c, nb
    WHERE three.n >= ceil(0.005 * t) AND three.n::DOUBLE / p.n >= 0.2)"""
add(
    "m19_product_rules",
    lambda s, d: models.association_rules(_affinity(s, d)[0]),
    over_events(
        "SELECT antecedent, consequent, round(cf, 6) AS confidence, round(lf, 6) AS lift, round(sp, 6) AS support FROM ru",
        AFFINITY,
    ),
)
add(
    "m20_related_products",
    lambda s, d: models.related_products(models.association_rules(_affinity(s, d)[0]), adapter.products(s, d)),
    over_events(
        """, sg AS (SELECT p1 AS product_id, consequent AS related_id, cf FROM ru UNION ALL SELECT p2, consequent, cf FROM ru WHERE p2 IS NOT NULL),
        mx AS (SELECT product_id, related_id, max(round(cf, 6)) AS sc FROM sg GROUP BY 1, 2),
        rk AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sc DESC, related_id) AS rank FROM mx QUALIFY rank <= 5)
        SELECT rk.product_id, related_id, name, category, price, round(sc, 3) AS score, rank FROM rk JOIN prod ON prod.product_id = related_id""",
        PRODUCTS_SQL + AFFINITY,
    ),
)
