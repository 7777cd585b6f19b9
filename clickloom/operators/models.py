"""MLlib models: recommendations, segments, purchase prediction, patterns.

Only scores (a few numbers) reach the driver; predictions stay DataFrames.
"""

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    ClusteringEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.functions.values import ratio
from clickloom.session import shared_dir
from clickloom.sources import lake

SEED = 42


@contextmanager
def kept_in_memory(df: DataFrame):
    """Persist a frame while several passes read it; blocks spill to disk."""
    kept = lake.keep(df)
    try:
        yield kept
    finally:
        kept.unpersist()


def split_by_key(rows: DataFrame, keys: list[str], share: float) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key and the seed: a row stays in its part however often it is recomputed."""
    spot = F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(10_000))
    first = spot < int(share * 10_000)
    return rows.where(first), rows.where(~first)


def dense_index(ids: DataFrame, column: str, index: str, buckets: int = 4096) -> DataFrame:
    """Number distinct ids 0, 1, 2, … without passing them through one task.

    Ids are numbered inside hash buckets; only the bucket sizes are ordered
    globally to give each bucket its offset.  The result depends on the ids
    alone, so a recomputed task numbers them the same way.
    """
    bucketed = (
        ids.select(column).where(F.col(column).isNotNull()).distinct()
        .withColumn("_b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    )
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return (
        bucketed.withColumn("_place", place)
        .join(offsets, "_b")
        .select(column, (F.col("_offset") + F.col("_place") - 1).cast("int").alias(index))
    )


@dataclass
class Recommender:
    """A fitted ALS model with the id tables it was trained on, all under one folder."""

    als: ALSModel
    users: DataFrame
    products: DataFrame
    path: str

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Recommender":
        return Recommender(
            ALSModel.load(f"{path}/als"),
            spark.read.parquet(f"{path}/users"),
            spark.read.parquet(f"{path}/products"),
            path,
        )


def fit_als(
    ratings: DataFrame, path: str | None = None, rank: int = 10, max_iter: int = 10, reg: float = 0.1
) -> tuple[Recommender, float]:
    """Fit ALS on 80 % of the ratings; returns the saved model and its RMSE on the rest.

    ALS wants small integer ids.  Hashing ids into a range would merge
    different users and StringIndexer would hold every id on the driver, so the
    ids are numbered by dense_index().  The ratings and both id tables are
    written once under ``path``, and every later pass reads them.
    """
    spark = ratings.sparkSession
    path = path or shared_dir(spark, "als")
    ratings.select("user_id", "product_id", "rating").write.mode("overwrite").parquet(f"{path}/ratings")
    kept = spark.read.parquet(f"{path}/ratings")
    dense_index(kept, "user_id", "user_idx").write.mode("overwrite").parquet(f"{path}/users")
    dense_index(kept, "product_id", "product_idx").write.mode("overwrite").parquet(f"{path}/products")
    users, products = spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/products")
    indexed = kept.join(users, "user_id").join(products, "product_id").select(
        "user_idx", "product_idx", F.col("rating").cast("float").alias("rating")
    )
    als = ALS(
        rank=rank, maxIter=max_iter, regParam=reg, seed=SEED,
        userCol="user_idx", itemCol="product_idx", ratingCol="rating",
        coldStartStrategy="drop",
    )
    with kept_in_memory(indexed) as stable:
        train, test = split_by_key(stable, ["user_idx", "product_idx"], 0.8)
        fitted = als.fit(train)
        rmse = RegressionEvaluator(metricName="rmse", labelCol="rating").evaluate(fitted.transform(test))
    fitted.write().overwrite().save(f"{path}/als")
    return Recommender(fitted, users, products, path), rmse


def als_top_n(
    model: Recommender,
    n: int = 10,
    users: DataFrame | None = None,
    products: DataFrame | None = None,
) -> DataFrame:
    """Best products per user, for all users or the given ``user_id`` rows."""
    if users is None:
        lists = model.als.recommendForAllUsers(n)
    else:
        wanted = users.join(model.users, "user_id").select("user_idx")
        lists = model.als.recommendForUserSubset(wanted, n)
    flat = lists.select("user_idx", F.posexplode("recommendations").alias("pos", "r")).select(
        "user_idx", (F.col("pos") + 1).alias("rank"), "r.product_idx", F.col("r.rating").alias("score")
    )
    named = flat.join(model.users, "user_idx").join(model.products, "product_idx")
    out = named.select("user_id", "product_id", "score", "rank")
    if products is not None:
        out = out.join(products.select("product_id", "name", "category", "price"), "product_id", "left")
    return out


def similar_items(model: Recommender, product_ids: list[str], n: int = 10) -> DataFrame:
    """Products with the largest factor product to each requested one.

    The request is a short list from the caller; its factors reach the tasks as
    one scalar array, so all other factors are scanned once without a shuffle.
    """
    names = model.products.select(F.col("product_idx").alias("id"), F.col("product_id").alias("similar_id"))
    factors = model.als.itemFactors.join(names, "id").select("similar_id", "features")
    asked = factors.where(F.col("similar_id").isin(*product_ids))
    targets = asked.agg(
        F.collect_list(F.struct(F.col("similar_id").alias("product_id"), F.col("features").alias("own")))
    ).scalar()
    pairs = factors.withColumn("targets", targets).select("similar_id", "features", F.inline("targets"))
    products = F.zip_with("features", "own", lambda a, b: a.cast("double") * b.cast("double"))
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    best = Window.partitionBy("product_id").orderBy(F.desc("similarity"), "similar_id")
    return (
        pairs.where(F.col("product_id") != F.col("similar_id"))
        .select("product_id", "similar_id", score.alias("similarity"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
    )


def fit_segments(
    features: DataFrame,
    columns: list[str],
    k: int = 3,
    max_iter: int = 20,
    scaled: bool = False,
    path: str | None = None,
) -> PipelineModel:
    """K-Means over assembled features; the scaler is part of the saved pipeline."""
    vector = "raw_features" if scaled else "features"
    stages = [VectorAssembler(inputCols=columns, outputCol=vector)]
    if scaled:
        stages.append(
            StandardScaler(inputCol=vector, outputCol="features", withMean=True, withStd=True)
        )
    stages.append(KMeans(k=k, seed=SEED, maxIter=max_iter, predictionCol="segment"))
    model = Pipeline(stages=stages).fit(features)
    if path:
        model.write().overwrite().save(path)
    return model


def assign_segments(model: PipelineModel, features: DataFrame) -> DataFrame:
    """user → segment, to be stored as the user_segments table."""
    return model.transform(features).select("user_id", "segment")


def silhouette(model: PipelineModel, features: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="segment").evaluate(model.transform(features))


def segment_stats(model: PipelineModel, features: DataFrame, columns: list[str], digits: int | None = 4) -> DataFrame:
    """Size and feature means of every segment; ``digits=None`` leaves the means unrounded, for totals."""
    means = [(F.avg(c) if digits is None else F.round(F.avg(c), digits)).alias(f"avg_{c}") for c in columns]
    return model.transform(features).groupBy("segment").agg(F.count("*").alias("users"), *means)


def segment_centres(model: PipelineModel, spark) -> DataFrame:
    """Cluster centres as rows."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return spark.createDataFrame(rows, "segment int, centre array<double>")


def best_segments(
    features: DataFrame, columns: list[str], choices=range(2, 7)
) -> tuple[PipelineModel, int, dict[int, float]]:
    """The k with the best silhouette; the features are kept while the fits run."""
    with kept_in_memory(features) as stable:
        fits = {k: fit_segments(stable, columns, k) for k in choices}
        scores = {k: silhouette(model, stable) for k, model in fits.items()}
    best = max(scores, key=lambda k: scores[k])
    return fits[best], best, scores


def label_segments(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Name every cluster by its mean behaviour."""
    means = {
        "avg_spend": "total_spend",
        "avg_cart_adds": "cart_adds",
        "avg_categories": "categories_viewed",
        "avg_purchase_freq": "purchase_frequency",
        "avg_abandon_ratio": "cart_abandon_ratio",
        "avg_daily_activity": "daily_activity",
    }
    clusters = model.transform(features).groupBy("segment").agg(
        F.count("*").alias("users"), *[F.avg(c).alias(name) for name, c in means.items()]
    )
    return clusters.withColumn("segment_label", segment_label())


def segment_label():
    """The naming rules, over cluster means."""
    col = F.col
    return (
        F.when((col("avg_purchase_freq") > 0.5) & (col("avg_spend") > 1000), F.lit("High Value"))
        .when((col("avg_purchase_freq") > 0.2) & (col("avg_spend") > 500), F.lit("Regular Buyer"))
        .when((col("avg_cart_adds") > 10) & (col("avg_abandon_ratio") > 2), F.lit("Browser"))
        .when((col("avg_daily_activity") > 5) & (col("avg_categories") > 3), F.lit("Active Explorer"))
        .otherwise(F.lit("Occasional Visitor"))
    )


def _fit_and_score(estimator, sessions: DataFrame, columns: list[str], path: str | None):
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    with kept_in_memory(sessions.select("session_id", "label", *columns)) as stable:
        train, test = split_by_key(stable, ["session_id"], 0.7)
        model = Pipeline(stages=[assembler, estimator]).fit(train)
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(test))
    if path:
        model.write().overwrite().save(path)
    return model, auc


def fit_tree(sessions: DataFrame, columns: list[str], path: str | None = None):
    """Decision tree for purchase; returns the model and a one-row report."""
    tree = DecisionTreeClassifier(labelCol="label", maxDepth=5, maxBins=32, seed=SEED)
    model, auc = _fit_and_score(tree, sessions, columns, path)
    fitted = model.stages[-1]
    importance = [(c, float(v)) for c, v in zip(columns, fitted.featureImportances.toArray())]
    report = sessions.sparkSession.createDataFrame(
        [(float(auc), fitted.depth, fitted.numNodes, importance)],
        "auc double, depth int, nodes int, importances array<struct<feature:string,importance:double>>",
    )
    return model, report


def fit_logistic(sessions: DataFrame, columns: list[str], path: str | None = None):
    """Logistic regression for purchase; returns the model and a one-row report."""
    logistic = LogisticRegression(labelCol="label", maxIter=100, regParam=0.01)
    model, auc = _fit_and_score(logistic, sessions, columns, path)
    fitted = model.stages[-1]
    weights = [(c, float(v)) for c, v in zip(columns, fitted.coefficients.toArray())]
    report = sessions.sparkSession.createDataFrame(
        [(float(auc), float(fitted.intercept), weights)],
        "auc double, intercept double, coefficients array<struct<feature:string,weight:double>>",
    )
    return model, report


def purchase_probability(model: PipelineModel, sessions: DataFrame) -> DataFrame:
    """P(purchase) per session."""
    return model.transform(sessions).select(
        "session_id", "label", "prediction", vector_to_array("probability")[1].alias("probability")
    )


def fit_patterns(baskets: DataFrame, support: float, confidence: float, path: str | None = None):
    """FP-Growth over item arrays."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    if path:
        model.write().overwrite().save(path)
    return model


def frequent_patterns(model, baskets: DataFrame, n: int | None = 15) -> DataFrame:
    """Item sets of two or more, most frequent first."""
    total = baskets.agg(F.count("*")).scalar()
    items = F.array_join(F.array_sort("items"), ",")
    sets = model.freqItemsets.where(F.size("items") >= 2).select(
        items.alias("items"), F.col("freq").alias("frequency")
    )
    shared = sets.withColumn("support", F.round(ratio(F.col("frequency"), total), 4))
    return shared if n is None else shared.orderBy(F.desc("frequency"), "items").limit(n)


def association_rules(model) -> DataFrame:
    """Rules with MLlib's confidence, lift and support."""
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.array_sort("consequent").alias("consequent"),
        F.round("confidence", 6).alias("confidence"),
        F.round("lift", 6).alias("lift"),
        F.round("support", 6).alias("support"),
    )


def related_products(rules: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Products implied by each product, by best confidence, with their details."""
    single = rules.where(F.size("consequent") == 1).select(
        F.explode("antecedent").alias("product_id"),
        F.col("consequent")[0].alias("related_id"),
        "confidence",
    )
    scored = single.groupBy("product_id", "related_id").agg(F.max("confidence").alias("score"))
    best = Window.partitionBy("product_id").orderBy(F.desc("score"), "related_id")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    details = products.select(F.col("product_id").alias("related_id"), "name", "category", "price")
    return top.join(details, "related_id").select(
        "product_id", "related_id", "name", "category", "price", F.round("score", 3).alias("score"), "rank"
    )
