"""Grouped folds, error measures, and training with out-of-fold predictions."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of the tree learner reads.
PART_ROWS = 50_000


def fold_map(df: DataFrame, n_splits: int = 5, seed: int = 42, key: str = "well") -> DataFrame:
    """``key, fold``: sorted distinct keys, shuffled with NumPy's legacy generator, dealt in turn.

    The exact shuffle is sequential, so the distinct keys pass through the
    driver; a well has thousands of rows, its key is one.
    """
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).toLocalIterator()]
    np.random.RandomState(seed).shuffle(keys)
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame([(k, i % n_splits) for i, k in enumerate(keys)], f"{key} {kind}, fold int")


def with_folds(df: DataFrame, folds: DataFrame, key: str = "well") -> DataFrame:
    return df.join(folds, key)


def stratified_folds(wells: DataFrame, difficulty: str, n_splits: int = 5, bins: int = 5, key: str = "well") -> DataFrame:
    """Folds dealt in turn within quantile bins of a difficulty; ``wells`` has a row per well."""
    bin_ = F.ntile(bins).over(Window.partitionBy(F.lit(0)).orderBy(difficulty, key))
    turn = (F.row_number().over(Window.partitionBy("bin").orderBy(difficulty, key)) - 1) % n_splits
    return wells.select(key, difficulty, bin_.alias("bin")).select(key, "bin", turn.cast("int").alias("fold"))


def rmse(y: str, p: str, where: Column | None = None) -> Column:
    """Root mean squared error, over rows that ``where`` selects; NULL over none."""
    e = (F.col(y) - F.col(p)) ** 2
    return F.sqrt(F.avg(F.when(where, e) if where is not None else e))


def target_encode(df: DataFrame, category: str, target: str, fold: str = "fold", out: str = "encoded") -> DataFrame:
    """Mean target of a category over the other folds; the overall mean of the others where it is not there."""
    sums = df.groupBy(category, fold).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    total = sums.groupBy(category).agg(F.sum("__s").alias("__sum"), F.sum("__n").alias("__count"))
    folds = df.groupBy(fold).agg(F.sum(target).alias("__fs"), F.count(target).alias("__fn"))
    all_ = folds.select(fold, ((F.sum("__fs").over(Window.partitionBy(F.lit(0))) - F.col("__fs")) / (F.sum("__fn").over(Window.partitionBy(F.lit(0))) - F.col("__fn"))).alias("__all"))
    rest = F.when(F.col("__count") > F.col("__n"), (F.col("__sum") - F.col("__s")) / (F.col("__count") - F.col("__n")))
    table = sums.join(total, category).join(all_, fold).select(category, fold, F.coalesce(rest, F.col("__all")).alias(out))
    return df.join(table, [category, fold], "left")


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """A vector of features; a missing one becomes 0 with an indicator beside it."""
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__v_{c}") for c in features], *[F.col(c).isNull().cast("double").alias(f"__m_{c}") for c in features])
    names = [f"__{p}_{c}" for p in "vm" for c in features]
    return VectorAssembler(inputCols=names, outputCol=out).transform(filled).drop(*names)


def out_of_fold(train: DataFrame, features: list[str], target: str, folds: DataFrame, test: DataFrame | None = None, ids: tuple[str, ...] = ("well", "row_idx"), residual_to: str | None = None, rounds: list[int] | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """Gradient-boosted trees per fold: predictions of each row by the model that did not see its well, and the mean over folds for ``test``.

    With ``residual_to`` the target is relative to that column, which is added
    back. Early stopping watches the held-out fold; the trees that each fold's
    model kept are added to ``rounds``.
    """
    offset = F.col(residual_to) if residual_to else F.lit(0.0)
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42, "maxBins": 64} | options
    rows = assembled(with_folds(train, folds).filter(F.col(target).isNotNull()), features).withColumn("__y", F.col(target) - offset).cache()
    ready = assembled(test, features).cache() if test is not None else None  # each fold's model reads it
    rounds = [] if rounds is None else rounds
    learner = GBTRegressor(featuresCol="features", labelCol="__y", validationIndicatorCol="__held", **settings)
    ks = sorted(r[0] for r in folds.select("fold").distinct().collect())
    # A tree is many short jobs: rows lie in parts that are worth a task each, and folds are fitted side by side, each as it would be alone.
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    dealt = rows.coalesce(parts)
    with ThreadPool(len(ks) or 1) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(lambda k: learner.fit(dealt.withColumn("__held", F.col("fold") == k))), ks)
    rounds.extend(m.getNumTrees for m in models)
    oof = [m.transform(rows.filter(F.col("fold") == k)).select(*ids, (F.col("prediction") + offset).alias("tvt_pred"), target, F.col("TVT_input").isNull().alias("is_hidden"), "fold") for k, m in zip(ks, models, strict=True)]
    preds = [m.transform(ready).select(*ids, (F.col("prediction") + offset).alias("pred"), F.col("TVT_input").isNull().alias("is_hidden")) for m in models] if ready is not None else []
    mean = reduce(DataFrame.unionByName, preds).groupBy(*ids).agg(F.avg("pred").alias("tvt_pred"), F.bool_or("is_hidden").alias("is_hidden")) if preds else None
    return reduce(DataFrame.unionByName, oof), mean


def train_run(train: DataFrame, test: DataFrame, features: list[str], target: str, folder: str, seeds: tuple[int, ...] = (42,), n_splits: int = 5, pseudo: bool = False, **options) -> dict[str, float]:
    """A whole training run: out-of-fold and test predictions, averaged over ``seeds``, written below ``folder`` as ``oof`` and ``test``.

    With ``pseudo`` a second round trains on the test rows too, with their
    predictions of the first as targets, and its test predictions are written.
    Returns the error over all rows and over hidden ones, and the mean number
    of trees kept, cut to a whole number.
    """
    kept: list[int] = []
    made = [out_of_fold(train, features, target, fold_map(train, n_splits, s), test, rounds=kept, **options) for s in seeds]
    union = lambda k: reduce(DataFrame.unionByName, [m[k] for m in made])
    oof = union(0).groupBy("well", "row_idx").agg(F.avg("tvt_pred").alias("tvt_pred"), F.first(target).alias(target), F.bool_or("is_hidden").alias("is_hidden"))
    preds = union(1).groupBy("well", "row_idx").agg(F.avg("tvt_pred").alias("tvt_pred"), F.bool_or("is_hidden").alias("is_hidden"))
    oof.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/oof")
    preds.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/test")
    if pseudo:
        first = train.sparkSession.read.parquet(f"{folder}/test")
        more = pseudo_labelled(train, first, test, target)
        again = [out_of_fold(more, features, target, fold_map(more, n_splits, s), test, **options)[1] for s in seeds]
        last = reduce(DataFrame.unionByName, again).groupBy("well", "row_idx").agg(F.avg("tvt_pred").alias("tvt_pred"), F.bool_or("is_hidden").alias("is_hidden"))
        last.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/test_pseudo")
    r = train.sparkSession.read.parquet(f"{folder}/oof").agg(rmse(target, "tvt_pred").alias("all"), rmse(target, "tvt_pred", F.col("is_hidden")).alias("hidden")).first()
    return {"rmse": r["all"], "rmse_hidden": r["hidden"], "mean_best_iter": int(np.mean(kept))}


def multi_seed(df: DataFrame, seeds: list[int], n_splits: int = 5, key: str = "well") -> DataFrame:
    """``key, seed, fold`` for several seeds."""
    return reduce(DataFrame.unionByName, [fold_map(df, n_splits, s, key).withColumn("seed", F.lit(s)) for s in seeds])


def pseudo_labelled(train: DataFrame, test_predictions: DataFrame, test: DataFrame, target: str, ids: tuple[str, ...] = ("well", "row_idx")) -> DataFrame:
    """Training rows and test rows with their predictions as targets."""
    labelled = test.drop(target).join(test_predictions.select(*ids, F.col("tvt_pred").alias(target)), list(ids))
    return train.unionByName(labelled, allowMissingColumns=True)


def adversarial_auc(train: DataFrame, test: DataFrame, features: list[str]) -> float:
    """How well train and test rows can be told apart: area under the ROC curve, 0.5 for not at all."""
    both = train.select(*features).withColumn("is_test", F.lit(0.0)).unionByName(test.select(*features).withColumn("is_test", F.lit(1.0)))
    rows = assembled(both, features)
    model = LogisticRegression(featuresCol="features", labelCol="is_test", maxIter=50).fit(rows)
    return float(BinaryClassificationEvaluator(labelCol="is_test").evaluate(model.transform(rows)))


def predictions_for(ids: DataFrame, predictions: DataFrame, default: float | Column = 0.0, key: str = "id", value: str = "tvt") -> DataFrame:
    """Each wanted id with its prediction, or the default."""
    return ids.select(key).join(predictions.select(key, value), key, "left").select(key, F.coalesce(F.col(value), default if isinstance(default, Column) else F.lit(default)).alias(value))


def id_mismatch(ids: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Ids of one side only; empty when both sets are equal."""
    return ids.select(key).exceptAll(predictions.select(key)).union(predictions.select(key).exceptAll(ids.select(key)))
