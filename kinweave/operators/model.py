"""Match models on Spark ML: splits, boosted trees, calibration, out-of-fold scores."""

from __future__ import annotations

from math import floor

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_split(ids: DataFrame, val: float = 0.2, test: float = 0.2, calib: float = 0.25, seed: int = 7) -> DataFrame:
    """(e, split): test, val, calib and train_fit with exact sizes, by the order of a hash.

    Places come from counts of hash ranges and ranks within them, so that no task orders all ids.
    """
    n = ids.count()
    rows = ids.select("e", F.xxhash64(F.lit(seed), "e").alias("h")).withColumn("part", F.shiftright("h", 48))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))  # 65,536 at most
    at = rows.join(parts, "part").withColumn("at", F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy("h", "e")))
    n_test, n_val = floor(n * test), floor(n * val)
    n_calib = floor((n - n_test - n_val) * calib)
    name = F.when(F.col("at") <= n_test, "test").when(F.col("at") <= n_test + n_val, "val").when(F.col("at") <= n_test + n_val + n_calib, "calib").otherwise("train_fit")
    return at.select("e", name.alias("split"))


def prepared(pairs: DataFrame, features: list[str]) -> DataFrame:
    """A vector of the features: nulls as -1, with a column beside each that tells whether it was null."""
    filled = pairs.withColumns({f"__{f}": F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features} | {f"__{f}_null": F.col(f).isNull().cast("double") for f in features})
    cols = [f"__{f}" for f in features] + [f"__{f}_null" for f in features]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(filled).drop(*cols)


def balanced(pairs: DataFrame, mode: str = "scale") -> DataFrame:
    """Adds weight: "scale" raises true pairs to the sum of the false ones; "inv_count" gives each entity the same sum, 1 on average."""
    if mode == "inv_count":
        rows = pairs.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy("e")))
        total = rows.agg(F.count("*") / F.sum("weight")).first()[0]
        return rows.withColumn("weight", F.col("weight") * F.lit(total))
    neg, pos = pairs.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    return pairs.withColumn("weight", F.when(F.col("y") == 1, F.lit(float(neg or 1) / float(pos or 1))).otherwise(1.0))


def fit_trees(train: DataFrame, features: list[str], rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 7):
    data = prepared(train.withColumn("label", F.col("y").cast("double")), features)
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", weightCol="weight", seed=seed).fit(data)


def predict(model, pairs: DataFrame, features: list[str], out: str = "s") -> DataFrame:
    scored = model.transform(prepared(pairs, features)).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def fit_pairwise(train: DataFrame, features: list[str]):
    """A ranking model: logistic regression on the differences of a true and a false pair of one entity; both pairs of a hot entity meet only with its true ones."""
    rows = train.select("e", "y", *[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in features])
    pos, neg = rows.where("y = 1").drop("y"), rows.where("y = 0").drop("y")
    diff = pos.alias("p").join(neg.alias("n"), F.col("p.e") == F.col("n.e")).select(*[(F.col(f"p.{f}") - F.col(f"n.{f}")).alias(f) for f in features])
    both = diff.withColumn("label", F.lit(1.0)).unionByName(diff.select(*[(-F.col(f)).alias(f) for f in features]).withColumn("label", F.lit(0.0)))
    return LogisticRegression(fitIntercept=False, regParam=1e-3).fit(VectorAssembler(inputCols=features, outputCol="features").transform(both))


def calibrate(calib: DataFrame, scored: DataFrame, raw: str = "s", out: str = "s_cal", frozen: tuple[float, float] | None = None) -> DataFrame:
    """Isotonic calibration, clipped to 0..1, plus a millionth of the raw score's place in its range, which keeps the order of equal values.

    The range is that of the scored table, or ``frozen``.
    """
    model = IsotonicRegression(featuresCol=raw, labelCol="label").fit(calib.select(F.col(raw).cast("double"), F.col("y").cast("double").alias("label")))
    lo, hi = frozen or scored.agg(F.min(raw), F.max(raw)).first()
    fine = (F.col(raw) - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    return model.transform(scored).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))) + 1e-6 * fine).drop("prediction")


def folds(pairs: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Adds fold: all pairs of an entity in one."""
    return pairs.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "e"), F.lit(k)).cast("int"))


def oof_scores(pairs: DataFrame, features: list[str], k: int = 3, rounds: int = 10) -> DataFrame:
    """Adds oof: each fold's pairs scored by a model of the others."""
    parts = folds(pairs, k)
    out = None
    for i in range(k):
        one = predict(fit_trees(balanced(parts.where(F.col("fold") != i)), features, rounds=rounds), parts.where(F.col("fold") == i), features, "oof")
        out = one if out is None else out.unionByName(one)
    return out
