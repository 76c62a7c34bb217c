"""A text classifier of hashed words and pairs, weighted for the rarer class."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline(features: int = 1 << 14) -> Pipeline:
    """tf-idf of words and pairs, then logistic regression."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    counts = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("words", "pairs")]
    weights = [IDF(inputCol=f"{c}_tf", outputCol=f"{c}_w", minDocFreq=2) for c in ("words", "pairs")]
    both = VectorAssembler(inputCols=["words_w", "pairs_w"], outputCol="features")
    return Pipeline(stages=[words, pairs, *counts, *weights, both, LogisticRegression(weightCol="weight", regParam=0.01, maxIter=20)])


def balanced(rows: DataFrame) -> DataFrame:
    """``rows`` (text, label) weighted so that both classes count alike."""
    counts = rows.groupBy("label").agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__all"))
    weighted = rows.join(F.broadcast(counts), "label").crossJoin(F.broadcast(total))
    return weighted.withColumn("weight", F.col("__all") / (2.0 * F.col("__n"))).drop("__n", "__all")


def held_out(rows: DataFrame, key: str) -> DataFrame:
    """(rows, right) over the half that was not fitted on, by a hash of the key; without both classes nothing is right."""
    half = F.pmod(F.xxhash64(key), F.lit(2))
    train, test = rows.where(half == 0), rows.where(half == 1)
    if train.select("label").distinct().count() < 2:
        return test.agg(F.count("*").alias("rows"), F.lit(None).cast("double").alias("right"))
    judged = pipeline().fit(balanced(train)).transform(test)
    return judged.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 2).alias("right"))
