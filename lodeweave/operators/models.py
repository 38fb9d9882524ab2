"""Linear baselines on hashed character n-grams, with grouped folds for out-of-fold scores."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import hash_bucket

MODELS = {"logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01, weightCol="w"), "bayes": lambda: NaiveBayes(weightCol="w"), "svm": lambda: LinearSVC(maxIter=20, regParam=0.01, weightCol="w")}


def features(rows: DataFrame, text: str, size: int = 1 << 14) -> DataFrame:
    """Hashed counts of one to three characters as ``tf``."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")
    runs = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return HashingTF(numFeatures=size, inputCol="runs", outputCol="tf").transform(rows.withColumn("runs", F.concat(runs(1), runs(2), runs(3)))).drop("runs")


def scored(train: DataFrame, test: DataFrame, model: str = "logistic") -> DataFrame:
    """test with ``p``, the score of a model fitted on train (tf, label, w), TF-IDF weighted."""
    idf = IDF(inputCol="tf", outputCol="features").fit(train)
    fitted = MODELS[model]().fit(idf.transform(train))
    out = fitted.transform(idf.transform(test))
    if model == "svm":
        return out.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))).drop("features", "rawPrediction", "prediction")
    return out.withColumn("p", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, group: str, folds: int = 3, model: str = "logistic") -> DataFrame:
    """Each row scored by a model fitted on the other folds; a group lies in one fold."""
    folded = rows.withColumn("fold", hash_bucket(F.col(group).cast("string"), folds))
    out = None
    for k in range(folds):
        one = scored(folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k), model)
        out = one if out is None else out.unionByName(one)
    return out


def frozen(train: DataFrame, test: DataFrame, vector: str, width: int, model: str) -> DataFrame:
    """Test with ``p`` of a model on fixed vectors (an array column of that width): logistic, svm or perceptron. Rows with a NULL vector are left out."""
    as_features = lambda rows: rows.filter(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    chosen = MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=40, seed=1) if model == "perceptron" else MODELS[model]()
    out = chosen.fit(as_features(train)).transform(as_features(test))
    if model == "svm":
        return out.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))).drop("features", "rawPrediction", "prediction")
    return out.withColumn("p", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")
