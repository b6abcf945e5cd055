"""Question classifiers: thresholded labels, soft-max over a user's model, training and routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.text import normalize_for_classifier
from passagekit.schemas import RERANK_THRESHOLD
from passagekit.session import materialize

OTHER = "other"
FEATURES = 1 << 12
# Words of a naive Bayes classifier; the driver and every task hold them.
VOCABULARY = 1 << 18


def label_with_threshold(probabilities: Column, labels: list[str], threshold: float = RERANK_THRESHOLD,
                         other: str = OTHER) -> Column:
    """The most probable label, the first one on a tie, or `other` below the threshold."""
    top = F.array_max(probabilities)
    names = F.array(*(F.lit(name) for name in labels))
    best = F.get(names, F.array_position(probabilities, top).cast("int") - 1)
    return F.when(top >= threshold, best).otherwise(F.lit(other))


Subwords = Callable[[Column], Column] | None


def fit_tag_classifier(training: DataFrame, text_col: str = "text", label_col: str = "label",
                       features: int = FEATURES, max_iter: int = 20, algorithm: str = "logistic",
                       subwords: Subwords = None) -> PipelineModel:
    """A classifier over normalised text. Save it with `model.write()`, load it with `PipelineModel.load`.

    `logistic`: hashed TF-IDF and logistic regression. `bayes`: multinomial naive Bayes over the counts of the `VOCABULARY` most
    frequent words; its weights are a table (`classifier_weights`) that a join can score with. `subwords` maps the normalised
    text to its sub-word tokens, joined by blanks; classify with the same one. Rows without a label or with a NULL text are left out.

    The normalised texts are written once, since every stage of the pipeline reads them again.
    """
    prepared = materialize(training.select(
        normalize_for_classifier(F.col(text_col), subwords).alias("text"), F.col(label_col).cast("string").alias("label")).dropna())
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+")
    target = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep")
    if algorithm == "bayes":
        return Pipeline(stages=[
            words, CountVectorizer(inputCol="words", outputCol="features", vocabSize=VOCABULARY), target,
            NaiveBayes(labelCol="target", featuresCol="features", modelType="multinomial"),
        ]).fit(prepared)
    return Pipeline(stages=[
        words,
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        target,
        LogisticRegression(labelCol="target", featuresCol="features", maxIter=max_iter),
    ]).fit(prepared)


def _labels(model: PipelineModel) -> list[str]:
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    return list(indexer.labelsArray[0])


def classify_with_threshold(df: DataFrame, model: PipelineModel, text_col: str = "query",
                            threshold: float = RERANK_THRESHOLD, other: str = OTHER, into: str = "predicted",
                            subwords: Subwords = None, probabilities: str | None = None) -> DataFrame:
    """Add the thresholded label and its probability; with `probabilities`, all of them under that name in the order of the labels."""
    names = _labels(model)
    scoring = PipelineModel([s for s in model.stages if not hasattr(s, "labelsArray")])
    prepared = df.withColumn("_text", F.col(text_col))
    renamed = prepared.select(*df.columns, normalize_for_classifier(F.col("_text"), subwords).alias("_normal"))
    columns = [F.col(c).alias(f"_in_{c}") for c in df.columns]
    scored = scoring.transform(renamed.select(*columns, F.coalesce("_normal", F.lit("")).alias("text")))
    chances = F.slice(vector_to_array("probability"), 1, len(names))
    every = [chances.alias(probabilities)] if probabilities else []
    return scored.select(
        *(F.col(f"_in_{c}").alias(c) for c in df.columns),
        label_with_threshold(chances, names, threshold, other).alias(into),
        F.array_max(chances).alias(f"{into}_probability"), *every,
    )


def classifier_weights(model: PipelineModel) -> DataFrame:
    """The weights of a `bayes` classifier: term (NULL: the class itself), weights (one per label in alphabetical order).

    At most `VOCABULARY` rows, which the model's own vocabulary bounds.
    """
    spark = SparkSession.getActiveSession()
    bayes = next(s for s in model.stages if hasattr(s, "theta"))
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    weights = np.column_stack([bayes.pi.toArray(), bayes.theta.toArray()]).T
    return spark.createDataFrame(pa.table({
        "term": pa.array([None, *vocabulary], pa.string()), "weights": pa.array(list(weights), pa.list_(pa.float64()))}))


def score_with_weights(df: DataFrame, weights: DataFrame, key: str, text_col: str = "query", subwords: Subwords = None) -> DataFrame:
    """key and `probabilities` by joins alone: the words of each text are counted, meet the weights and are summed per key.

    The weights are broadcast, as the vocabulary bounds them. Keys must be unique; a text without known words has the classes' own chances.
    """
    words = F.split(F.lower(normalize_for_classifier(F.coalesce(text_col, F.lit("")), subwords)), r"\s+")
    counted = df.select(F.col(key).alias("_key"), F.explode(words).alias("term")).groupBy("_key", "term").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("weights")
    known = counted.join(F.broadcast(weights.where("term IS NOT NULL")), "term").select(
        "_key", F.posexplode(F.transform("weights", lambda w: w * F.col("n"))).alias("label", "part"))
    sums = known.groupBy("_key", "label").agg(F.sum("part").alias("score"))
    chances = F.broadcast(weights.where("term IS NULL").select(F.posexplode("weights").alias("label", "prior"), size.alias("labels")))
    every = df.select(F.col(key).alias("_key")).join(chances).join(sums, ["_key", "label"], "left")
    logits = every.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(
        "label", (F.col("prior") + F.coalesce("score", F.lit(0.0))).alias("logit")))).alias("logits"))
    return logits.select(F.col("_key").alias(key), softmax(F.col("logits.logit")).alias("probabilities"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest so that nothing overflows."""
    shifted = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda v: v / total)


def logits_of(text: Column, factory: Callable[..., object], batch_size: int = 100, **options: object) -> Column:
    """Logits of a user's model, built once per partition; it maps a list of texts to rows of numbers."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory(**options)
        for texts in batches:
            values = [t or "" for t in texts.to_pylist()]
            rows: list = []
            for start in range(0, len(values), batch_size):
                rows.extend(np.asarray(r, dtype=np.float64) for r in model(values[start:start + batch_size]))
            yield pa.array(rows, pa.list_(pa.float64()))

    return run.asNondeterministic()(text)


def softmax_classify(df: DataFrame, text_col: str, factory: Callable[..., object], labels: list[str],
                     preprocess: Callable[[Column], Column] = lambda c: c, threshold: float = 0.0,
                     into: str = "predicted", **options: object) -> DataFrame:
    """Add `probabilities` and the label of a user's model."""
    scored = df.withColumn("_logits", logits_of(preprocess(F.col(text_col)), factory, **options))
    probable = scored.withColumn("probabilities", softmax(F.col("_logits"))).drop("_logits")
    return probable.withColumn(into, label_with_threshold(F.col("probabilities"), labels, threshold))


def fit_router(training: DataFrame, text_col: str = "text", label_col: str = "label", **settings: object) -> PipelineModel:
    """A yes/no classifier: label 1 means that the cheap model is good enough."""
    return fit_tag_classifier(training, text_col, label_col, **settings)


def route(questions: DataFrame, router: PipelineModel, cheap: str, strong: str, query_col: str = "query",
          into: str = "llm") -> DataFrame:
    """Add the model that shall answer."""
    routed = classify_with_threshold(questions, router, query_col, 0.0, into="_route")
    return routed.withColumn(into, route_model(F.col("_route"), cheap, strong)).drop("_route", "_route_probability")


def route_model(good_enough: Column, cheap: str, strong: str) -> Column:
    """The cheap model where the router's output is truthy."""
    return F.when(F.coalesce(good_enough.cast("string").try_cast("double") > 0, F.lit(False)), cheap).otherwise(strong)
