"""Evaluation: metrics per prediction, sweeps over top-k, analysis of predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import metrics
from lodespark.functions import text as T

Metric = Callable[[Column, Column], Column]
METRICS: dict[str, Metric] = {"exact_match": lambda p, g: metrics.exact_match(p, g).cast("double"), "f1_score": metrics.token_f1}


def scored(predictions: DataFrame, calculators: dict[str, Metric] | None = None) -> DataFrame:
    """Predictions, once each, with a column per metric; further metrics plug in as functions of prediction and golds."""
    golds = metrics.gold_answers(F.col("ground_truth_answer"), F.col("ground_truth_aliases"))
    rows = predictions.dropDuplicates(["prediction_id"]).withColumn("golds", golds)
    return rows.select("*", *[m(F.col("predicted_answer"), F.col("golds")).alias(f"m_{name}") for name, m in (calculators or METRICS).items()])


def sweep(rows: DataFrame, names: list[str], by: str = "top_k") -> DataFrame:
    """Means per ``by`` over all rows of it: a metric that is missing counts as 0."""
    n = F.count(F.lit(1))
    means = [F.round(F.sum(F.coalesce(F.col(f"m_{m}"), F.lit(0.0))) / n, 6).alias(m) for m in names]
    time = F.round(F.sum(F.coalesce("processing_time", F.lit(0.0))) / n, 6).alias("avg_processing_time")
    return rows.groupBy(by).agg(n.alias("questions"), *means, time)


def analysis(rows: DataFrame) -> DataFrame:
    """(run_id, total, exact, mean_f1) of scored predictions."""
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("m_exact_match").cast("bigint")).alias("exact"), F.round(F.avg("m_f1_score"), 6).alias("mean_f1"))


def extremes(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` predictions of lowest and of highest token F1 (a top-k report; ties by id)."""
    picked = rows.select("prediction_id", F.round("m_f1_score", 6).alias("f1"))
    worst = picked.orderBy("f1", "prediction_id").limit(n).withColumn("side", F.lit("worst"))
    best = picked.orderBy(F.desc("f1"), "prediction_id").limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def long_results(swept: DataFrame, names: list[str], by: str = "top_k") -> DataFrame:
    """(by, metric, value): a sweep as a tidy table, as plots want it."""
    return swept.unpivot([by], names, "metric", "value")


def token_usage(rows: DataFrame) -> DataFrame:
    """Estimated prompt and answer tokens per top-k, and their mean per query."""
    used = T.token_estimate(F.col("question")) + T.token_estimate(F.col("predicted_answer"))
    n = F.count(F.lit(1))
    return rows.groupBy("top_k").agg(n.alias("queries"), F.sum(used).cast("bigint").alias("total_tokens"), F.round(F.sum(used) / n, 6).alias("avg_tokens"))


def rouge_metrics() -> dict[str, Metric]:
    """The ROUGE scores as metrics of their own."""
    return {name: (lambda p, g, name=name: metrics.rouge_scores(p, g)[name]) for name in ("rouge1", "rouge2", "rougeL")}


def wide_results(long: DataFrame, names: list[str], by: str = "top_k") -> DataFrame:
    """A tidy table as one row per ``by`` and one column per metric; metrics that a row lacks are null."""
    return long.groupBy(by).pivot("metric", names).agg(F.first("value"))


def report(rows: DataFrame, n: int = 5) -> DataFrame:
    """One row: total, exact matches, mean token F1, and the worst and best predictions (a top-k report)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("m_exact_match").cast("bigint")), F.lit(0)).alias("exact"), F.round(F.avg("m_f1_score"), 6).alias("mean_f1"))
    picked = extremes(rows, n)
    item = F.struct("f1", "prediction_id")
    sides = picked.agg(F.array_sort(F.collect_list(F.when(F.col("side") == "worst", item))).alias("worst"), F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") == "best", item)))).alias("best"))
    # One row each.
    return total.join(F.broadcast(sides), F.lit(True))
