"""Writers for experiment records, evaluation records and the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluation_name(experiment: str, evaluator: str) -> str:
    """`experiment_evaluator`, the evaluator without its owner and in lower case."""
    return f"{experiment}_{evaluator.rsplit('/', 1)[-1].lower()}"


def config_column(config: dict) -> Column:
    """The configuration as one struct; values that are no plain scalar are kept as text."""
    plain = (str, int, float, bool)
    return F.struct(*(
        (F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k)
        for k, v in ((k, v if v is None or isinstance(v, plain) else str(v)) for k, v in config.items())
    )).alias("config")


def write_responses(results: DataFrame, config: dict, path: str) -> str:
    """Config as one row, results as rows beside it: `path/<experiment>/config` and `/results`."""
    target = f"{path.rstrip('/')}/{config['experiment_name']}"
    results.write.mode("overwrite").json(f"{target}/results")
    results.sparkSession.range(1).select(config_column(config)).write.mode("overwrite").json(f"{target}/config")
    return target


def write_evaluation(results: DataFrame, scores: DataFrame, config: dict, path: str) -> str:
    """Results as rows; config with both scores as one row."""
    target = f"{path.rstrip('/')}/{evaluation_name(config['experiment_name'], config['evaluator'])}"
    results.write.mode("overwrite").json(f"{target}/results")
    scores.select(config_column(config), "*").write.mode("overwrite").json(f"{target}/summary")
    return target


def log_events(answers: DataFrame, event: str, request: Column, *extra: str) -> DataFrame:
    """Log rows: ts, event, query, document_ids, llm, answer and any further columns asked for."""
    return answers.select(
        *extra, F.current_timestamp().alias("ts"), F.lit(event).alias("event"), request.alias("query"),
        "document_ids", "llm", "answer",
    )


def append_answer_log(answers: DataFrame, path: str, event: str = "finished streaming query",
                      request: Column | None = None) -> None:
    """Append one JSON event per answer."""
    request = F.col("question") if request is None else request
    log_events(answers, event, request).write.mode("append").json(path)
