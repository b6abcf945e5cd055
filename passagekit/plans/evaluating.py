"""Judge recorded answers and write the evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from passagekit.operators.evaluation import align, both_scores, judge
from passagekit.session import materialize
from passagekit.sources.records import write_evaluation


def evaluate(references: DataFrame, responses: DataFrame, factory: Callable[..., object], experiment: str,
             evaluator: str, path: str | None = None, system: str = "", assistant: str = "",
             max_context: int = 8192, **options: object) -> tuple[DataFrame, DataFrame]:
    """Results per question and one row with both scores; written too if a path is given.

    The judged rows are materialised once, so the model is not asked again for the scores.
    """
    judged = materialize(judge(align(references, responses), factory, system, assistant, max_context, **options))
    scores = both_scores(judged)
    if path:
        config = {"experiment_name": experiment, "evaluator": evaluator, "max_context_length": max_context,
                  "system_content": system, "assistant_content": assistant}
        write_evaluation(judged, scores, config, path)
    return judged, scores
