"""Score answers against references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.text import count_tokens, parse_judge_lines, python_repr, trim_tokens
from passagekit.functions.uris import uri_page
from passagekit.operators.generation import generate


def align(references: DataFrame, responses: DataFrame, key: str = "qid") -> DataFrame:
    """Pair references and responses by key; any unpaired or differing question stops the job.

    Columns: key, question, reference_answer, reference_source, generated_answer, sources.
    """
    left = references.select(
        F.col(key), F.col("question").alias("_asked"), F.col("answer").alias("reference_answer"),
        F.col("source").alias("reference_source"), F.lit(True).alias("_left"))
    right = responses.select(
        F.col(key), F.col("question").alias("_answered"), F.col("answer").alias("generated_answer"),
        "sources", F.lit(True).alias("_right"))
    pairs = left.join(right, key, "full_outer")
    problem = (
        F.when(F.col("_left").isNull(), "response without reference: ")
        .when(F.col("_right").isNull(), "reference without response: ")
        .when(~F.col("_asked").eqNullSafe(F.col("_answered")), "questions differ: ")
    )
    where = F.coalesce(F.col(key).cast("string"), F.lit("?"))

    def checked(name: str, kind: str = "string") -> Column:
        """The check sits in every column, so that no choice of columns leaves it out."""
        stop = F.raise_error(F.concat(problem, where)).cast(kind)
        return F.when(problem.isNotNull(), stop).otherwise(F.col(name))

    return pairs.select(
        key, checked("_asked").alias("question"), *(checked(n).alias(n) for n in ("reference_answer", "reference_source", "generated_answer")),
        checked("sources", "array<string>").alias("sources"))


def alignment_problems(references: DataFrame, responses: DataFrame, key: str = "qid") -> DataFrame:
    """One row: pairs, references without response, responses without reference, differing questions."""
    left = references.select(F.col(key), F.col("question").alias("_asked"), F.lit(True).alias("_left"))
    right = responses.select(F.col(key), F.col("question").alias("_answered"), F.lit(True).alias("_right"))
    pairs = left.join(right, key, "full_outer")
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    return pairs.agg(
        F.count_if(both).alias("pairs"),
        F.count_if(F.col("_right").isNull()).alias("without_response"),
        F.count_if(F.col("_left").isNull()).alias("without_reference"),
        F.count_if(both & ~F.col("_asked").eqNullSafe(F.col("_answered"))).alias("differing"),
    )


def is_retrieved(reference_source: Column, sources: Column) -> Column:
    """Whether a source lies on the reference's page; an empty reference counts as found."""
    page = uri_page(reference_source)
    found = F.exists(sources, lambda s: uri_page(s) == page)
    return F.when(F.coalesce(page, F.lit("")) == "", True).otherwise(F.coalesce(found, F.lit(False)))


def retrieval_score(pairs: DataFrame) -> DataFrame:
    """One row: the share of questions whose page was retrieved."""
    return pairs.agg(F.avg(is_retrieved(F.col("reference_source"), F.col("sources")).cast("int")).alias("retrieval_score"))


def judge_prompt(pairs: DataFrame, system: str = "", assistant: str = "", max_context: int = 8192,
                 tokenizer: Callable[[], object] | None = None) -> DataFrame:
    """Add `prompt`: question, generated and reference answer, trimmed to the whole context length."""
    budget = F.lit(max_context) - count_tokens(F.lit(system + assistant), tokenizer)
    body = python_repr(F.struct(
        "question", F.col("generated_answer"), F.col("reference_answer")))
    user = trim_tokens(body, budget, tokenizer)
    fixed = [F.lit(part) for part in (system, assistant) if part]
    return pairs.withColumn("prompt", F.concat_ws(" ", *fixed, F.when(F.length(user) > 0, user)))


def judge(pairs: DataFrame, factory: Callable[..., object], system: str = "", assistant: str = "",
          max_context: int = 8192, tokenizer: Callable[[], object] | None = None, **options: object) -> DataFrame:
    """Add score, reasoning and score_error from a judging model."""
    prompted = judge_prompt(pairs, system, assistant, max_context, tokenizer)
    answered = generate(prompted, factory, into="_verdict", **options)
    parsed = answered.withColumn("_parsed", parse_judge_lines(F.col("_verdict")))
    kept = [c for c in pairs.columns]
    return parsed.select(
        *kept, F.col("_parsed.score").alias("score"), F.col("_parsed.reasoning").alias("reasoning"),
        F.coalesce("error", "_parsed.error").alias("score_error"))


def quality_score(results: DataFrame) -> DataFrame:
    """One row: the mean score of answered references, leaving out score 0 and empty references."""
    counts = (F.col("score") != 0) & (F.length("reference_answer") > 0)
    return results.agg(F.avg(F.when(counts, F.col("score"))).alias("quality_score"))


def both_scores(results: DataFrame) -> DataFrame:
    """Retrieval and quality score in one pass."""
    counts = (F.col("score") != 0) & (F.length("reference_answer") > 0)
    return results.agg(
        F.avg(is_retrieved(F.col("reference_source"), F.col("sources")).cast("int")).alias("retrieval_score"),
        F.avg(F.when(counts, F.col("score"))).alias("quality_score"),
    )
