"""Token budgets and prompt texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.text import count_tokens, python_repr, trim_tokens
from passagekit.schemas import MAX_CONTEXT, context_lengths

Tokenizer = Callable[[], object] | None


def context_budget(df: DataFrame, llm_col: str = "llm", system: str | Column = "", assistant: str | Column = "", share: float = 0.5,
                   default: int | None = MAX_CONTEXT, tokenizer: Tokenizer = None, max_context: int | None = None) -> DataFrame:
    """Add input_budget, output_budget and `over_budget`.

    Half of the model's context is for the answer; the system and assistant texts come off the
    other half. An input budget below zero becomes 0 and is flagged. The context is `max_context` if given, else that of
    the table of models, else `default`. The texts may be columns.
    """
    limits = F.broadcast(context_lengths(df.sparkSession).withColumnRenamed("model", "_model"))
    joined = df.join(limits, df[llm_col] == limits["_model"], "left").drop("_model")
    context = F.lit(max_context) if max_context is not None else F.coalesce("max_context", F.lit(default))
    share_tokens = F.floor(context * share).cast("int")
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (system, assistant)]
    used = F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    spare = share_tokens - count_tokens(used, tokenizer)
    return joined.select(
        *df.columns,
        F.greatest(spare, F.lit(0)).alias("input_budget"),
        share_tokens.alias("output_budget"),
        (spare < 0).alias("over_budget"),
    )


def messages(system: Column, assistant: Column, user: Column) -> Column:
    """Role and content pairs, without the empty ones."""
    pairs = F.array(*(
        F.struct(F.lit(role).alias("role"), content.alias("content"))
        for role, content in (("system", system), ("assistant", assistant), ("user", user))
    ))
    return F.filter(pairs, lambda m: F.coalesce(F.length(m["content"]) > 0, F.lit(False)))


def user_content(query: Column, context: Column) -> Column:
    """Question and context as the models are asked. The context is a list of texts or of chunk structs."""
    return F.concat(F.lit("query: "), query, F.lit(", context: "), python_repr(context))


def build_prompt(df: DataFrame, query_col: str = "query", context_col: str = "texts", system: str = "",
                 assistant: str = "", budget_col: str | None = "input_budget", tokenizer: Tokenizer = None,
                 into: str = "prompt") -> DataFrame:
    """Add the prompt: the user text trimmed to its budget, after the system and assistant texts."""
    user = user_content(F.col(query_col), F.col(context_col))
    if budget_col:
        user = trim_tokens(user, F.col(budget_col), tokenizer)
    parts = messages(F.lit(system), F.lit(assistant), user)
    return df.withColumn(into, F.array_join(F.transform(parts, lambda m: m["content"]), " "))
