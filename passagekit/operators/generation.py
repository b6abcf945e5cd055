"""Batch text generation through a user's model, and what it costs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Tuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.text import GENERATION_ERROR, STREAM_ERROR, UNKNOWN_OUTPUT
from passagekit.schemas import prices

_OUTPUT = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])


def generated_text(raw: object) -> str:
    """The text in a generator's output: a string, or a dictionary with `generated_text`."""
    if isinstance(raw, str):
        return raw
    if isinstance(raw, list) and raw:
        raw = raw[0]
    if raw is None:
        return STREAM_ERROR
    return raw["generated_text"] if isinstance(raw, dict) and "generated_text" in raw else UNKNOWN_OUTPUT


def _singly(model) -> Callable[[list], list]:
    """A model of one input as a model of lists; an input that fails has its exception as output."""
    def call(inputs: list) -> list:
        out = []
        for one in inputs:
            try:
                out.append(model(one))
            except Exception as problem:  # a failing model call must not fail the task
                out.append(problem)
        return out

    return call


def ask_all(model: Callable[[list], list], inputs: list, retries: int, wait: float, fallback: str,
            batch_size: int) -> list[dict[str, str | None]]:
    """Answers of a model that maps a list to a list, in rounds.

    A row fails if its output is an exception, and all rows of a call if the call raises or returns too few. The failed rows
    of all calls are sent again together, after one wait; the last repeat asks them one by one, so that a bad row
    does not take others along. What fails still gets the fallback and its error; a NULL input is not sent.
    """
    rows: list[dict[str, str | None]] = [{"answer": None, "error": "no prompt"} for _ in inputs]
    pending = [i for i, x in enumerate(inputs) if x is not None]
    for attempt in range(retries + 1):
        if attempt and pending:
            time.sleep(wait)
        size, failed = batch_size if attempt == 0 or attempt < retries else 1, []
        for start in range(0, len(pending), size):
            part = pending[start:start + size]
            try:
                outputs = list(model([inputs[i] for i in part]))
                if len(outputs) != len(part):
                    raise ValueError(f"{len(outputs)} outputs for {len(part)} inputs")
            except Exception as problem:
                outputs = [problem] * len(part)
            for i, raw in zip(part, outputs):
                if isinstance(raw, Exception):
                    rows[i] = {"answer": fallback, "error": f"{type(raw).__name__}: {raw}"}
                    failed.append(i)
                else:
                    rows[i] = {"answer": generated_text(raw), "error": None}
        pending = failed
    return rows


_ROWS = pa.struct([("answer", pa.string()), ("error", pa.string())])


def generate(df: DataFrame, factory: Callable[..., object], prompt_col: str = "prompt", max_retries: int = 0,
             retry_interval: float = 60.0, fallback: str = GENERATION_ERROR, partitions: int | None = None,
             into: str = "answer", batch_size: int | None = None, **options: object) -> DataFrame:
    """Add the answer and `error`.

    `factory(**options)` runs once per partition and returns a function from a prompt to a text or
    to `{"generated_text": ...}`; with `batch_size`, from a list of so many prompts at most to a list of these. A prompt may be a text or
    an array of (role, content). Rows that fail are sent again together (see `ask_all`); what keeps failing yields the fallback
    and its error. `partitions` spreads few, slow questions over more tasks. Temperature and the like are options.
    """

    @F.arrow_udf(_OUTPUT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory(**options)
        call = model if batch_size else _singly(model)
        for prompts in batches:
            yield pa.array(ask_all(call, prompts.to_pylist(), max_retries, retry_interval, fallback, batch_size or len(prompts) or 1), _ROWS)

    spread = df.repartition(partitions) if partitions else df
    out = spread.withColumn("_out", run.asNondeterministic()(F.col(prompt_col)))
    kept = [c for c in df.columns if c not in (into, "error")]
    return out.select(*kept, F.col("_out.answer").alias(into), F.col("_out.error").alias("error"))


def generate_by_name(df: DataFrame, factories: Mapping[str, Callable[..., object]], prompt_col: str = "prompt", llm_col: str = "llm",
                     max_tokens_col: str | None = "output_budget", max_retries: int = 0, retry_interval: float = 60.0,
                     fallback: str = GENERATION_ERROR, partitions: int | None = None, into: str = "answer",
                     batch_size: int | None = None, **options: object) -> DataFrame:
    """`generate` with the model that each row names.

    `factories[name](llm=name, **options)` runs once per partition that needs it and returns a function from a prompt and
    `max_tokens` to a text; with `batch_size`, from a list of prompts and one of `max_tokens` to a list of texts. A name without a
    factory yields the fallback and an error. The rows of one name in a batch are asked together.
    """
    @F.arrow_udf(_OUTPUT)
    def run(batches: Iterator[Tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        models: dict[str, Callable[[list], list]] = {}
        for prompts, names, budgets in batches:
            rows: list[dict[str, str | None]] = [{"answer": None, "error": "no prompt"} for _ in range(len(prompts))]
            asked: dict[str, list[tuple[int, tuple]]] = {}
            for i, (prompt, name, budget) in enumerate(zip(prompts.to_pylist(), names.to_pylist(), budgets.to_pylist())):
                if prompt is not None and name in factories:
                    asked.setdefault(name, []).append((i, (prompt, budget)))
                elif prompt is not None:
                    rows[i] = {"answer": fallback, "error": f"no model is named {name}"}
            for name, inputs in asked.items():
                if name not in models:
                    models[name] = _with_budgets(factories[name](llm=name, **options), batch_size)
                answers = ask_all(models[name], [x for _, x in inputs], max_retries, retry_interval, fallback, batch_size or len(inputs))
                for (i, _), row in zip(inputs, answers):
                    rows[i] = row
            yield pa.array(rows, _ROWS)

    spread = df.repartition(partitions) if partitions else df
    budget = F.col(max_tokens_col).cast("int") if max_tokens_col else F.lit(None).cast("int")
    out = spread.withColumn("_out", run.asNondeterministic()(F.col(prompt_col), F.col(llm_col), budget))
    kept = [c for c in df.columns if c not in (into, "error")]
    return out.select(*kept, F.col("_out.answer").alias(into), F.col("_out.error").alias("error"))


def _with_budgets(model, batch_size: int | None) -> Callable[[list], list]:
    if batch_size:
        return lambda inputs: model([prompt for prompt, _ in inputs], max_tokens=[budget for _, budget in inputs])
    return _singly(lambda one: model(one[0], max_tokens=one[1]))


def send_request(df: DataFrame, factory: Callable[..., object], prompt_col: str = "prompt", max_retries: int = 1,
                 retry_interval: float = 60.0, **options: object) -> DataFrame:
    """`generate` as a remote service is called: one repeat of the rows that failed, then an empty answer."""
    return generate(df, factory, prompt_col, max_retries, retry_interval, "", **options)


def price_key(llm: Column) -> Column:
    """Model name as the price table has it: without the owner and in lower case."""
    return F.lower(F.substring_index(llm, "/", -1))


def token_cost(usage: DataFrame, llm_col: str = "llm", prompt_col: str = "prompt_tokens", sampled_col: str = "sampled_tokens") -> DataFrame:
    """Tokens and dollars per model; the cost is NULL for a model without a price.

    Usage is added up before the join, so one row per model meets the price table.
    """
    totals = usage.groupBy(F.col(llm_col).alias("llm")).agg(
        F.sum(prompt_col).alias("prompt_tokens"), F.sum(sampled_col).alias("sampled_tokens"))
    table = F.broadcast(prices(usage.sparkSession))
    cost = (F.col("prompt_tokens") * F.col("prompt") + F.col("sampled_tokens") * F.col("sampled")) / 1e6
    return totals.join(table, price_key(F.col("llm")) == table["model"], "left").select(
        "llm", "prompt_tokens", "sampled_tokens", cost.alias("cost"))
