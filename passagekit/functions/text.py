"""String expressions: tokens, trimming, normalising, parsing and formatting. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a failure, and the heading of the source list.
UNKNOWN_OUTPUT = "Unknown format in generator output"
STREAM_ERROR = "Error in processing response stream."
GENERATION_ERROR = "Error in generating response."
SOURCES_HEADING = "\n\n**Sources:**\n"
MENTION_LENGTH = 15

# The fields of a judge's JSON-like reply, and where words are cut for the classifiers.
JUDGE_ANSWER = r'"answer"\s*:\s*"([^"]*)"'
JUDGE_SCORE = r'"score"\s*:\s*([0-9]+)'
JUDGE_REASONING = r'"reasoning"\s*:\s*"([^"]*)"'
CAMEL_CASE = "([a-z0-9])([A-Z])"
# The look-behind follows the sign, so that it is only tried at signs and not at every character: the same matches, in less time.
TIGHT_PUNCTUATION = r"(?U)([?.,!])(?<=\w[?.,!])(?!\s)"

_PIECE = r"(?U)\s*\S+"
_SPACES = r"(?U)\s+"


# The two characters outside ASCII whose lower case begins with an ASCII letter; they separate words too.
_FOLDS_TO_ASCII = ("\u0130", "\u212a")


def document_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs; anything else separates."""
    for letter in _FOLDS_TO_ASCII:
        text = F.replace(text, F.lit(letter), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def query_tokens(query: Column) -> Column:
    """Lower-case and split on white space only, so `cat?` stays one token and matches no document."""
    return F.filter(F.split(F.lower(query), _SPACES), lambda t: t != "")


def token_pieces(text: Column) -> Column:
    """White-space tokens that keep the space before them."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def count_tokens(text: Column, tokenizer: Callable[[], object] | None = None) -> Column:
    """Number of tokens. `tokenizer` is an importable factory of an object with encode and decode."""
    if tokenizer is None:
        return F.size(token_pieces(text))

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = tokenizer()
        for texts in batches:
            yield pa.array([None if t is None else len(codec.encode(t)) for t in texts.to_pylist()], pa.int32())

    return counted(text)


def trim_tokens(text: Column, n: Column | int, tokenizer: Callable[[], object] | None = None) -> Column:
    """The first n tokens of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    n = F.greatest(n.cast("int"), F.lit(0))
    if tokenizer is None:
        return F.array_join(F.slice(token_pieces(text), F.lit(1), n), "")

    @F.arrow_udf("string")
    def trimmed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = tokenizer()
        for texts, limits in batches:
            pairs = zip(texts.to_pylist(), limits.to_pylist())
            yield pa.array([None if t is None else codec.decode(codec.encode(t)[:m]) for t, m in pairs], pa.string())

    return trimmed(text, n)


def collapse_spaces(text: Column) -> Column:
    """White-space runs become one blank, none at the ends. Lone blanks, nearly all of them, are not matched."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))


def split_camel_case(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, CAMEL_CASE, "$1 $2"))


def normalize_for_classifier(text: Column, subwords: Callable[[Column], Column] | None = None) -> Column:
    """Text as the classifiers see it. The order of the steps matters."""
    spaced = F.regexp_replace(text, TIGHT_PUNCTUATION, " $1")
    blanked = F.translate(spaced, "_-#", "   ")
    plain = F.translate(F.replace(blanked, F.lit(".html"), F.lit("")), ".", " ")
    words = split_camel_case(plain)
    return subwords(words) if subwords else words


def parse_judge_json(response: Column) -> Column:
    """STRUCT(answer, score, reasoning); all empty unless all three fields are there."""
    found = F.lit(True)
    for pattern in (JUDGE_ANSWER, JUDGE_SCORE, JUDGE_REASONING):
        found = found & F.regexp_like(response, F.lit(pattern))
    return F.struct(
        F.when(found, F.regexp_extract(response, JUDGE_ANSWER, 1)).otherwise("").alias("answer"),
        F.when(found, F.regexp_extract(response, JUDGE_SCORE, 1).try_cast("double")).alias("score"),
        F.when(found, F.regexp_extract(response, JUDGE_REASONING, 1)).otherwise("").alias("reasoning"),
    )


def parse_judge_lines(response: Column) -> Column:
    """STRUCT(score, reasoning, error): the first line is the score. Without a line break the score is 0."""
    cut = F.instr(response, "\n")
    first = F.substr(response, F.lit(1), cut - 1)
    value = F.trim(F.regexp_replace(first, _SPACES, " ")).try_cast("double")
    rest = F.substr(response, cut + 1)
    return F.struct(
        F.when(cut == 0, F.lit(0.0)).otherwise(value).alias("score"),
        F.when(cut == 0, F.lit("")).otherwise(F.regexp_replace(rest, "^\n+", "")).alias("reasoning"),
        F.when((cut > 0) & value.isNull(), F.concat(F.lit("score is not a number: "), first)).alias("error"),
    )


def extract_generated(raw: Column) -> Column:
    """The generated text in a JSON generator output, or a text that says what is wrong with it."""
    found = F.coalesce(F.get_json_object(raw, "$.generated_text"), F.lit(UNKNOWN_OUTPUT))
    return F.when(raw.isNull(), STREAM_ERROR).otherwise(found)


def format_reply(answer: Column, sources: Column) -> Column:
    """The answer followed by its sources as a Markdown list."""
    lines = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("* "), s, F.lit("\n"))), "")
    footer = F.when(F.size(sources) > 0, F.concat(F.lit(SOURCES_HEADING), lines)).otherwise("")
    return F.concat(answer, footer)


def format_chat_reply(answer: Column, sources: Column) -> Column:
    """The answer followed by one source per line."""
    return F.concat(answer, F.lit("\n"), F.array_join(sources, "\n"))


def strip_mention(text: Column) -> Column:
    """Drop the bot mention that chat messages start with."""
    return F.substr(text, F.lit(MENTION_LENGTH + 1))


def thread_of(thread_ts: Column, ts: Column) -> Column:
    """The thread to answer in: the given one, else the message itself."""
    return F.coalesce(F.nullif(thread_ts, F.lit("")), ts)


@F.arrow_udf(T.StringType())
def python_repr(values: pa.Array) -> pa.Array:
    """Python's own text form of a value, which prompts contain for lists and dictionaries."""
    return pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())
