"""Text expressions: failure reasons, names, pages, tool calls and signs of degenerate text."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.values import clean_text


def failure_kind(reason: Column) -> Column:
    """A failure reason by its kind; the first that applies.

    Blank is unknown_failure; then timeouts, rate limits, context overflows,
    empty assistant messages; reasons about scores or the judge keep the part
    before the first colon, others their first two non-empty parts, or the first
    96 characters where there is no colon.
    """
    # Fixed values below: the words by which the kinds are told, and their names.
    text = clean_text(reason)
    low = F.lower(text)
    has = lambda *words: F.lit(False) if not words else _any([low.contains(w) for w in words])
    parts = F.filter(F.transform(F.split(text, ":"), clean_text), lambda p: p != "")
    return (
        F.when(text == "", "unknown_failure")
        .when(has("timeout"), "timeout")
        .when(has("rate limit", "429", "too many requests"), "rate_limit")
        .when(has("context", "max_model_len", "prompt is too long"), "context_overflow")
        .when(has("empty") & has("assistant"), "empty_assistant_message")
        .when(has("score", "judge"), F.split(text, ":")[0])
        .when(text.contains(":"), F.array_join(F.slice(parts, 1, 2), ":"))
        .otherwise(F.substring(text, 1, 96))
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def first_line(text: Column) -> Column:
    """The text up to its first line break."""
    return F.split(text, "\n")[0]


def words(text: Column) -> Column:
    """Words by white space; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


#: White space as `str.split()` of Python has it, of any script.
_WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def split_words(text: Column) -> Column:
    """Words by the white space of all scripts, as the reference splits them; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE_SPACE), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Words over 0.75, rounded up; 0 for null and blank texts."""
    return F.ceil(F.size(split_words(text)) / 0.75).cast("bigint")


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of the same word; 0 for none."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["last"] == word, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(tokens, start, step)["best"]


def repeated_ngrams(tokens: Column, n: int = 8) -> Column:
    """How many runs of n words occur again: all runs less the distinct ones."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, n), " ")))
    return F.size(grams) - F.size(F.array_distinct(grams))


#: Limits beyond which a text counts as degenerate.
MOST_CHARS, MOST_WORDS, LEAST_UNIQUE, LONG_TEXT, LONGEST_RUN, MOST_REPEATS = 50_000, 8_000, 0.20, 1_000, 10, 50


def degenerate_reasons(text: Column) -> Column:
    """Why a text is degenerate, in order; an empty array if it isn't. Words by white space, case kept, limits exclusive."""

    def reasons(tokens: Column) -> Column:
        n = F.size(tokens)
        return F.array_compact(
            F.array(
                F.when(F.length(text) > MOST_CHARS, "too_many_chars"),
                F.when(n > MOST_WORDS, "too_many_words"),
                F.when((n >= LONG_TEXT) & (F.size(F.array_distinct(tokens)) / n < LEAST_UNIQUE), "low_unique_ratio"),
                F.when(longest_run(tokens) > LONGEST_RUN, "repeated_word"),
                F.when(n >= LONG_TEXT, F.when(repeated_ngrams(tokens) > MOST_REPEATS, "repeated_ngram")),
            )
        )

    # The array of one binds the words to a variable; inlined, they would be split anew for every n-gram.
    return F.transform(F.array(words(text)), reasons)[0]


def truncate(text: Column, most: int, side: str = "middle") -> Column:
    """A text cut to `most` characters with a mark where it was cut."""
    half = most // 2
    mark = F.lit("...(truncated)...")
    cut = {
        "left": lambda: F.concat(F.substring(text, 1, most), F.lit("...(truncated)")),
        "right": lambda: F.concat(F.lit("(truncated)..."), F.substring(text, -most, most)),
        "middle": lambda: F.concat(F.substring(text, 1, half), mark, F.substring(text, -half, half)),
    }[side]()
    return F.when((F.length(text) <= most) | F.lit(most <= 0), text).otherwise(cut)


def answerability(source: Column) -> Column:
    """unanswerable, answerable or other, from a source's name."""
    return F.when(source.contains("_unanswerable"), "unanswerable").when(source.contains("_answerable"), "answerable").otherwise("other")


def category(source: Column) -> Column:
    """The part of a source's name before its answerability."""
    return F.regexp_replace(source, "_(un)?answerable.*$", "")


def rescale_tag(value: Column) -> Column:
    """A rescale for use in names: 0.50 as 05, 0.25 as 025, 1.0 as 1."""
    plain = F.regexp_replace(clean_text(value), r"^\.", "0.")
    return F.replace(F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain), F.lit("."), F.lit(""))


def safe_name(value: Column) -> Column:
    """A text for use as a file name: letters, digits, dots, dashes and underscores, other signs as one underscore."""
    return F.regexp_replace(F.regexp_replace(value, r"[^\p{L}\p{N}._-]+", "_"), "^_+|_+$", "")


def benchmark(data_source: Column, path: Column) -> Column:
    """A benchmark's name: the data source if there is one, else what precedes -val- in the file name, else unknown."""
    name = F.regexp_extract(path, r"([^/]+?)-val-[^/]*$", 1)
    return F.coalesce(F.when(data_source != "", data_source), F.when(name != "", name), F.lit("unknown"))


def rescale_of_path(path: Column) -> Column:
    """The rescale in the nearest folder named rescale..., else unknown."""
    found = F.regexp_extract(path, r".*/(rescale[^/]*)/", 1)
    return F.when(found != "", found).otherwise("unknown")


def page_of_path(path: Column) -> Column:
    """The page number that is a file's stem, else null."""
    return F.regexp_extract(path, r"(?:^|/)(\d+)\.[A-Za-z0-9]+$", 1).try_cast("int")


def page_numbers(value: Column) -> Column:
    """Whole numbers of a text such as [1, 2], "1, 2" or "1 2", in order."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]()'\"]", " "), r"[,\s]+"), lambda p: p.try_cast("int")), lambda p: p.isNotNull())


def boxes_in_text(text: Column) -> Column:
    """Boxes written as <box>(x1,y1,x2,y2)</box>, those with four numbers."""
    inner = F.regexp_extract_all(text, F.lit(r"<box>\s*\(([^)]*)\)\s*</box>"), F.lit(1))
    numbers = F.transform(inner, lambda t: F.filter(F.transform(F.split(t, ","), lambda p: clean_text(p).try_cast("double")), lambda v: v.isNotNull()))
    return F.filter(numbers, lambda b: F.size(b) == 4)


def tool_calls(text: Column) -> Column:
    """Calls written as <tool_call>{json}</tool_call>: array of (name, arguments as JSON text); unreadable ones are left out."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def channel_tool_calls(text: Column) -> Column:
    """Calls in channel format: array of (name, arguments as written); finished and open analysis is left out first."""
    analysis = r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?(?:<\|end\|>|$)"
    rest = F.regexp_replace(text, analysis, "")
    call = r"(?s)<\|start\|>assistant<\|channel\|>[^<]*?\bto=functions\.([\w.-]+)[^<]*(?:<\|constrain\|>[^<]*)?<\|message\|>(.*?)<\|call\|>"
    names, bodies = F.regexp_extract_all(rest, F.lit(call), F.lit(1)), F.regexp_extract_all(rest, F.lit(call), F.lit(2))
    return F.zip_with(names, bodies, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def content_parts(text: Column) -> Column:
    """A text cut at its image tags: array of (kind, text), image parts between text parts, empty texts left out."""
    pieces = F.split(text, "<image>")
    both = F.flatten(F.transform(pieces, lambda p, i: F.array(F.struct(F.lit("image").alias("kind"), F.lit("").alias("text"), (i > 0).alias("use")), F.struct(F.lit("text").alias("kind"), p.alias("text"), (p != "").alias("use")))))
    return F.transform(F.filter(both, lambda x: x["use"]), lambda x: F.struct(x["kind"], x["text"]))


def tagged(text: Column, tag: str) -> Column:
    """The content of the first <tag>...</tag>, else null."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), found)


# What the two detectors of questions without an answer look for.
UNANSWERABLE_RECORD = ("not-answerable", "unanswerable", "cannot answer", "cannot be answered")
UNANSWERABLE_OUTPUT = ("not-answerable", "not answerable", "unanswerable", "cannot answer", "cannot be answered")


def unanswerable_text(*values: Column, needles: tuple[str, ...] = UNANSWERABLE_OUTPUT) -> Column:
    """Whether any of the values, joined by blanks, says that the question has no answer; nulls are left out.

    The two detectors differ in their needles and in the fields they are given.
    """
    low = F.lower(F.concat_ws(" ", *values))
    return _any([low.contains(n) for n in needles])


def short_text(text: Column, most: int = 200) -> Column:
    """A text for display, with the number of characters left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("... ("), (F.length(text) - most).cast("string"), F.lit(" more)")))


def rewrite_prefix(value: Column, mappings: dict[str, str]) -> Column:
    """A path or URI with its longest mapped prefix replaced, only at a boundary between names."""
    out = None
    for old in sorted(mappings, key=len, reverse=True):
        stem = old.rstrip("/")
        hit = (value == stem) | value.startswith(stem + "/")
        new = F.concat(F.lit(mappings[old].rstrip("/")), F.substring(value, len(stem) + 1, 2**30))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return value if out is None else out.otherwise(value)


def slug(value: Column) -> Column:
    """A text as part of a name: blanks, dots, slashes, colons and dashes as underscores, other runs of signs as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(value, "/ .:-", "_____"), "[^A-Za-z0-9_]+", "_"), "^_|_$", "")


def literal_list(value: Column) -> Column:
    """A list written as text, as array<string>: a JSON or Python literal in brackets, else parts between commas and blanks; empty for null and blank. Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        out = []
        for raw in values:
            text = "" if raw is None else raw.strip()
            found = None
            if text.startswith("[") and text.endswith("]"):
                try:
                    found = ast.literal_eval(text)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    found = None
            if not isinstance(found, list):
                found = [part for part in re.split(r"[,\s]+", text)] if text else []
            out.append([None if v is None else str(v) for v in found])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")(value)


def whole_numbers(values: Column) -> Column:
    """The parts of an array that are whole numbers, in order."""
    return F.filter(F.transform(values, lambda v: F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), clean_text(v).try_cast("int"))), lambda n: n.isNotNull())


def first_reasons(reasons: Column, most: int = 3) -> Column:
    """The first reasons in a row, and how many there are in all if there are more; null for none."""
    n = F.size(reasons)
    shown = F.array_join(F.slice(reasons, 1, most), "; ")
    return F.when(n > most, F.concat(shown, F.lit("; ... ("), n.cast("string"), F.lit(" reasons total)"))).when(n > 0, shown)
