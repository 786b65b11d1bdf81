"""What a rollout sample says: its accuracy, tokens, failures, limits, and whether it counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.values import finite_float


def accuracy(score: Column) -> Column:
    """The first finite of accuracy_reward, score and reward in a map of scores."""
    return F.coalesce(*[finite_float(score[key]) for key in ("accuracy_reward", "score", "reward")])


def reward_is_right(nested: Column, flat: Column) -> Column:
    """Whether the accuracy reward, nested or flat, is exactly 1; false for null."""
    return F.coalesce(finite_float(nested), finite_float(flat)).eqNullSafe(F.lit(1.0))


def response_tokens(total: Column, generated: Column, tool: Column) -> Column:
    """Tokens of a response: the total, else the sum of its known parts; null if nothing is known."""
    zero = lambda v: F.coalesce(finite_float(v), F.lit(0.0))
    parts = F.when(finite_float(generated).isNotNull() | finite_float(tool).isNotNull(), zero(generated) + zero(tool))
    return F.coalesce(finite_float(total), parts)


def has_score(score: Column) -> Column:
    """Whether a map of scores has an entry."""
    return F.coalesce(F.size(score) > 0, F.lit(False))


def failure_reasons(reasons: Column, critical: Column | None = None, score: Column | None = None, *, sweep: bool = False) -> Column:
    """All reasons of failure of a sample: those listed, else critical_failure if it failed critically, then those its map of scores holds.

    For a sweep, blank reasons don't count, and a score that reports
    compute_score_success as false is a reason of its own.
    """
    listed = F.coalesce(F.filter(reasons, lambda r: r.isNotNull() & (r != "") if sweep else r.isNotNull()), F.array().cast("array<string>"))
    if critical is not None:
        listed = F.when((F.size(listed) == 0) & F.coalesce(critical, F.lit(False)), F.array(F.lit("critical_failure"))).otherwise(listed)
    if score is None:
        return listed
    said = [score[key].cast("string") for key in ("fail_reason", "failure_reason", "error_type")]
    told = [F.when(v != "", v) for v in said]
    if sweep:
        unscored = F.lower(score["compute_score_success"].cast("string")).isin("false", "0", "0.0")
        told = [F.when(unscored, F.coalesce(said[1], said[0], F.lit("score_failed"))), *told]
    return F.concat(listed, F.array_compact(F.array(*told)))


def needs_rerun(reasons: Column, critical: Column | None = None, score: Column | None = None) -> Column:
    """Whether a sample has any reason of failure, a critical failure without a listed one included."""
    return F.size(failure_reasons(reasons, critical, score)) > 0


def needs_judging(score: Column, critical: Column, rescore: bool = False) -> Column:
    """Whether a sample is to be judged: never a critical failure, a scored one only when rescoring."""
    return ~F.coalesce(critical, F.lit(False)) & (F.lit(rescore) | ~has_score(score))


def is_valid(score: Column, reasons: Column, critical: Column | None = None) -> Column:
    """Whether a sample counts: no reason of failure, scoring not reported as failed, and an accuracy."""
    failed = F.coalesce(finite_float(score["compute_score_success"]) == 0, F.lit(False))
    return ~needs_rerun(reasons, critical) & ~failed & accuracy(score).isNotNull()


def sequence_length(prompt: Column, response: Column) -> Column:
    """Prompt and response tokens together; null if either is unknown."""
    return finite_float(prompt) + finite_float(response)


def sample_number(key: str, score: Column, sample: dict[str, Column]) -> Column:
    """A number of a sample as the judge reads it: a key its map of scores has wins, even with null, then the sample's own field.

    The score falls back to the map's `score`; total_tokens and sequence_tokens
    to prompt plus response tokens. What isn't a number, or is NaN, is null.
    """
    held = F.coalesce(F.map_contains_key(score, F.lit(key)), F.lit(False))
    own = sample.get(key, F.lit(None).cast("double"))
    value = F.when(held, score[key].cast("string")).otherwise(own.cast("string"))
    if key == "score":
        value = F.coalesce(value, score["score"].cast("string"))
    number = F.when(~F.isnan(value.try_cast("double")), value.try_cast("double"))
    if key in ("total_tokens", "sequence_tokens"):
        derived = sample_number("prompt_tokens", score, sample) + sample_number("response_tokens_total", score, sample)
        return F.when(value.isNull(), derived).otherwise(number)
    return number


def first_positive(*limits: Column) -> Column:
    """The first limit that is a positive whole number; of tool calls, from loop and request settings in turn."""
    return F.coalesce(*[F.when(v.try_cast("int") > 0, v.try_cast("int")) for v in limits])


def reasons_of(value: Column) -> Column:
    """Failure reasons given as one text or as JSON text of a list, as an array; blank ones are left out."""
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.filter(F.coalesce(listed, F.array(value)), lambda r: r.isNotNull() & (F.trim(r) != ""))


def core_time(generating: Column, parsing: Column, calling: Column) -> Column:
    """Seconds that a conversation spent generating, parsing calls and calling tools; null if generating wasn't timed, other unknown times count as none."""
    zero = lambda v: F.coalesce(finite_float(v), F.lit(0.0))
    return F.when(generating.isNotNull(), zero(generating) + zero(parsing) + zero(calling))
