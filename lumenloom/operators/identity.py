"""Identity of configurations: canonical JSON, hashes of what matters in it, and whether a run may be resumed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings of a model's configuration that change how it is reached, not what it answers.
TRANSPORT = (
    ("https_openai_chat", "timeout"), ("https_openai_chat", "max_retries"),
    ("ray_vllm", "gpu_memory_utilization"), ("ray_vllm", "disable_log_stats"), ("ray_vllm", "prompt_length_estimator"), ("ray_vllm", "require_prompt_length_estimator"), ("ray_vllm", "prompt_length_safety_margin"),
)


def canonical(value: object) -> str:
    """JSON with sorted keys, without blanks, letters of all scripts as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _pruned(value: object, paths: Sequence[Sequence[str]]) -> object:
    if not isinstance(value, dict):
        return value
    out = {k: v for k, v in value.items() if (k,) not in paths}
    for k in out:
        inner = tuple(p[1:] for p in paths if len(p) > 1 and p[0] == k)
        if inner:
            out[k] = _pruned(out[k], inner)
    return out


def canonical_json(text: Column, without: Sequence[Sequence[str]] = ()) -> Column:
    """JSON text in canonical form, the members at the paths `without` left out; null for null and unreadable text. Arrow batches."""
    paths = tuple(map(tuple, without))

    def run(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            try:
                out.append(None if value is None else canonical(_pruned(json.loads(value), paths)))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text)


def config_hash(text: Column, without: Sequence[Sequence[str]] = TRANSPORT) -> Column:
    """SHA-256 of a configuration's canonical form without its transport settings: equal for configurations that mean the same."""
    return F.sha2(canonical_json(text, without), 256)


def may_resume(existing: dict, current: dict) -> tuple[bool, str]:
    """Whether a run with the configuration `current` may go on from one with `existing`, and why not.

    Trials and files may be added, but not taken away; with a bound on the
    samples the files must be the same; all else must be equal in canonical form.
    """
    free = ("num_trials", "val_files")
    if canonical({k: v for k, v in existing.items() if k not in free}) != canonical({k: v for k, v in current.items() if k not in free}):
        return False, "the configuration changed"
    trials = [int(c.get("num_trials") or 1) for c in (existing, current)]
    if trials[1] < trials[0]:
        return False, f"trials decreased from {trials[0]} to {trials[1]}"
    most = int(current.get("max_samples", -1))
    if most == 0:
        return False, "a bound of no samples"
    had, has = ({str(f) for f in c.get("val_files") or ()} for c in (existing, current))
    if most > 0 and had != has:
        return False, "files can't change under a bound on the samples"
    if not had <= has:
        return False, f"files are gone: {sorted(had - has)}"
    return True, ""


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, as `spark.read.format("binaryFile")` has them."""
    return F.sha2(content, 256)


def prompt_signature(*parts: Column) -> Column:
    """A 16-digit signature of a prompt's parts, null parts told from empty ones."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(p.alias("p"))), F.lit("null")) for p in parts])), 256), 1, 16)


def sha256_of(text: str) -> str:
    """SHA-256 of a text, on the driver."""
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
