"""Configuration records: canonical form, placeholders, user-wins merge, shape-matched deletion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The innermost placeholder: a name and an optional default. Fixed form.
_INNER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^${}]*))?\}")
PASSES = 10


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null if it is no JSON (or has a key twice)."""
    return F.to_json(F.try_parse_json(text))


def valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def expand(text: str, env: Mapping[str, str]) -> str:
    """Placeholders replaced from the inside out, at most PASSES times; unknown or empty ones by their default, or by nothing."""
    for _ in range(PASSES):
        new = _INNER.sub(lambda m: env.get(m[1]) or m[2] or "", text)
        if new == text:
            break
        text = new
    return text


def map_strings(value: Any, f: Callable[[str], str]) -> Any:
    """A nested value with f applied to each string in it."""
    if isinstance(value, str):
        return f(value)
    if isinstance(value, list):
        return [map_strings(v, f) for v in value]
    if isinstance(value, dict):
        return {k: map_strings(v, f) for k, v in value.items()}
    return value


def expanded(text: Column, env: Mapping[str, str]) -> Column:
    """A JSON text with placeholders in its strings expanded; null stays null, bad JSON is null."""
    held = dict(env)

    @F.pandas_udf("string")
    def run(s):
        def one(t):
            try:
                return None if t is None else json.dumps(map_strings(json.loads(t), lambda x: expand(x, held)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return s.map(one)

    return run(text)


def resolved_env(env: Column) -> Column:
    """A map without entries that still hold a placeholder; null if none is left."""
    kept = F.map_filter(env, lambda _, v: ~F.contains(v, F.lit("${")))
    return F.when(F.size(kept) > 0, kept)


def without_hooks(hooks: Column, gone: Callable[[Column], Column]) -> Column:
    """hooks: map of event to array of {matcher, hooks: array of {command, ...}}; those whose command is gone go, and what is empty then."""
    groups = F.transform_values(hooks, lambda _, gs: F.filter(F.transform(gs, lambda g: g.withField("hooks", F.filter(g["hooks"], lambda h: ~F.coalesce(gone(h["command"]), F.lit(False))))), lambda g: F.size(g["hooks"]) > 0))
    left = F.map_filter(groups, lambda _, gs: F.size(gs) > 0)
    return F.when(F.size(left) > 0, left)


def names_script(command: Column, scripts: list[str]) -> Column:
    """Whether a command is or ends in one of the scripts (after a slash), quoted or not, without case."""
    names = "|".join(re.escape(s) for s in scripts)
    return command.rlike(rf"""(?i)(^|[/\\])({names})["']?\z""")
