"""Model-name rules: family, family settings, reasoning detection, parameters."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family tests in order (substring of the lower-cased name).
FAMILY_RULES = (
    ("o_series", ("o1", "o3")),
    ("gpt5", ("gpt-5",)),
    ("claude", ("claude",)),
    ("grok", ("grok",)),
    ("gemini", ("gemini",)),
    ("openai", ("gpt",)),
)
# Generation defaults and token limits.
DEFAULT_MAX_TOKENS = 512
DEFAULT_MAX_THINKING_TOKENS = 8192
DEFAULT_TEMPERATURE = 0.8
DEFAULT_TOP_P = 0.95
DEFAULT_SEED = 1234
DEFAULT_REASONING_EFFORT = "medium"
# Name patterns of reasoning models needing the larger token limit.
THINKING_PATTERNS = ("gpt-oss", "thinking", "reasoning", "cot", "chain-of-thought", "deepseek-r1", "o1-", "gpt-o1")

# Per-family settings
# (max_concurrent, rate_limit_delay, parallel, seed_diversification, updates, removals).
FAMILY_SETTINGS = {
    "o_series": (50, 0.05, True, True,
                 {"max_completion_tokens": DEFAULT_MAX_THINKING_TOKENS, "reasoning_effort": DEFAULT_REASONING_EFFORT},
                 ["temperature"]),
    "gpt5": (15, 0.1, True, True, {"max_completion_tokens": DEFAULT_MAX_THINKING_TOKENS},
             ["max_tokens", "temperature", "top_p"]),
    "claude": (15, 0.1, True, True, {"max_tokens": DEFAULT_MAX_THINKING_TOKENS}, []),
    "grok": (10, 0.2, True, True, {"max_tokens": DEFAULT_MAX_THINKING_TOKENS}, []),
    "gemini": (15, 0.1, True, True,
               {"thinking": {"type": "enabled", "budget_tokens": DEFAULT_MAX_THINKING_TOKENS},
                "reasoning_effort": DEFAULT_REASONING_EFFORT},
               ["max_tokens"]),
    "openai": (50, 0.05, False, False, {}, []),
    "unknown": (1, 0.2, False, False, {}, []),
}
DEFAULT_PARAMS = {"max_tokens": DEFAULT_MAX_TOKENS, "temperature": DEFAULT_TEMPERATURE,
                  "top_p": DEFAULT_TOP_P, "seed": DEFAULT_SEED}


def jtext(v) -> str:
    """Parameter values travel as JSON text in map<string,string> columns."""
    return json.dumps(v, separators=(",", ":"))


def model_family(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for fam, needles in FAMILY_RULES:
        cond = None
        for n in needles:
            c = F.contains(low, F.lit(n))
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(fam)) if out is None else out.when(cond, F.lit(fam))
    return out.otherwise(F.lit("unknown"))


def _settings_map() -> Column:
    """Literal map family -> settings struct: a lookup inside the projection, no join."""
    entries = []
    for fam, (conc, delay, par, seeds, upd, rem) in FAMILY_SETTINGS.items():
        upd_map = (F.create_map(*[x for k, v in upd.items() for x in (F.lit(k), F.lit(jtext(v)))])
                   if upd else F.create_map().cast("map<string,string>"))
        rem_arr = F.array(*[F.lit(r) for r in rem]) if rem else F.array().cast("array<string>")
        entries += [F.lit(fam), F.struct(F.lit(conc).alias("max_concurrent"), F.lit(delay).alias("rate_limit_delay"),
                                         F.lit(par).alias("requires_parallel_generation"),
                                         F.lit(seeds).alias("requires_seed_diversification"),
                                         upd_map.alias("param_updates"), rem_arr.alias("param_removals"))]
    return F.create_map(*entries)


def family_settings(family: Column) -> Column:
    return F.element_at(_settings_map(), family)


def is_thinking_model(name: Column) -> Column:
    low = F.lower(name)
    return F.exists(F.array(*[F.lit(p) for p in THINKING_PATTERNS]), lambda p: F.contains(low, p))


def token_limit(name: Column, user_override: Column | None = None) -> Column:
    default = F.when(is_thinking_model(name), F.lit(DEFAULT_MAX_THINKING_TOKENS)).otherwise(F.lit(DEFAULT_MAX_TOKENS))
    return default if user_override is None else F.coalesce(user_override.cast("int"), default)


def merge_params(request: Column, updates: Column, removals: Column) -> Column:
    """defaults <- request <- family updates, then removals; later maps win.

    ``map_concat`` refuses duplicate keys, so each earlier map first drops
    the keys a later one sets.
    """
    defaults = F.create_map(*[x for k, v in DEFAULT_PARAMS.items() for x in (F.lit(k), F.lit(jtext(v)))])
    a = F.map_filter(defaults, lambda k, _v: ~F.array_contains(F.map_keys(request), k))
    b = F.map_concat(a, request)
    b = F.map_filter(b, lambda k, _v: ~F.array_contains(F.map_keys(updates), k))
    c = F.map_concat(b, updates)
    return F.map_filter(c, lambda k, _v: ~F.array_contains(removals, k))


def params_text(m: Column) -> Column:
    """Sorted 'key=value' list, for display and comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
