"""Scalar expressions: transforms, bounds, identifiers, failure classes."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(error: Column) -> Column:
    return error * error


def transform(value: Column, kind: Column) -> Column:
    """100 ln(x) for ``log``, x for ``lin``; any other kind raises."""
    return F.when(kind == "log", 100 * F.ln(value)).when(kind == "lin", value).otherwise(F.raise_error(F.concat(F.lit("unknown transform "), kind)).cast("double"))


def inverse_transform(value: Column, code: Column) -> Column:
    """Code 0: exp; code 1: percent."""
    return F.when(code == 0, F.exp(value)).when(code == 1, 100 * value)


def to_unbounded(x: Column, low: Column, high: Column) -> Column:
    """Logit of a value strictly inside its box; null elsewhere."""
    return F.when((x > low) & (x < high), -F.ln((high - x) / (x - low)))


def to_box(t: Column, low: Column, high: Column) -> Column:
    return low + (high - low) / (1 + F.exp(-t))


def penalty_weight(kind: Column, lag: Column, alpha: Column, kappa: Column) -> Column:
    """Intercept 0, own lags l^alpha, cross lags kappa l^alpha."""
    return F.when(kind == "intercept", 0.0).when(kind == "own", F.pow(lag, alpha)).otherwise(kappa * F.pow(lag, alpha))


def floored(value: Column, least: float) -> tuple[Column, Column]:
    return F.greatest(value, F.lit(least)), value < least


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def event_id(number: Column, origin: Column) -> Column:
    return F.format_string("sel-%03d-o%04d", number, origin)


def split_id(origin: Column) -> Column:
    return F.format_string("split-o%05d", origin)


def cell_id(scope: str, variable: Column, horizon: Column, group: Column | None = None) -> Column:
    h = F.concat(F.lit("-h"), horizon.cast("string"))
    return {
        "pooled": F.lit("pooled"),
        "horizon": F.concat(F.lit("horizon"), h),
        "variable": F.concat(F.lit("variable-"), slug(variable)),
        "variable_horizon": F.concat(F.lit("variable-"), slug(variable), h),
        "group": F.concat(F.lit("group-"), slug(group if group is not None else variable)),
        "group_horizon": F.concat(F.lit("group-"), slug(group if group is not None else variable), h),
    }[scope]


def horizon_number(label: Column) -> Column:
    """N of ``hNq``; null for other labels."""
    return F.try_to_number(F.nullif(F.regexp_extract(label, r"^h(\d+)q$", 1), F.lit("")), F.lit("999999999")).cast("int")


#: Failure classes in order, each with the words that show it; the first that fits counts.
FAILURES = [
    ("cancelled", ["keyboardinterrupt", "cancel"]),
    ("nonfinite_forecast", ["non-finite", "nonfinite"]),
    ("numerical", ["lin alg", "linalg", "overflow", "divide", "nan"]),
    ("missing_input", ["missing", "not found"]),
    ("dependency", ["import", "module", "dependency"]),
    ("permission", ["permission"]),
    ("timeout", ["timeout"]),
    ("invalid_configuration", ["benchmark_rmse", "requires", "invalid", "mismatch"]),
]


def failure_class(text: Column) -> Column:
    """The class of a failure's text: ``unknown`` without one, ``forecast_invalid`` for an infeasible forecast, else ``runtime``."""
    low = F.lower(F.trim(text))
    out = F.when(low.contains("forecast") & low.contains("infeasible"), "forecast_invalid").otherwise("runtime")
    for name, words in reversed(FAILURES):
        out = F.when(low.rlike("|".join(re.escape(w) for w in words)), name).otherwise(out)
    return F.when(F.coalesce(low, F.lit("")) == "", "unknown").otherwise(out)


def parse_groups(text: str) -> dict[str, list[str]]:
    """``Name=A+B;Other=C``; a variable may stand in one group only."""
    out: dict[str, list[str]] = {}
    seen: set[str] = set()
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, members = part.partition("=")
        found = [m.strip() for m in members.split("+") if m.strip()]
        if not name.strip() or not found or name.strip() in out or seen & set(found):
            raise ValueError(f"bad or overlapping group {part!r}")
        out[name.strip()] = found
        seen |= set(found)
    return out


def expand_environment(value):
    """``${NAME:-default}`` in all strings of nested lists and dicts."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: expand_environment(v) for k, v in value.items()}
    return [expand_environment(v) for v in value] if isinstance(value, list) else value


def stable_hash(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def child_seed(*parts) -> int:
    """A 63-bit seed that depends on the parts alone."""
    return int(stable_hash(list(map(str, parts)))[:16], 16) >> 1


def human_size(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"
