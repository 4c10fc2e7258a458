"""Redaction as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order they are applied, masks, and sensitive key words.
# (?U) gives word boundaries, digits and blanks their Unicode meaning.
REDACTED = "***REDACTED***"
LABELLED_PATTERNS = [
    r"""(?i)(?U)(api[_-]?key["']?\s*[:=]\s*["']?)([a-zA-Z0-9_-]{20,})""",
    r"""(?i)(?U)(bearer\s+)([a-zA-Z0-9_.-]{20,})""",
    r"""(?i)(?U)(password["']?\s*[:=]\s*["']?)([^"'\s]{6,})""",
]
TYPED_PATTERNS = {
    "EMAIL": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"(?U)(\+91|91)?[-.\s]?[6-9]\d{9}",
    "AADHAAR": r"(?U)\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b",
    "PAN": r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b",
    "CREDIT_CARD": r"(?U)\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b",
}
SENSITIVE_PARTS = ["api_key", "password", "token", "secret", "auth", "phone", "email", "aadhaar", "pan", "address"]
SENSITIVE_KEYS = ["password", "api_key", "token", "secret", "auth"]
LONG_TEXT = 100
TRUNCATED = "...[truncated]"


def redact_text(text: Column) -> Column:
    for pattern in LABELLED_PATTERNS:
        text = F.regexp_replace(text, pattern, "$1" + REDACTED.replace("$", r"\$"))
    for name, pattern in TYPED_PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"***{name}_REDACTED***")
    return text


def shorten(text: Column) -> Column:
    return F.when(F.length(text) > LONG_TEXT,
                  F.concat(F.substring(text, 1, LONG_TEXT), F.lit(TRUNCATED))).otherwise(text)


def is_sensitive(key: Column, exact: bool = False) -> Column:
    """Exact form: the key is one of five words. Otherwise: the key contains one of ten."""
    key = F.lower(key)
    return key.isin(SENSITIVE_KEYS) if exact else key.rlike("|".join(SENSITIVE_PARTS))


def redact_map(values: Column, exact: bool = False) -> Column:
    return F.transform_values(values, lambda k, v: F.when(is_sensitive(k, exact), F.lit(REDACTED)).otherwise(v))


def _mask_nested(text: str | None, exact: bool) -> str | None:
    """One JSON text with sensitive values masked at any depth; other values keep their types."""
    if text is None:
        return None
    try:
        root = [json.loads(text)]
    except RecursionError:
        return json.dumps(REDACTED)
    except ValueError:
        return None
    todo: list[tuple[dict | list, object]] = [(root, 0)]
    while todo:
        held, at = todo.pop()
        value = held[at]
        if isinstance(value, dict):
            for key in value:
                low = key.lower()
                if low in SENSITIVE_KEYS if exact else any(part in low for part in SENSITIVE_PARTS):
                    value[key] = REDACTED
                elif isinstance(value[key], dict) or (isinstance(value[key], list) and not exact):
                    todo.append((value, key))
        elif isinstance(value, list) and not exact:
            todo += [(value, k) for k in range(len(value))]
        elif isinstance(value, str) and not exact and len(value) > LONG_TEXT:
            held[at] = value[:LONG_TEXT] + TRUNCATED
    try:
        return json.dumps(root[0], ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return json.dumps(REDACTED)


def redact_json(text: Column, exact: bool = False) -> Column:
    """JSON text with the values of sensitive keys masked, at any depth; numbers, booleans and nulls stay.

    Texts in lists, and a text that is the whole value, are shortened. The exact form knows fewer keys and
    leaves lists alone. Text that is no JSON gives null; nesting too deep to be read is masked as a whole.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _mask_nested(t, exact))

    return run(text)
