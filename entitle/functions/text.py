"""Tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as stop words beside those of Spark's StopWordsRemover.
MORE_STOP_WORDS = ["cannot", "could", "ought", "would"]
TOKEN = r"([\p{L}\p{N}_]{2,})"


def stop_words() -> list[str]:
    """Spark's English stop words that can be tokens, and four more."""
    own = StopWordsRemover.loadDefaultStopWords("english")
    return sorted({w for w in own if w.isalnum() and len(w) > 1} | set(MORE_STOP_WORDS))


def tokens(column: str) -> Column:
    """Lower-cased runs of two or more word characters, stop words removed."""
    stop = ", ".join(f"'{word}'" for word in stop_words())
    return F.expr(f"filter(regexp_extract_all(lower(`{column}`), r'{TOKEN}', 1), t -> t NOT IN ({stop}))")


def bigrams(token_array: Column) -> Column:
    n = F.greatest(F.size(token_array) - 1, F.lit(0))
    return F.zip_with(F.slice(token_array, F.lit(1), n), F.slice(token_array, F.lit(2), n),
                      lambda a, b: F.concat(a, F.lit(" "), b))
