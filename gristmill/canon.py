"""Canonical forms every operator shares, as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9_]+"
EXPERT_WORD = "[a-z0-9]+(?:'[a-z0-9]+)?"
ADVERSARIAL_WORD = "[A-Za-z0-9]+(?:['’\\-][A-Za-z0-9]+)*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(x) -> Column:
    """White-space runs become one blank; outer blanks go."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def stable_hash(x, n: int = 64) -> Column:
    """First n hex digits of the SHA-256 of a string."""
    return F.substring(F.sha2(_c(x), 256), 1, n)


def hash_fraction(x, digits: int = 16) -> Column:
    """SHA-256 prefix as a double in [0, 1)."""
    return F.conv(stable_hash(x, digits), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**digits))


def words(x) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(f"({WORD})"), F.lit(1))


def expert_words(x) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(f"({EXPERT_WORD})"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: within lambdas an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(tokens: Column, n: int) -> Column:
    """All n-word windows of an array of words, each joined by blanks; empty for shorter arrays."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))


def label(x, sep: str) -> Column:
    """One spelling for names: lower case, no outer white space, separators alike; blank counts as null."""
    t = F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.lower(t), r"(?U)[-_\s]+", sep)
    return F.when(t != "", t)
