"""Text, code and number normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for truth values.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "measured"), ("false", "0", "no", "n", "illustrative")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def code(c: Column, most: int = 64, fallback: str = "anonymous") -> Column:
    """Letters, digits, dot, underscore and hyphen; everything else becomes one hyphen, none at either end."""
    x = F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-")
    x = F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, most)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def label(c: Column, most: int = 80, default: str = "untitled") -> Column:
    """Control characters become spaces."""
    x = F.substring(F.trim(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", " ")), 1, most)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def truth(c: Column) -> Column:
    """Null unless the word is known."""
    w = F.lower(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def positive_int(c: Column) -> Column:
    """Null for anything but a whole number above 0, which may be written with a zero fraction."""
    x = F.trim(c).try_cast("double")
    return F.when((x > 0) & (x == F.floor(x)) & (x < 2**31), x.cast("int"))


def fingerprint(state: Column, profile: Column) -> Column:
    """SHA-256 of a shape: its state count and its profile to six decimals."""
    return F.sha2(F.concat_ws(":", state.cast("string"), F.array_join(F.transform(profile, lambda v: F.format_string("%.6f", v)), ",")), 256)


def cursor(created: Column, key: Column) -> Column:
    """An opaque page cursor: url-safe base64 of a JSON array."""
    raw = F.to_json(F.array(F.lit("v1"), created.cast("string"), key.cast("string")))
    return F.translate(F.base64(raw.cast("binary")), "+/=", "-_")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def score(c: Column) -> Column:
    """Within [0, 1], six decimals, 0 if not finite."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(ok, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)).otherwise(F.lit(0.0))
