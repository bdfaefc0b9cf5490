"""Column expressions: trimming, ids, tokens, missing values, exact rounding and phrase classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that count as missing in source tables, and in the merged table; words for yes.
MISSING = ("", "NA", "N/A", "nan", "None", "null")
MASTER_MISSING = ("", "NA", "nan", "None")
TRUTHY = ("1", "true", "yes", "y", "approved")
#: Text that reads as a floating-point number, digit groups by underscore included.
NUMBER = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def quoted(name: str) -> str:
    """A column's name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"


def text(c: Column) -> Column:
    """As a string; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def strip_long(c: Column) -> Column:
    """As strip; a text without white space at its ends is left unsearched, and one with visible ASCII there costs no search at all.
    c stands several times in it, so it is meant for columns, not for what is dear to work out."""
    first, last = F.substring(text(c), 1, 1), F.substring(text(c), -1, 1)
    visible = first.between("!", "~") & last.between("!", "~")
    return F.when(visible, text(c)).when(F.concat(first, last).rlike(r"(?U)\s"), strip(c)).otherwise(text(c))


def collapse(c: Column) -> Column:
    """Each run of white space as one space, and none at the ends."""
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def or_default(c: Column, default: Column | str) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(c, F.lit("")), default)


def is_missing(c: Column, tokens: Sequence[str] = MISSING) -> Column:
    return strip_long(c).isin(*tokens)


def is_truthy(c: Column) -> Column:
    return F.lower(strip(c)).isin(*TRUTHY)


def is_number(c: Column) -> Column:
    return strip_long(c).rlike(NUMBER)


def missing_rate(available: Column, total: Column) -> Column:
    """1 - available / total to three digits, half to even on the exact binary value; an empty table counts as one row.

    The quotient of whole numbers is scaled by 2**53, which is exact, and rounded as a whole number.
    """
    unit = F.lit(1 << 53)
    rate = F.lit(1.0) - available / F.greatest(total, F.lit(1))
    scaled = (rate * F.lit(float(1 << 53))).cast("bigint") * F.lit(1000)
    whole, rest = F.call_function("div", scaled, unit), scaled % unit
    half = F.lit(1 << 52)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + up.cast("bigint")) / F.lit(1000.0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and twelve hex digits of the parts' SHA-1."""
    joined = F.concat_ws("||", *[text(p) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined), 1, 12))


def split_keywords(c: Column) -> Column:
    """Keywords of a string split at ; , and |, trimmed, without blanks."""
    return clean_list(F.split(text(c), r"[;,|]"))


def clean_list(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda x: x != "")


def runs(c: Column) -> Column:
    """Runs of ASCII letters, digits, underscores and hyphens, as they stand."""
    return F.regexp_extract_all(text(c), F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits, underscores and hyphens; lower-cased after they are found."""
    return F.transform(runs(c), F.lower)


def has_any(lowered: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(lowered, F.lit(p))
    return out


def first_label(lowered: Column, cases: Sequence[tuple[str, Sequence[str]]], default: Column | str) -> Column:
    """The label of the first case with a phrase in the lower-cased text."""
    out = default if isinstance(default, Column) else F.lit(default)
    for label, phrases in reversed(cases):
        out = F.when(has_any(lowered, phrases), F.lit(label)).otherwise(out)
    return out
