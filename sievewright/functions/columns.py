"""Column helpers with the arithmetic and text rules of the scoring rules: half-up rounding, blanks as null, US money."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(now: datetime | str) -> Column:
    """A clock as a timestamp literal; every operator that needs the time takes it as a parameter."""
    return F.lit(now).cast("timestamp")


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, also below zero."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5).cast("double") / scale


def round2(c: Column) -> Column:
    return round_half_up(c, 2)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


#: The characters that count as white space at the ends of a text (Unicode's White_Space).
BLANKS = "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text(c: Column | str) -> Column:
    """Trimmed of any white space; blank is null."""
    return F.nullif(F.trim(as_column(c), F.lit(BLANKS)), F.lit(""))


def vocabulary(c: Column | str) -> Column:
    """Controlled vocabulary: trimmed, lower case, blank is null."""
    return F.lower(text(c))


#: The dashes that count as a hyphen, U+2010 to U+2015.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015"


def normal(c: Column | str) -> Column:
    """Text for comparison: dashes as hyphens, lower case, single blanks, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(as_column(c).cast("string"), F.lit("")), DASHES, "-" * len(DASHES))), r"(?U)\s+", " "))


def zip5(c: Column | str) -> Column:
    """The first five digits of a zip code, or empty."""
    digits = F.regexp_replace(normal(c), "[^0-9]", "")
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5)).otherwise("")


def district_token(c: Column | str) -> Column:
    """A district's bare number, without leading zeros, or a neighbourhood's normal name."""
    bare = F.regexp_replace(normal(c), r"^(?:supervisor\s+)?district\s+", "")
    return F.regexp_replace(bare, r"^0+(?=[0-9]+$)", "")


def number(c: Column | str) -> Column:
    """A plain decimal after dropping dollar signs, commas and white space; anything else is null."""
    bare = F.regexp_replace(as_column(c), r"(?U)[$,\s]", "")
    return F.when(bare.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), bare.cast("double"))


def integer(c: Column | str) -> Column:
    value = number(c)
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")


def usd(c: Column) -> Column:
    """$1,234,567, rounded half up."""
    whole = F.floor(c + 0.5).cast("long")
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(whole), 0))


def multiple(ratio: Column) -> Column:
    """12x where two decimals are zero, 1.25x otherwise."""
    two = round2(ratio)
    whole = F.floor(two).cast("long").cast("string")
    return F.concat(F.when(two == F.floor(two), whole).otherwise(F.format_string("%.2f", two)), F.lit("x"))


def project_value(c: Column) -> Column:
    """$8.3M from a million on, $450k below; null if there is none."""
    millions = F.format_string("%.1f", round_half_up(c / 1e6, 1))
    millions = F.regexp_replace(millions, r"\.0$", "")
    return F.when(c >= 1e6, F.concat(F.lit("$"), millions, F.lit("M"))).when(c > 0, F.concat(F.lit("$"), F.floor(c / 1e3 + 0.5).cast("long").cast("string"), F.lit("k")))


def days_between(now: Column, ts: Column) -> Column:
    """Elapsed days as a double."""
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def days_since(now: Column, ts: Column) -> Column:
    """Whole elapsed days, rounded down."""
    return F.floor(days_between(now, ts)).cast("int")


def recency(days: Column) -> Column:
    """today, yesterday, 3 days ago, 2 weeks ago, 5 months ago."""
    return (
        F.when(days.isNull(), None).when(days <= 0, "today").when(days == 1, "yesterday").when(days < 14, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 60, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
    )
