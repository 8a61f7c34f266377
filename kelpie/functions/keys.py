"""Normal forms of identifiers and names, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters Unicode counts as white space.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def norm_id(c: Column | str) -> Column:
    """Trimmed and in lower case; blank is null."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


def norm_metric(c: Column | str) -> Column:
    """Trimmed, in lower case, hyphens and spaces as underscores; blank is null."""
    return F.nullif(F.translate(F.lower(stripped(c)), "- ", "__"), F.lit(""))


def usable(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def epoch_us(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
