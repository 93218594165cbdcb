"""Text helpers: machine-id decoding, typed coalesce, tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The serial decoding pattern of the source (a station code, a
# dash, then the hopper number), e.g. '10002-004' -> hopper '004' -> '4'.
SERIAL_PATTERN = r"^[a-zA-Z0-9_.+-]+\-([a-zA-Z0-9-.]+$)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regexp_extract_or_null(col, pattern: str, group: int = 1) -> Column:
    """REGEXP_EXTRACT with BigQuery's null-on-no-match (Spark returns '')."""
    c = _c(col)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def ltrim_chars(col, chars: str) -> Column:
    """LTRIM(s, chars): strip any of ``chars`` from the left."""
    return F.ltrim(_c(col), F.lit(chars))


def decode_hopper(col, pattern: str = SERIAL_PATTERN) -> Column:
    """LTRIM(REGEXP_EXTRACT(serial, pattern), '0')."""
    return ltrim_chars(regexp_extract_or_null(col, pattern), "0")


def safe_decimal(col, precision: int = 38, scale: int = 9) -> Column:
    """SAFE_CAST(x AS NUMERIC): null instead of an error on bad text."""
    return _c(col).try_cast(f"decimal({precision},{scale})")


def coalesce_as_string(*cols) -> Column:
    """first non-null of several typed columns, each cast to string."""
    return F.coalesce(*[_c(c).cast("string") for c in cols])


def first_word(col) -> Column:
    """``str.split(' ').str[0]``."""
    return F.split(_c(col), " ").getItem(0)


def substr_from_marker(col, marker: str, length: int) -> Column:
    """Oracle SUBSTR(s, INSTR(s, marker), n); INSTR 0 acts as position 1."""
    c = _c(col)
    pos = F.greatest(F.instr(c, marker), F.lit(1))
    return F.substr(c, pos, F.lit(length))
