"""UTF-8 helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_points(text: Column) -> Column:
    """Length in code points, the unit of the wildcard ``_``."""
    return F.char_length(text)


def valid_text(data: Column) -> Column:
    """Bytes as text where they are valid UTF-8, with U+FFFD in place of what is not."""
    return F.make_valid_utf8(data.cast("string"))


def is_text(data: Column) -> Column:
    """Whether bytes are valid UTF-8."""
    return F.is_valid_utf8(data.cast("string"))


def strict_text(data: Column) -> Column:
    """Bytes as text; raises where they are not valid UTF-8."""
    return F.validate_utf8(data.cast("string"))
