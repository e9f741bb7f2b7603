"""Text rules shared by every validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLANK = "".join(chr(code) for code in range(0x21))


def strip_blank(text: Column) -> Column:
    """Drop every leading and trailing character up to U+0020; a no-break space stays."""
    return F.btrim(text, F.lit(_BLANK))


def units(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2
