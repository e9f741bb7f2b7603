"""Opaque page tokens: the Base64 form of a decimal offset."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def page_token(offset: Column) -> Column:
    return F.base64(F.encode(offset.cast("string"), "UTF-8"))


def page_offset(token: Column) -> Column:
    """Offset held by a token; 0 for anything that is not a whole, non-negative int."""
    text = F.try_to_binary(token, F.lit("base64")).cast("string")
    number = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0))
