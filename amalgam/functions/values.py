"""Spellings of entity ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "Ｓｓ０１２３４５６７８９－"
NARROW = "Ss0123456789-"


def clean_id(c: Column, source: int = 2) -> Column:
    """S2-000002180 for ' s2–2180 ', 'S2_000002180', full-width and other spellings; the trimmed text where no number is found."""
    at = F.upper(F.translate(c, WIDE, NARROW))
    digits = F.regexp_extract(at, rf"^[^0-9A-Z]*S[^0-9A-Z]*{source}[^0-9A-Z]*([0-9]+)[^0-9A-Z]*$", 1)
    padded = F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)
    return F.when(digits != "", F.concat(F.lit(f"S{source}-"), padded)).otherwise(F.trim(c))
