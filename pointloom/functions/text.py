"""Sizes with suffixes, names that sort naturally, and other small text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def parse_capacity(text: str) -> int:
    """Bytes of a whole number with an optional suffix B, K, M or G."""
    found = re.fullmatch(r"(\d+)([BKMG]?)", text.strip(), re.IGNORECASE)
    if not found or int(found[1]) * UNITS[(found[2] or "B").upper()] >= 1 << 64:
        raise ValueError(f"not a capacity: {text!r}")
    return int(found[1]) * UNITS[(found[2] or "B").upper()]


def format_capacity(size: int) -> str:
    """With the largest suffix that leaves a whole number."""
    unit = next(u for u in "GMKB" if size % UNITS[u] == 0 and (size or u == "B"))
    return f"{size // UNITS[unit]}{unit}"


def natural_order(name: Column) -> list[Column]:
    """Order of worker names: by the stem, then by a number after the last point; names without a number first."""
    return [F.regexp_replace(name, r"\.\d+$", ""), F.try_to_number(F.regexp_extract(name, r"\.(\d+)$", 1), F.lit("999999999999999999")).asc_nulls_first()]
