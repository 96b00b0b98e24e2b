"""Cleansing (P8-P10): sentinel fills and blank replacement.

Narrow, per-row projections: no shuffle, and Catalyst collapses a chain
of them into one ``Project`` inside the scan's codegen stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

# Fixed sentinels of the cleansing step.
NUMERIC_SENTINEL = -999.0
STRING_SENTINEL = "NULL"
BLANK_STRING_COLUMNS = ("channel", "attrs", "brand", "fastseller")   # "" → "NULL"
BLANK_ID_COLUMNS = ("productid", "sellerid")                         # "" → "-999"


def fill_numeric(df: DataFrame, value: float = NUMERIC_SENTINEL,
                 subset: Sequence[str] | None = None) -> DataFrame:
    """Null in every numeric column → ``value`` (cast to the column type)."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def fill_string(df: DataFrame, value: str = STRING_SENTINEL,
                subset: Sequence[str] | None = None) -> DataFrame:
    """Null in every string column → ``value``; blanks stay blank."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def replace_blank(df: DataFrame, mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """P10: replace the empty string per column set; nulls stay null.

    ``mapping`` is ``{replacement: columns}``; columns missing from ``df``
    are skipped.
    """
    if mapping is None:
        mapping = {STRING_SENTINEL: BLANK_STRING_COLUMNS, "-999": BLANK_ID_COLUMNS}
    for replacement, columns in mapping.items():
        present = [c for c in columns if c in df.columns]
        if present:
            df = df.na.replace({"": replacement}, subset=present)
    return df


def cleanse(df: DataFrame) -> DataFrame:
    """P10 → P8 → P9, the order used before indexing and assembling."""
    return fill_string(fill_numeric(replace_blank(df)))
