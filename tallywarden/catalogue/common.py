"""Helpers the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def rounded(name: str | Column, digits: int = 4, alias: str | None = None) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    if isinstance(name, str):
        return (F.round(F.col(name), digits) + F.lit(0.0)).alias(alias or name)
    return (F.round(name, digits) + F.lit(0.0)).alias(alias)
