"""Percentages rounded half up, computed on integers so that every engine agrees."""

from pyspark.sql import functions as F

from logweave.model import ERROR_LEVELS


def is_error(level="level"):
    return F.col(level).isin(ERROR_LEVELS)


def rate_pct(errors, total):
    """``errors / total * 100`` to two decimals, half up; 0 when there is nothing.

    ``errors`` and ``total`` are names of bigint columns.
    """
    return F.expr(f"(({errors} * 20000 + {total}) div greatest(2 * {total}, 1)) / 100.0D")
