"""Joins of many rows with a few rows per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 8


def join_salted(
    many: DataFrame, few: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join in which one key may hold a third of ``many``.

    Rows of a hot key are spread over salts by ``spread_by``; ``few`` is repeated per salt.
    ``few`` is never broadcast: it has a row per source and salt, and its few compressed megabytes would be
    hundreds in the driver. The salt is part of both shuffles, so even a side that is already partitioned by the
    key gets an exchange of its own and adaptive execution can split whatever is still too large.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    repeated = few.withColumn("_salt", F.explode(F.lit(list(range(salts)))))
    return many.withColumn("_salt", salt).join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def join_shuffled(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of sides that both grow with the sources, so that neither is gathered in the driver for a broadcast."""
    return left.join(right.hint("merge"), on if isinstance(on, str) else list(on), how)
