"""Risk score and the deterministic uniform draw."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadwatch.functions.fixed import LAMBDA, OFFENSIVE_THRESHOLD


def offensive_score(n: Column, n_off: Column, lambda1: float = LAMBDA) -> Column:
    """``atan(n_off/n + lambda*ln(n_off)) / (pi/2)``; 0 when n = 0 or n_off = 0."""
    raw = F.atan(n_off / n + F.lit(lambda1) * F.ln(n_off)) / F.lit(math.pi / 2)
    return F.when((n == 0) | (n_off == 0) | n.isNull() | n_off.isNull(), F.lit(0.0)).otherwise(raw)


def offensive_trigger(score: Column, threshold: float = OFFENSIVE_THRESHOLD) -> Column:
    """1 when the *unrounded* score exceeds the threshold."""
    return (score > F.lit(threshold)).cast("int")


def uniform(key: Column, seed: int | str) -> Column:
    """Deterministic U[0,1) from ``md5(key:seed)``; independent of partitioning.

    Unlike ``rand(seed)`` the value of a row does not depend on which
    partition it lands in, so a re-run (or a recomputed lost task) draws the
    same number.
    """
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sql_uniform(key_sql: str, seed: int | str) -> str:
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"
            f" / 4294967296.0)")


def sql_offensive_score(n: str, n_off: str, lambda1: float = LAMBDA) -> str:
    return (f"(CASE WHEN {n} = 0 OR {n_off} = 0 OR {n} IS NULL OR {n_off} IS NULL THEN 0.0 "
            f"ELSE atan({n_off} / {n} + {lambda1} * ln({n_off})) / (pi() / 2) END)")
