"""Random numbers that are a function of their key: no partitioning or batch size changes a draw."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(seed: int, var: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(var), *(p.cast("string") for p in parts))


def uniforms(key: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1), from the first two 32-bit words of the key's MD5."""
    word = lambda at: (F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return word(1), word(9)


def normal(key: Column) -> Column:
    """A standard normal number by Box-Muller."""
    u, v = uniforms(key)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def student(key: Column, degrees: float) -> Column:
    """A Student number of any degrees of freedom, by Bailey's polar form of Box-Muller."""
    u, v = uniforms(key)
    return F.sqrt(F.lit(float(degrees)) * (F.pow(u, F.lit(-2.0 / degrees)) - 1)) * F.cos(F.lit(2 * math.pi) * v)


def normal_of(*parts: object) -> float:
    """normal(key_of(...)) on the driver."""
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    u, v = ((int(digest[a : a + 8], 16) + 0.5) / 2**32 for a in (0, 8))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
