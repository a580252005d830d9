"""Random numbers that depend on the row's key, not on where the row is processed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    """Uniform in [0, 1), fixed by the given key parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def normal(*parts: Column | int | str) -> Column:
    """Standard normal, fixed by the given key parts."""
    radius = F.sqrt(-2.0 * F.ln(F.lit(1.0) - uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "a"))
