"""Special functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function above 0: Stirling's series at x + 8, stepped down; to some 1e-13."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - F.lit(691 / 360360) / z**11
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.ln(product)
