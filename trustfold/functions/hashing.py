"""Reproducible randomness: every draw is a hash of the row's own key.

A draw never depends on partitioning, task order or retries, so a lost
executor recomputes the very same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def order_key(*parts: Column | str | int) -> Column:
    """Hex digest to sort by; its leading digits are uniform, so they also cut a group into even slices."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the key's digest."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal draw (Box-Muller on two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "a") + F.lit(1e-12)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "b"))

