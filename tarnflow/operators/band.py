"""Band join: two values differ by at most a width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, pair: tuple[str, str], width: float, also: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows with |left.a - right.b| <= width (and equal ``also`` pairs).

    Values fall into buckets of the width; a left row is matched with its own bucket and the two beside it, so the
    join is an equi-join on the bucket instead of a nested loop.  Null matches nothing.  Column names must differ.
    """
    if width < 0:
        raise ValueError("width >= 0")
    a, b = F.col(pair[0]), F.col(pair[1])
    # a little wider than the band, so that rounding can't push a partner two buckets away
    size = float(width) * (1 + 1e-9) if width else 1.0
    near = F.floor(a.cast("double") / size)
    lhs = left.where(a.isNotNull()).withColumn("__bucket", F.explode(F.array(near - 1, near, near + 1)))
    rhs = right.where(b.isNotNull()).withColumn("__at", F.floor(b.cast("double") / size))
    on = (F.col("__bucket") == F.col("__at")) & (F.abs(a - b) <= F.lit(width))
    for x, y in also or []:
        on &= F.col(x) == F.col(y)
    return lhs.join(rhs, on).drop("__bucket", "__at")
