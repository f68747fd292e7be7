"""Priorities: pseudo-random order that is a function of the seed and a row's ids only.

The same row has the same priority in every run, task, retry and micro-batch, so samples
taken by priority are reproducible, mergeable and safe when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = 15  # 60 bits


def priority(seed: int | str, *ids: Column | str) -> Column:
    """Hexadecimal digest of the seed and the ids (integers or strings)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(i) if isinstance(i, str) else i).cast("string"), F.lit("")) for i in ids]))


def fraction_bound(p: float) -> str | None:
    """The digest below which a share p of all priorities lies; None for all of them."""
    if p >= 1:
        return None
    return f"{int(max(p, 0.0) * 2 ** (4 * HEX)):0{HEX}x}"


def unit_below(p: float, seed: int | str, *ids: Column | str) -> Column:
    """True for a share p of the rows, each by itself."""
    bound = fraction_bound(p)
    return F.lit(True) if bound is None else priority(seed, *ids) < bound


def draw(seed: int | str, n: int, *ids: Column | str) -> Column:
    """An integer in [0, n) for each row, uniform up to n / 2^120: a bigint, for n of 2^63 or more a decimal(38,0)."""
    if n >= 1 << 116:
        raise ValueError("n must be below 2^116")
    h = priority(seed, *ids)
    hi, lo = (F.conv(F.substring(h, at, HEX), 16, 10).cast("decimal(19,0)") for at in (1, HEX + 1))
    big = F.lit(str(n)).cast("decimal(38,0)")
    if n < 1 << 60:
        return (hi.cast("decimal(38,0)") % big).cast("bigint")
    whole = (hi * F.lit(str(1 << 60)).cast("decimal(19,0)")).cast("decimal(38,0)") + lo
    out = whole.cast("decimal(38,0)") % big
    return out.cast("bigint") if n < 1 << 63 else out.cast("decimal(38,0)")
