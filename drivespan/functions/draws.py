"""Random draws that follow from a seed and keys, the same on every run, cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1): the first 32 bits of the MD5 of the seed and the keys as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
