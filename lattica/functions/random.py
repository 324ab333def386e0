"""Portable randomness: uniforms that depend on a seed and a key only, not on partitioning, and agree with SQL engines."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(seed: int | Column, *key: Column | str) -> Column:
    """52 bits of md5(seed|key...), as a double in [0, 1)."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def exponential(seed, *key) -> Column:
    return -F.log(1 - uniform(seed, *key))


def normal(seed, *key) -> Column:
    """Box-Muller, from two uniforms of the key."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, *key, F.lit("r"))))
    return radius * F.cos(2 * math.pi * uniform(seed, *key, F.lit("a")))
