"""Reproducible draws: draw i of a seed is a hash, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import big_endian


def unit(identity: Column, seed: Column, index: Column) -> Column:
    """Uniform in [0, 1) from the top 53 bits of H(identity, seed, index)."""
    text = F.sha2(F.concat(identity, big_endian(seed, 8), big_endian(index, 4)), 256)
    top = F.conv(F.substring(text, 1, 14), 16, 10).cast("bigint")
    return F.shiftright(top, 3).cast("double") / float(2**53)


def in_range(draw: Column, low: Column, high: Column) -> Column:
    return low + draw * (high - low)


def integer(draw: Column, low: Column, high: Column) -> Column:
    """Integer in [ceil(low), floor(high)]; the lower bound when that is empty."""
    first, last = F.ceil(low), F.floor(high)
    return F.when(last < first, first).otherwise(first + F.floor(draw * (last - first + 1))).cast("bigint")


def pick(draw: Column, size: Column) -> Column:
    """0-based position of the picked element."""
    return F.least(F.floor(draw * size), size - 1).cast("bigint")
