"""Address arithmetic as column expressions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCKS_PER_SEGMENT, SECTORS_PER_BLOCK, WORD_BITS


def whole(a: Column, n: int) -> Column:
    """Integer quotient of non-negative longs."""
    a = a.cast("long")
    return F.call_function("div", a, F.lit(n).cast("long")) if n & (n - 1) else F.shiftright(a, n.bit_length() - 1)


def sector_to_block(sector: Column) -> Column:
    return whole(sector, SECTORS_PER_BLOCK)


def block_to_segment(block: Column, per_segment: int = BLOCKS_PER_SEGMENT) -> Column:
    return whole(block, per_segment)


def offset_in_segment(block: Column, per_segment: int = BLOCKS_PER_SEGMENT) -> Column:
    return (block % F.lit(per_segment)).cast("long")


def bit_group(bit: Column) -> Column:
    return whole(bit, WORD_BITS)


def bit_offset(bit: Column) -> Column:
    return (bit % F.lit(WORD_BITS)).cast("long")


def overlaps(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Whether two closed intervals share a key."""
    return (first_a <= last_b) & (first_b <= last_a)
