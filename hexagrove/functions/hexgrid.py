"""Cell arithmetic of the hierarchical hexagon index, as bit expressions on ``BIGINT`` columns.

A cell id holds its resolution in bits 52-55, its base cell in bits 45-51 and one base-7 digit of three
bits for each level below; levels finer than the cell are all ones. Everything here stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTION_MASK = 15 << 52
#: Average cell area in square kilometres by resolution (fixed values of the index, rounded).
CELL_AREA_KM2 = {6: 36.1, 7: 5.16, 8: 0.737, 9: 0.105, 10: 0.015}


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(long(15)).cast("int")


def unused_bits(level: int) -> int:
    return (1 << (3 * (15 - level))) - 1


def parent(cell: Column, level: int) -> Column:
    """The cell of resolution ``level`` that holds ``cell``."""
    cleared = cell.bitwiseAND(long(~RESOLUTION_MASK))
    return cleared.bitwiseOR(long((level << 52) | unused_bits(level)))


def center_child(cell: Column, level: int) -> Column:
    """The child at ``level`` in the middle: all new digits 0. ``cell`` must be coarser or equal."""
    old = (15 - resolution(cell)) * 3
    below = F.expr("1L") * 0 + F.call_function("shiftleft", long(1), old) - 1
    cleared = cell.bitwiseAND(long(~RESOLUTION_MASK)).bitwiseAND(F.bitwise_not(below))
    return cleared.bitwiseOR(long((level << 52) | unused_bits(level)))


def children(df: DataFrame, cell: str, fine: int, coarse: int, out: str = "child") -> DataFrame:
    """One row for each child; hexagons only (a pentagon has no digit 1). Explodes level by level."""
    df = df.withColumn(out, F.col(cell))
    for level in range(coarse + 1, fine + 1):
        shift = 3 * (15 - level)
        base = F.col(out).bitwiseAND(long(~RESOLUTION_MASK & ~(7 << shift))).bitwiseOR(long(level << 52))
        df = df.withColumn(out, F.explode(F.array(*(base.bitwiseOR(long(d << shift)) for d in range(7)))))
    return df


def child_count(coarse: int, fine: int, pentagon: bool = False) -> int:
    """How many children a cell has: 7 a level, in a pentagon one missing direction a level."""
    n = 7 ** (fine - coarse)
    return 1 + 5 * (n - 1) // 6 if pentagon else n


def text_id(cell: Column) -> Column:
    """The 15-digit lower-case hexadecimal form."""
    return F.lower(F.hex(cell))


def from_text(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def synthetic_cell(key: Column, level: int = 9, base: int = 15, digits: int = 7) -> Column:
    """A cell of base cell ``base`` whose last digits spell ``key`` in base 7: a test grid."""
    cell = long((1 << 59) | (level << 52) | (base << 45) | unused_bits(level))
    shift = 3 * (15 - level)
    k = key.cast("long")
    for i in range(digits):
        digit = F.pmod(F.floor(k / F.lit(7**i)), F.lit(7)).cast("long")
        cell = cell.bitwiseOR(F.call_function("shiftleft", digit, F.lit(shift + 3 * i)))
    return cell


def axial(key: Column, width: int) -> tuple[Column, Column]:
    """Axial coordinates of ``key`` on a rhombus of hexagons ``width`` cells wide."""
    return F.pmod(key, F.lit(width)).cast("int"), F.floor(key / width).cast("int")


#: The six neighbours of an axial hexagon.
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def neighbours(df: DataFrame, q: str = "q", r: str = "r") -> DataFrame:
    """Six rows for each row, with the neighbour's coordinates in ``nq`` and ``nr``."""
    steps = F.array(*(F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in DIRECTIONS))
    return df.withColumn("step", F.explode(steps)).withColumn("nq", F.col(q) + F.col("step.dq")).withColumn("nr", F.col(r) + F.col("step.dr")).drop("step")
