"""Joins beyond plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 32


def _cell(at: Column, size: int) -> Column:
    """The cell of a place; cells are of a power of two, so this is a shift, of negative places too."""
    return F.shiftright(at, size.bit_length() - 1)


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.sequence(_cell(low, size), _cell(high - 1, size))


def box_join(a: DataFrame, b: DataFrame, by: list[str], cell: int = CELL) -> DataFrame:
    """All pairs of boxes of one group that overlap, with the area they share: (by, a_id, b_id, area, inside), inside if
    the b box lies in the a box.

    Boxes are (by, id, x0, y0, x1, y1), half open. A box is put into every cell of a grid it touches and meets only the
    boxes of its cells; a pair is reported by the one cell that holds the corner of its overlap, so no pair is formed
    twice and nothing is made distinct afterwards. Empty boxes overlap nothing. Coordinates are whole numbers, `cell` is a
    power of two.
    """
    if cell < 1 or cell & (cell - 1):
        raise ValueError("cells are of a power of two")

    def gridded(df: DataFrame, side: str) -> DataFrame:
        held = df.where("x1 > x0 and y1 > y0").select(*by, *(F.col(c).alias(f"{side}_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
        wide = held.withColumn("cx", F.explode(_cells(F.col(f"{side}_x0"), F.col(f"{side}_x1"), cell)))
        return wide.withColumn("cy", F.explode(_cells(F.col(f"{side}_y0"), F.col(f"{side}_y1"), cell)))

    # exploded sides are many times the size that is estimated for them: they are merged, never broadcast
    met = gridded(a, "a").join(gridded(b, "b").hint("merge"), [*by, "cx", "cy"])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    right, bottom = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    here = (_cell(left, cell) == F.col("cx")) & (_cell(top, cell) == F.col("cy"))
    inside = (F.col("a_x0") <= F.col("b_x0")) & (F.col("a_y0") <= F.col("b_y0")) & (F.col("b_x1") <= F.col("a_x1")) & (F.col("b_y1") <= F.col("a_y1"))
    return met.where((right > left) & (bottom > top) & here).select(*by, "a_id", "b_id", ((right - left) * (bottom - top)).cast("long").alias("area"), inside.alias("inside"))


def window_hashes(text: Column, n: int = 13) -> Column:
    """Digests of all windows of n characters of a text, and of the text itself."""
    chars = F.split(text, "")
    grams = chars
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    whole = F.array(F.sha2(text, 256))
    return F.array_distinct(F.concat(whole, F.transform(F.array_compact(grams), lambda g: F.sha2(g, 256))))


def crossing(df: DataFrame, value: str, side: str) -> DataFrame:
    """(value, n_sides): values that occur on more than one side."""
    return df.where(F.col(value).isNotNull() & F.col(side).isNotNull()).groupBy(value).agg(F.countDistinct(side).alias("n_sides")).where("n_sides > 1")
