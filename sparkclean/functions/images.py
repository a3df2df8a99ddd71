"""Difference hashes, Hamming distances and quality signals of grey-scale grids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey_cells(image: Column, width: int, height: int) -> Column:
    """``height`` rows of ``width`` cells, each the rounded mean of its box of pixels; null for an image smaller than that.

    ``image`` is an array of equally long rows. The sums of a row's boxes are taken first, then those of a box's rows, so
    each pixel is read once and nothing leaves the row.
    """
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  worked out once, used often
    edges = lambda n, cells: F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda i: F.ceil(i * n / cells).cast("int"))
    boxes = lambda n, cells: bind(edges(n, cells), lambda e: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.struct((F.get(e, i) + 1).alias("at"), (F.get(e, i + 1) - F.get(e, i)).alias("n"))))
    zero = F.lit(0).cast("long")

    def cells(b: Column) -> Column:
        sums = F.transform(b["image"], lambda row: F.transform(b["columns"], lambda x: F.aggregate(F.slice(row, x["at"], x["n"]), zero, lambda acc, v: acc + v)))
        box = lambda s, y, c: F.aggregate(F.slice(s, y["at"], y["n"]), zero, lambda acc, row: acc + F.get(row, c))
        mean = lambda s, y, x, c: F.round(box(s, y, c) / (y["n"] * x["n"])).cast("int")
        return bind(sums, lambda s: F.transform(b["rows"], lambda y: F.transform(b["columns"], lambda x, c: mean(s, y, x, c))))

    def fits(i: Column) -> Column:
        parts = F.struct(i.alias("image"), boxes(F.size(i), height).alias("rows"), boxes(F.size(F.get(i, F.lit(0))), width).alias("columns"))
        return F.when((F.size(i) >= height) & (F.size(F.get(i, F.lit(0))) >= width), bind(parts, cells))

    return bind(image, fits)


def dhash(grid: Column) -> Column:
    """64 bits: bit ``8 * row + col`` is one where a cell is darker than its right neighbour; null unless 8 x 9 cells."""
    whole = (F.size(grid) == 8) & F.forall(grid, lambda row: F.size(row) == 9)
    cell = lambda i, right: F.get(F.get(grid, F.floor(i / 8).cast("int")), (i % 8 + right).cast("int"))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(cell(i, 0) < cell(i, 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    return F.when(whole, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_similar(a: Column, b: Column, limit: int = 5) -> Column:
    return hamming(a, b) <= limit


def laplacian_variance(grid: Column) -> Column:
    """Population variance of the four-neighbour Laplacian over the inner cells; 0 for a null grid or a side under 3."""
    at = lambda y, x: F.get(F.get(grid, y.cast("int")), x.cast("int")).cast("double")
    height, width = F.size(grid), F.size(F.get(grid, F.lit(0)))
    inside = lambda n: F.sequence(F.lit(1), n - 2)
    values = F.flatten(F.transform(inside(height), lambda y: F.transform(inside(width), lambda x: at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    mean = total(values) / F.size(values)
    variance = total(F.transform(values, lambda v: (v - mean) * (v - mean))) / F.size(values)
    return F.when(grid.isNotNull() & (height >= 3) & (width >= 3), variance).otherwise(0.0)


def exposure_score(grid: Column, dark: int = 10, bright: int = 245) -> Column:
    """One minus the share of cells darker than ``dark`` or brighter than ``bright``; 0 without cells."""
    cells = F.flatten(grid)
    clipped = F.size(F.filter(cells, lambda c: (c < dark) | (c > bright)))
    return F.when(F.size(cells) > 0, 1 - clipped / F.size(cells)).otherwise(0.0)


def resolution(width: Column, height: Column) -> Column:
    return width.cast("double") * height.cast("double")
