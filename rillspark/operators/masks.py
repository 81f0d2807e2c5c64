"""Masks as flat arrays of cells, row by row: means, the majority mask, disagreement with it, density of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(cells: Column) -> Column:
    """The share of cells that are set; null for a mask without cells."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) / F.nullif(F.size(cells), F.lit(0))


def _differing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def disagreement(cells: Column, reference: Column) -> Column:
    """The share of cells that differ from a mask of the same shape."""
    return _differing(cells, reference) / F.nullif(F.size(cells), F.lit(0))


def edge_density(cells: Column, width: Column) -> Column:
    """Half the share of neighbours in a row that differ plus half that of neighbours in a column; null where a mask has one row or column."""
    n = F.size(cells)
    # pairs of a cell and the next one, without those that end a row
    flips = F.zip_with(F.slice(cells, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(cells, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: x != y)
    across = F.size(F.filter(flips, lambda d, i: d & (F.pmod(i + 1, width) != 0)))
    down = _differing(F.slice(cells, F.lit(1), F.greatest(n - width, F.lit(0))), F.slice(cells, width + 1, F.greatest(n - width, F.lit(0))))
    height = n / width
    return (across / F.nullif(height * (width - 1), F.lit(0.0)) + down / F.nullif(width * (height - 1), F.lit(0.0))) / 2


def majority(masks: DataFrame, width: str, cells: str) -> DataFrame:
    """width, n, reference: for each shape the mask of cells that are set in half of the masks or more.

    Cells are summed by place over all masks before they meet; a reference is as long as one mask.
    """
    each = masks.select(width, F.size(cells).alias("n"), F.posexplode(cells).alias("place", "cell"))
    share = each.groupBy(width, "n", "place").agg((F.avg("cell") >= 0.5).cast("int").alias("cell"))
    return share.groupBy(width, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]).alias("reference"))


def measured(masks: DataFrame, key: str, width: str, cells: str) -> DataFrame:
    """key, mean, disagreement with the majority mask of the same shape, edge_density."""
    sized = masks.where(F.size(cells) > 0).withColumn("n", F.size(cells))
    both = sized.join(majority(masks, width, cells), [width, "n"])
    return both.select(key, mean(F.col(cells)).alias("mean"), disagreement(F.col(cells), F.col("reference")).alias("disagreement"), edge_density(F.col(cells), F.col(width)).alias("edge_density"))
