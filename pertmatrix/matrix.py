"""The one data shape of this package: a labelled sparse count matrix as three tables.

``cells``  one row per cell: cell_id, cell_ord, target_gene, context, batch, ...
``genes``  the gene axis: gene_pos, gene, ensembl_id
``expr``   nonzero entries only: cell_id, gene, value

Zeros are implicit. Every mean or variance therefore divides by a count taken from ``cells``.

A matrix may also have its entries packed, one row per cell: ``rows`` holds the cell's own columns, libsize and
entries array<struct<gene, value>>. Totals and scaling are then local to a row, and no pass over the entries shuffles
or sorts them by cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.session import spread_width

CONTROL = "non-targeting"

# The gene axis travels as one array (a scalar subquery), so its size is checked.
MAX_AXIS = 1_000_000


@dataclass(frozen=True)
class CountMatrix:
    cells: DataFrame
    genes: DataFrame
    expr: DataFrame
    rows: DataFrame | None = None

    def where(self, condition: str | Column) -> CountMatrix:
        """The matrix of the cells that fit; packed rows are filtered alike, entries when they meet their cells."""
        return CountMatrix(self.cells.filter(condition), self.genes, self.expr, None if self.rows is None else self.rows.filter(condition))


def _checked_axis(genes: DataFrame) -> Column:
    """The axis as one array; longer ones are refused, and no more than one row above the bound is gathered."""
    axis = genes.limit(MAX_AXIS + 1).agg(
        F.when(F.count("*") <= MAX_AXIS, F.sort_array(F.collect_list(F.struct("gene_pos", "gene"))))
        .otherwise(F.raise_error(F.lit(f"gene axis is longer than {MAX_AXIS}")))
        .alias("axis")
    )
    return axis.scalar()


def axis_lookup(genes: DataFrame) -> DataFrame:
    """gene_pos, gene for joins with entries, marked for broadcast.

    The rows come out of the checked array, so there are at most MAX_AXIS of them. Without the mark
    Spark would see an aggregate of unknown size and shuffle all entries by gene, hot genes included.
    """
    one = genes.sparkSession.range(1, numPartitions=1)
    return F.broadcast(one.select(F.inline(_checked_axis(genes))))


def on_gene_axis(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """One output row per (row, gene): the zero-filled grid every cross-label statistic needs.

    ``rows`` holds labels, never cells. The axis is a checked, bounded array that each row
    explodes in place, so the grid needs no join. The few label rows are first spread over all
    shuffle partitions, because the grid is thousands of times larger than they are.
    """
    parts = spread_width(rows.sparkSession)
    return rows.repartition(parts, *rows.columns).select("*", F.inline(_checked_axis(genes)))


def packed_cells(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Every cell with libsize and its entries by gene, none and 0 for a cell without: the ``rows`` of a matrix.

    The one shuffle by cell that packing costs; a layout that is stored packed has it behind itself.
    """
    entry = F.sort_array(F.collect_list(F.struct("gene", "value")))
    packed = expr.groupBy("cell_id").agg(F.sum("value").alias("libsize"), entry.alias("entries"))
    filled = {"libsize": F.coalesce("libsize", F.lit(0.0)), "entries": F.coalesce("entries", F.array().cast("array<struct<gene:string,value:double>>"))}
    return cells.join(packed, "cell_id", "left").withColumns(filled)


def pack_rows(matrix: CountMatrix) -> DataFrame:
    """Triples to one sparse row per nonempty cell: cell_id, idx array<bigint>, val array<double>."""
    entry = F.sort_array(F.collect_list(F.struct("gene_pos", "value")))
    return (
        matrix.expr.join(axis_lookup(matrix.genes), "gene")
        .groupBy("cell_id")
        .agg(entry.alias("e"))
        .select("cell_id", F.col("e.gene_pos").alias("idx"), F.col("e.value").alias("val"))
    )


def unpack_rows(packed: DataFrame) -> DataFrame:
    """Sparse rows back to triples (cell_id, gene_pos, value); other layouts are refused."""
    kinds = dict(packed.dtypes)
    if not (kinds.get("idx", "").startswith("array") and kinds.get("val", "").startswith("array")):
        raise ValueError(f"expected sparse rows with idx and val arrays, found {kinds}")
    carried = [c for c in packed.columns if c not in ("idx", "val")]
    return packed.select(
        *carried, F.inline(F.arrays_zip(F.col("idx").alias("gene_pos"), F.col("val").alias("value")))
    )


def unpack_dense(rows: DataFrame, id_col: str, values_col: str) -> DataFrame:
    """Dense rows to nonzero triples (cell_id, gene_pos, value)."""
    return (
        rows.select(F.col(id_col).alias("cell_id"), F.posexplode(values_col).alias("gene_pos", "v"))
        .select("cell_id", F.col("gene_pos").cast("bigint"), F.col("v").cast("double").alias("value"))
        .filter("value != 0")
    )
