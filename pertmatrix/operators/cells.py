"""Per-cell operators: library sizes, scaling, labels, counts-state checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from pertmatrix.functions.columns import is_whole, per_library
from pertmatrix.matrix import CONTROL, CountMatrix, packed_cells
from pertmatrix.operators.ranking import exact_quantiles
from pertmatrix.session import materialized

RAW = "raw_counts"
TRANSFORMED = "transformed"


def cell_libsize(matrix: CountMatrix) -> DataFrame:
    """Every cell with its total; a cell without entries has 0."""
    if matrix.rows is not None:
        return matrix.rows.drop("entries")
    totals = matrix.expr.groupBy("cell_id").agg(F.sum("value").alias("libsize"))
    return matrix.cells.join(totals, "cell_id", "left").withColumn(
        "libsize", F.coalesce("libsize", F.lit(0.0))
    )


def with_libsize(expr: DataFrame) -> DataFrame:
    """Entries with their cell's total, and ``leads``: true for one entry of each cell.

    Cells hold at most one entry per gene, so windows are small. Counting leading entries counts
    cells in any later aggregation, without a distinct.
    """
    cell = W.partitionBy("cell_id")
    return expr.withColumns({
        "libsize": F.sum("value").over(cell), "leads": F.col("gene") == F.min("gene").over(cell),
    })


def labelled(matrix: CountMatrix) -> DataFrame:
    """Entries with libsize and the cell's own columns. Cells without any count drop out.

    Entries meet their cells before totals are taken, and the cell's labels are part of the window's key: so a
    filter on a label or context passes below both to the cells, and few wanted cells cut the entries before
    any of them is shuffled. Packed rows need no window: each has its total, and its first entry leads.
    """
    if matrix.rows is not None:
        return row_entries(matrix.rows)
    labels = [c for c in ("target_gene", "context", "batch") if c in matrix.cells.columns]
    cell = W.partitionBy("cell_id", *labels)
    joined = matrix.expr.join(matrix.cells, "cell_id")
    return joined.withColumns({
        "libsize": F.sum("value").over(cell), "leads": F.col("gene") == F.min("gene").over(cell),
    }).filter("libsize > 0")


def row_entries(rows: DataFrame) -> DataFrame:
    """``labelled`` entries of packed rows, without a shuffle."""
    carried = [c for c in rows.columns if c != "entries"]
    each = rows.filter("libsize > 0").select(*carried, F.posexplode("entries").alias("_at", "_e"))
    return each.select(*carried, F.col("_e.gene").alias("gene"), F.col("_e.value").alias("value"), (F.col("_at") == 0).alias("leads"))


def rows_written(matrix: CountMatrix) -> CountMatrix:
    """The matrix with its packed rows written once, for plans that pass over the entries more than once.

    Every pass over rows that are not written sums and packs the entries anew; filters on labels and contexts reach written ones.
    """
    rows = matrix.rows if matrix.rows is not None else packed_cells(matrix.cells, matrix.expr)
    return CountMatrix(matrix.cells, matrix.genes, matrix.expr, materialized(rows, "packed-rows"))


def scaled(entries: DataFrame, target: float, *, out: str = "value") -> DataFrame:
    """value / libsize * target."""
    return entries.withColumn(out, per_library(F.col("value"), F.col("libsize"), target))


def log_normalized(entries: DataFrame, target: float = 1e4) -> DataFrame:
    """Library-size normalised log1p. Zero stays zero, so the result is as sparse as the input."""
    return entries.withColumn("value", F.log1p(per_library(F.col("value"), F.col("libsize"), target)))


def filter_empty(matrix: CountMatrix) -> DataFrame:
    """Cells with a positive total."""
    return cell_libsize(matrix).filter("libsize > 0")


def filter_min_libsize(cells: DataFrame, minimum: float) -> DataFrame:
    """Strictly more than max(minimum, 0)."""
    return cells.filter(F.col("libsize") > max(minimum, 0.0))


def filter_libsize_quantiles(cells: DataFrame, lo: float, hi: float, by: str = "context") -> DataFrame:
    """Cells whose total lies within the group's linear quantiles, both ends included.

    Quantiles are selected, not buffered, so totals may be of any kind. The limits are written out first: with
    their true size known, the join does not shuffle the cells.
    """
    limits = materialized(exact_quantiles(cells, [by], "libsize", (lo, hi)), "limits")
    return (
        cells.join(limits, by)
        .filter(F.col("libsize").between(F.col("q")[0], F.col("q")[1]))
        .drop("q")
    )


def counts_state(matrix_expr: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: n_cells, min_value, min_total, max_total, integral, state.

    Transformed when a value is negative, when all totals agree with a positive total, or when a
    value is fractional. An empty matrix has a NULL state.
    """
    totals = matrix_expr.groupBy("cell_id").agg(
        F.sum("value").alias("total"),
        F.min("value").alias("lo"),
        F.min(is_whole(F.col("value"))).alias("whole"),
    )
    return _state_of(cells.select("cell_id").join(totals, "cell_id", "left").select(
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("lo", F.lit(0.0)).alias("lo"),
        F.coalesce("whole", F.lit(True)).alias("whole"),
    ))


def rows_state(rows: DataFrame) -> DataFrame:
    """``counts_state`` of packed rows, each of which is looked at alone."""
    values = F.transform("entries", lambda e: e["value"])
    return _state_of(rows.select(F.col("libsize").alias("total"), F.coalesce(F.array_min(values), F.lit(0.0)).alias("lo"), F.forall(values, is_whole).alias("whole")))


def _state_of(per_cell: DataFrame) -> DataFrame:
    """The state from total, lo and whole of every cell."""
    summary = per_cell.agg(
        F.count("*").alias("n_cells"),
        F.least(F.min("lo"), F.lit(0.0)).alias("min_value"),
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        F.min("whole").alias("integral"),
    )
    constant = (F.col("n_cells") > 1) & (F.col("min_total") > 0) & (
        F.col("max_total") - F.col("min_total") <= F.lit(1e-8) + F.lit(1e-5) * F.col("min_total")
    )
    state = (
        F.when(F.col("n_cells") == 0, F.lit(None).cast("string"))
        .when((F.col("min_value") < 0) | constant | ~F.col("integral"), F.lit(TRANSFORMED))
        .otherwise(F.lit(RAW))
    )
    return summary.withColumn("state", state)


def require_raw_counts(matrix: CountMatrix, where: str) -> None:
    """Raise unless the matrix holds raw counts. Runs a job; the result is one row."""
    _require_raw(counts_state(matrix.expr, matrix.cells).first(), where)


def _require_raw(row: Row, where: str) -> None:
    if row.state is None:
        raise ValueError(f"{where}: the matrix is empty, its state cannot be told")
    if row.state != RAW:
        raise ValueError(f"{where}: expected raw integer counts, found {row.state}")


def cp10k(matrix: CountMatrix) -> DataFrame:
    """Counts per 10,000. Refuses data that are not raw counts, and cells without any count.

    Entries are packed by cell once, if they are not; the check and the scaling read the rows, without a shuffle.
    """
    rows = matrix.rows if matrix.rows is not None else rows_written(matrix).rows
    state = rows_state(rows).first()
    _require_raw(state, "cp10k")
    if state.min_total == 0:
        raise ValueError("cp10k: cells with zero total counts cannot be scaled; filter them first")
    return scaled(row_entries(rows), 1e4)


def control_cells(cells: DataFrame, control: str = CONTROL, label: str = "target_gene") -> DataFrame:
    """Cells whose label equals the control label exactly. Raises when there are none."""
    found = cells.filter(F.col(label) == control)
    if found.isEmpty():
        near = [r[0] for r in near_control_labels(cells, control, label).collect()]
        raise ValueError(f"control label {control!r} is on no cell; matching is exact" + (f". Similar labels: {near}" if near else ""))
    return found


def near_control_labels(cells: DataFrame, control: str, label: str = "target_gene", limit: int = 5) -> DataFrame:
    """Up to five labels that contain the text, whatever the case, without being the label itself."""
    hit = F.contains(F.lower(label), F.lit(control.lower())) & (F.col(label) != control)
    return cells.filter(hit).select(label).distinct().orderBy(label).limit(limit)


def relabel_control(cells: DataFrame, old: str, new: str, label: str = "target_gene") -> DataFrame:
    return cells.withColumn(label, F.when(F.col(label) == old, F.lit(new)).otherwise(F.col(label)))


def filter_labels(
    cells: DataFrame, keep: DataFrame | None = None, skip: DataFrame | None = None, label: str = "target_gene"
) -> DataFrame:
    """Cells whose label is in ``keep`` and not in ``skip`` (one-column label tables)."""
    return _by_lists(cells, *_lists(keep, skip, label), label)


def filter_matrix(matrix: CountMatrix, keep: DataFrame | None = None, skip: DataFrame | None = None, label: str = "target_gene") -> CountMatrix:
    """:func:`filter_labels` on the cells of a matrix and on its packed rows; each list is written once."""
    lists = _lists(keep, skip, label)
    rows = None if matrix.rows is None else _by_lists(matrix.rows, *lists, label)
    return CountMatrix(_by_lists(matrix.cells, *lists, label), matrix.genes, matrix.expr, rows)


def _lists(keep: DataFrame | None, skip: DataFrame | None, label: str) -> tuple[DataFrame | None, ...]:
    return tuple(None if x is None else label_list(x, label) for x in (keep, skip))


def _by_lists(cells: DataFrame, keep: DataFrame | None, skip: DataFrame | None, label: str) -> DataFrame:
    if keep is not None:
        cells = cells.join(keep, label, "left_semi")
    if skip is not None:
        cells = cells.join(skip, label, "left_anti")
    return cells


def label_list(labels: DataFrame, label: str = "target_gene") -> DataFrame:
    """The distinct labels of a one-column table, written once.

    With its true size known, Spark can broadcast the list instead of shuffling all cells by label.
    """
    return materialized(labels.select(F.col(labels.columns[0]).alias(label)).distinct(), "label-list")


def cap_row_total(entries: DataFrame, cap: float, keys: list[str]) -> DataFrame:
    """Rows of a cell whose total is over the cap become floor(value * cap / total); zeros drop."""
    total = F.sum("value").over(W.partitionBy(*keys))
    cut: Column = F.floor(F.col("value") * F.lit(float(cap)) / F.col("_total")).cast("double")
    return (
        entries.withColumn("_total", total)
        .withColumn("value", F.when(F.col("_total") > cap, cut).otherwise(F.col("value")))
        .filter("value > 0")
        .drop("_total")
    )
