"""Predicted cells as integer counts around a context's control profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pertmatrix.functions.columns import finite_or_zero, rint
from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.matrix import CONTROL, on_gene_axis
from pertmatrix.operators.ranking import exact_quantiles
from pertmatrix.operators.sampling import explode_range

# The 16 largest primes below 2 ** 31.
STEPS = (
    2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497,
    2147483489, 2147483477, 2147483423, 2147483399, 2147483353, 2147483323, 2147483269, 2147483249,
)


def context_profile(
    entries: DataFrame, genes: DataFrame, *, min_libsize: float = 0.0, control: str = CONTROL
) -> tuple[DataFrame, DataFrame]:
    """(context, gene_pos, gene, fraction) and (context, cell_id, libsize) from the control cells.

    ``entries`` are raw counts with libsize. The fraction is the mean CPM scaled to sum 1.
    """
    kept = entries.filter((F.col("target_gene") == control) & (F.col("libsize") > max(min_libsize, 0.0)))
    cpm = kept.groupBy("context", "gene").agg(F.sum(F.col("value") / F.col("libsize") * 1e6).alias("cpm"))
    grid = on_gene_axis(kept.select("context").distinct(), genes)
    full = grid.join(cpm, ["context", "gene"], "left").fillna(0.0, ["cpm"])
    profile = normalize_within(full, "cpm", ["context"], "fraction").drop("cpm", "ensembl_id")
    libsizes = kept.groupBy("context", "cell_id").agg(F.max("libsize").alias("libsize"))
    return profile, libsizes


def normalize_within(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """value / group total; a group holds one row per gene."""
    return df.withColumn(out, F.col(value) / F.sum(value).over(W.partitionBy(*keys)))


def shift_fraction(profile: DataFrame, shifts: DataFrame) -> DataFrame:
    """context, target_gene, gene, fraction: profile * 2^shift, scaled to sum 1 again.

    ``shifts``: target_gene, gene, shift, and context where they differ by it; NULL, NaN and infinite shifts count as 0.
    """
    keys = [c for c in ("context", "gene") if c in shifts.columns]
    moved = profile.join(shifts.select(*keys, "target_gene", "shift"), keys).withColumn(
        "moved", F.col("fraction") * F.pow(F.lit(2.0), finite_or_zero(F.col("shift")))
    )
    return normalize_within(moved.drop("fraction"), "moved", ["context", "target_gene"], "fraction").select(
        "context", "target_gene", "gene_pos", "gene", "fraction"
    )


def median_depth(libsizes: DataFrame) -> DataFrame:
    """context, depth: the exact median, selected without a buffer of all totals."""
    return exact_quantiles(libsizes, ["context"], "libsize", [0.5]).select("context", F.col("q")[0].alias("depth"))


def even_totals(fractions: DataFrame, depth: DataFrame, requests: DataFrame) -> DataFrame:
    """Per (context, target_gene, gene): total = rint(n * depth * fraction), base and remainder over n cells."""
    rows = fractions.join(depth, "context").join(requests.select("context", "target_gene", "n"), ["context", "target_gene"])
    total = rint(F.col("n") * F.col("depth") * F.col("fraction")).cast("bigint")
    return rows.withColumn("total", total).select(
        "context", "target_gene", "gene_pos", "gene", "n", "total",
        F.floor(F.col("total") / F.col("n")).cast("bigint").alias("base"),
        (F.col("total") % F.col("n")).alias("rem"),
    )


def allocate_even(totals: DataFrame, *, seed: int = 0) -> DataFrame:
    """context, target_gene, cell_no, gene, value: every total spread over n cells as evenly as possible.

    Each cell gets the floor, and ``rem`` cells one more: the first ``rem`` of a seeded permutation of
    the cells, ``(start + j * step) mod n`` with a prime step above n, that differs by gene. Neighbouring
    cells share no run of extra counts, and choosing them needs neither a sort nor a shuffle. Zeros are
    never produced.
    """
    rows = _permuted(totals, seed).withColumn("_stored", F.when(F.col("base") > 0, F.col("n")).otherwise(F.col("rem")))
    spread = explode_range(rows, "_stored", "_j")
    return spread.select(
        "context", "target_gene", F.pmod(F.col("_j") * F.col("_step") + F.col("_first"), F.col("n")).alias("cell_no"), "gene_pos", "gene",
        (F.col("base") + (F.col("_j") < F.col("rem")).cast("bigint")).cast("double").alias("value"),
    )


def even_cells(totals: DataFrame, *, seed: int = 0) -> DataFrame:
    """context, target_gene, cell_no, libsize, entries: the cells of :func:`allocate_even`, one packed row each.

    A cell finds its place in every gene's permutation with the step's inverse, ``j = (cell_no - start) / step mod n``, so
    a row is made whole, with its total, where it stands: nothing is shuffled or sorted by cell.
    """
    keys = ["context", "target_gene", "n"]
    of_gene = F.struct("gene", F.col("base").cast("double").alias("base"), "rem", "_first", _inverse("_step", "n").alias("_inverse"))
    labels = _permuted(totals, seed).groupBy(*keys).agg(F.sort_array(F.collect_list(of_gene)).alias("_genes"))
    spread = explode_range(labels.withColumn("_n", F.col("n")), "_n", "cell_no")
    n, cell = F.col("n"), F.col("cell_no")

    def entry(g: Column) -> Column:
        extra = F.pmod(F.pmod(cell - g["_first"], n) * g["_inverse"], n) < g["rem"]
        return F.struct(g["gene"].alias("gene"), (g["base"] + F.when(extra, 1.0).otherwise(0.0)).alias("value"))

    entries = F.filter(F.transform("_genes", entry), lambda e: e["value"] > 0)
    cells = spread.select("context", "target_gene", "cell_no", entries.alias("entries"))
    return cells.withColumn("libsize", F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["value"]))


def _permuted(totals: DataFrame, seed: int) -> DataFrame:
    """``totals`` with ``_first`` and ``_step`` of the permutation of each (context, label, gene)."""
    drawn = seed_hash(seed, "context", "target_gene", "gene")
    step = F.get(F.array(*[F.lit(p) for p in STEPS]), F.conv(F.substring(drawn, 16, 1), 16, 10).cast("int"))
    return totals.withColumn("_first", draw_index(drawn, F.col("n"))).withColumn("_step", step)


def _inverse(step: str, n: str) -> Column:
    """The inverse of a prime step modulo n, below it, by the Euclidean algorithm: 48 rounds do for n below 2 ** 31."""
    big = lambda c: c.cast("bigint")
    state = lambda r, s, t, u: F.struct(big(r).alias("r"), big(s).alias("s"), big(t).alias("t"), big(u).alias("u"))
    start = state(F.col(n), F.pmod(F.col(step), F.col(n)), F.lit(0), F.lit(1))

    def round_(a: Column, _: Column) -> Column:
        q = F.floor(a["r"] / a["s"]).cast("bigint")
        return F.when(a["s"] == 0, a).otherwise(state(a["s"], a["r"] - q * a["s"], a["u"], a["t"] - q * a["u"]))

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, round_)["t"], F.col(n))
