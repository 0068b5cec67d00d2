"""Scores of predicted cells: each context predicted from the others, emitted as cells, tested and scored.

The cells to compare form groups: the real cells, a prediction's cells with the real controls attached, and random
halves of the real cells. A group's name stands before its context in ``context`` (``user|ctx``), so one pass each
of sums, rank tests and fold changes serves all groups; entries are copied to their groups inside the row, below
the partial aggregation, and an arm then sets the small tables of one group against those of another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.matrix import CONTROL, CountMatrix
from pertmatrix.operators import cells as C, effects as FX, emit, expression, metrics as Q, models as M, predictors as R, pseudobulk as P
from pertmatrix.operators.sampling import explode_range
from pertmatrix.plans import evaluation as EV
from pertmatrix.session import materialized

KEYS = EV.KEYS
LOG_TARGET = 1e4
MEMBERS = ("pds_cosine", "mse", "lfc_nmae", "direction_fidelity", "direction_agreement", "sig_jaccard")


@dataclass(frozen=True)
class Arm:
    """A prediction group and the group of real cells it is held against."""

    name: str
    pred: str
    real: str


@dataclass(frozen=True)
class CellGroups:
    """``cells``: context, target_gene, a row per cell. ``entries``: context, target_gene, gene, value, libsize, leads.

    With ``logged``, values are log-normalised already (to ``LOG_TARGET`` a cell) and libsize and leads are not needed.
    """

    cells: DataFrame
    entries: DataFrame
    logged: bool = False


def anchor_arms(n_splits: int) -> list[Arm]:
    """The prediction, the generic response and the replicates: one half of the real cells against the other."""
    return [Arm("user", "user", "real"), Arm("base", "base", "real"), *[Arm(f"split{s}", f"split{s}h0", f"split{s}h1") for s in range(n_splits)]]


def _named(df: DataFrame, groups: Column) -> DataFrame:
    return df.withColumn("_group", F.explode(groups)).withColumn("context", F.concat_ws("|", "_group", "context")).drop("_group")


def _real_groups(df: DataFrame, n_splits: int, control: str) -> DataFrame:
    halves = [F.concat(F.lit(f"split{s}h"), draw_index(seed_hash(f"split{s}", "cell_id"), F.lit(2)).cast("string")) for s in range(n_splits)]
    attached = F.when(F.col("target_gene") == control, F.array(F.lit("user"), F.lit("base"))).otherwise(F.array().cast("array<string>"))
    return _named(df, F.concat(F.array(F.lit("real"), *halves), attached))


def _emitted(shifts: DataFrame, profile: DataFrame, depth: DataFrame, requests: DataFrame, seed: int) -> DataFrame:
    """Entries of the even cells, with the cell's total. The cells are written once, packed, for the passes that read them."""
    totals = materialized(emit.even_totals(emit.shift_fraction(profile, shifts), depth, requests), "even-totals")
    return C.row_entries(materialized(emit.even_cells(totals, seed=seed), "even-cells"))


def transfer_groups(m: CountMatrix, contexts: Sequence[str], *, n_splits: int = 5, seed: int = 0, control: str = CONTROL) -> CellGroups:
    """Real, predicted (user), generic (base) and replicate groups for every context.

    A context is predicted from the pooled effects of all the others, around its own control profile, with as many
    cells per label as it really has. The generic prediction gives every label the context's mean effect.
    """
    entries = materialized(C.labelled(m), "labelled")
    pb = P.entry_sums(entries, m.cells, KEYS, save=True)
    is_pert = F.col("target_gene") != control
    requests = materialized(P.group_sizes(m.cells.filter(is_pert), KEYS).withColumnRenamed("n_cells", "n"), "requests")

    others = F.explode(F.array_except(F.array(*[F.lit(x) for x in contexts]), F.array("context")))
    effects = FX.log2fc_with_var(pb, m.genes, control=control)
    away = effects.withColumn("_held", others).drop("context").withColumnRenamed("_held", "context")
    user = FX.transfer_delta(requests, away, m.genes, by=["context"])

    def one_label(df: DataFrame) -> DataFrame:
        one = df.withColumn("target_gene", F.when(is_pert, F.lit("perturbed")).otherwise(F.lit(control)))
        keys = [c for c in [*KEYS, "gene"] if c in df.columns]
        return one.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys])

    mean = FX.log2fc_with_var(P.PseudobulkSums(one_label(pb.gene), one_label(pb.label), pb.by), m.genes, control=control)
    base = requests.select(*KEYS).join(mean.select("context", "gene", F.col("log2fc").alias("shift")), "context")

    profile, libsizes = emit.context_profile(entries, m.genes, control=control)
    profile, depth = materialized(profile, "profile"), materialized(emit.median_depth(libsizes), "depth")
    wanted = explode_range(requests, "n", "cell_no").select(*KEYS)
    columns = [*KEYS, "gene", "value", "libsize", "leads"]
    emitted = [
        _named(_emitted(shifts, profile, depth, requests, seed), F.array(F.lit(name))).select(*columns)
        for name, shifts in (("user", user), ("base", base))
    ]
    cells = _real_groups(m.cells, n_splits, control).select(*KEYS).unionByName(_named(wanted, F.array(F.lit("user"), F.lit("base"))))
    return CellGroups(cells, reduce(DataFrame.unionByName, [_real_groups(entries, n_splits, control).select(*columns), *emitted]))


def logged_sums(groups: CellGroups) -> P.PseudobulkSums:
    """Counts per million by way of the logged values; a cell without any value is a cell."""
    cpm = F.expm1("value") * (1e6 / LOG_TARGET)
    gene = groups.entries.groupBy(*KEYS, "gene").agg(F.lit(0.0).alias("count_sum"), F.sum(cpm).alias("cpm_sum"), F.sum(cpm * cpm).alias("cpm_sq_sum"))
    label = P.group_sizes(groups.cells, KEYS).withColumn("libsize_sum", F.lit(0.0))
    return P.PseudobulkSums(gene, label, tuple(KEYS))


def member_means(groups: CellGroups, genes: DataFrame, arms: Sequence[Arm], threshold: float) -> DataFrame:
    """context (``arm|context``), metric, value: the mean of each of the six members over the labels."""
    return materialized(Q.metric_means(member_scores(groups, genes, arms, threshold), ["context"]), "member-means")


def member_scores(groups: CellGroups, genes: DataFrame, arms: Sequence[Arm], threshold: float) -> DataFrame:
    """context (``arm|context``), target_gene, metric, value for the six members."""
    logged = groups.entries if groups.logged else C.log_normalized(groups.entries)
    sums = EV.context_sums(logged, groups.cells, genes)
    deltas = materialized(EV.deltas(P.moments_from_sums(sums.sums, sums.sizes, sums.genes, KEYS)), "group-deltas")
    tests = materialized(expression.wilcoxon(groups.entries, groups.cells, sums.genes, by=["context"]), "group-tests")
    pb = logged_sums(groups) if groups.logged else P.entry_sums(groups.entries, groups.cells, KEYS, save=True)
    lfc = materialized(FX.log2fc_with_var(pb, sums.genes), "group-lfc")

    def side(df: DataFrame, of: str) -> DataFrame:
        """The rows of the arms' groups, under the arms' names."""
        of_group: dict[str, list[Column]] = {}
        for arm in arms:
            of_group.setdefault(getattr(arm, of), []).append(F.lit(arm.name))
        known = F.create_map(*[x for group, names in of_group.items() for x in (F.lit(group), F.array(*names))])
        group = F.substring_index("context", "|", 1)
        rest = F.col("context").substr(F.length(group) + 2, F.length("context"))
        return df.withColumn("_arm", F.explode(known[group])).withColumn("context", F.concat_ws("|", "_arm", rest)).drop("_arm")

    by = ["context"]
    scores = EV.delta_scores(EV.Scored(side(deltas, "pred"), side(deltas, "real"))).filter(F.col("metric").isin("mse", "pds_cosine"))
    pairs = materialized(Q.significance_pairs(side(tests, "pred"), side(tests, "real"), threshold, by), "group-pairs")
    more = {
        "lfc_nmae": Q.fold_change_error(pairs, side(lfc, "pred"), side(lfc, "real"), by),
        "sig_jaccard": Q.significance_jaccard(pairs, by),
        "direction_agreement": Q.direction_agreement(pairs, by),
        "direction_fidelity": Q.direction_agreement(pairs, by, sig="sig_p"),
    }
    for name, df in more.items():
        scores = scores.unionByName(df.select(*KEYS, F.lit(name).alias("metric"), "value"))
    return scores


def anchored_members(m: CountMatrix, contexts: Sequence[str], threshold: float, *, n_splits: int = 5, seed: int = 0) -> DataFrame:
    """context, metric, u, b, r, scaled: the predicted cells on the scale from generic response to replicate."""
    means = member_means(transfer_groups(m, contexts, n_splits=n_splits, seed=seed), m.genes, anchor_arms(n_splits), threshold)
    arm = F.substring_index("context", "|", 1)
    rest = F.col("context").substr(F.length(arm) + 2, F.length("context"))
    named = means.select(arm.alias("arm"), rest.alias("context"), "metric", "value")
    user, base = (named.filter(F.col("arm") == a).drop("arm") for a in ("user", "base"))
    top = named.filter(F.col("arm").startswith("split")).groupBy("context", "metric").agg(F.avg("value").alias("value"))
    return Q.scale_to_anchors(user, base, top, ["context"])


def ladder_groups(m: CountMatrix, models: Sequence[M.Predictor], held_out: str, *, seed: int = 0, control: str = CONTROL) -> CellGroups:
    """The held-out context's real cells, and each model's predicted cells with the real controls attached.

    Models are fitted on the cells of all other contexts, and their cells are control cells of these, shifted by the
    model's deltas: as many for a label as the held-out context has. All models' cells are drawn in one pass over one
    pool, under labels that carry the model's name, and written once. A cell without a context is in neither part.
    """
    m = C.rows_written(m)
    held = F.col("context") == held_out
    train, real = m.where(~held), m.where(held)
    seen = materialized(C.log_normalized(C.labelled(train)).select("cell_id", "target_gene", "gene", "value"), "ladder-train")
    requests = materialized(P.group_sizes(real.cells.filter(F.col("target_gene") != control), ["target_gene"]).withColumnRenamed("n_cells", "n"), "ladder-requests")
    deltas = M.predicted_deltas(models, P.label_moments(seen, train.cells, m.genes), requests.select("target_gene"), m.genes)

    named = F.concat_ws(M.SEPARATOR, "model", "target_gene").alias("target_gene")
    each = F.explode(F.array(*[F.lit(x.name) for x in models])).alias("model")
    wanted = materialized(requests.select(each, "target_gene", "n").select(named, "n"), "ladder-wanted")
    drawn = R.predict_cells(wanted, deltas.select(named, "gene_pos", "gene", "delta"), seen, train.cells, m.genes, seed=seed, control=control)
    model = F.substring_index("target_gene", M.SEPARATOR, 1)
    context = F.concat_ws("|", model, F.lit(held_out)).alias("context")
    label = F.col("target_gene").substr(F.length(model) + 2, F.length("target_gene")).alias("target_gene")
    predicted = materialized(drawn.select(context, label, "gene", "value"), "ladder-cells")

    def with_controls(df: DataFrame) -> DataFrame:
        attached = F.when(F.col("target_gene") == control, F.array(*[F.lit(x.name) for x in models])).otherwise(F.array().cast("array<string>"))
        return _named(df, F.concat(F.array(F.lit("real")), attached))

    columns = [*KEYS, "gene", "value"]
    entries = with_controls(C.log_normalized(C.labelled(real), LOG_TARGET).select(*columns)).select(*columns)
    cells = with_controls(real.cells.select(*KEYS)).select(*KEYS).unionByName(explode_range(wanted, "n", "cell_no").select(context, label))
    return CellGroups(cells, entries.unionByName(predicted), logged=True)


def ladder_scores(m: CountMatrix, models: Sequence[M.Predictor], held_out: str, threshold: float, *, seed: int = 0) -> DataFrame:
    """model, target_gene, metric, value: the six members of every model's predicted cells, scored by one plan for all models."""
    if "real" in {x.name for x in models}:
        raise ValueError("no model can be named real")
    arms = [Arm(x.name, x.name, "real") for x in models]
    scores = member_scores(ladder_groups(m, models, held_out, seed=seed), m.genes, arms, threshold)
    return scores.select(F.substring_index("context", "|", 1).alias("model"), "target_gene", "metric", "value")
