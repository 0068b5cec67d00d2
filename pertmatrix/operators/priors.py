"""Prior sources: what a source of prior knowledge declares and builds, the check of one against the other, and the graph of all.

A source declares its kind before anything is built. Edges are (src_pos, dst_pos, attr array<double>) on the gene axis,
node features (gene_pos, features array<double>), one row for every gene.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pertmatrix.operators import edges as E

EDGE, FEATURE = "edge", "node_feature"
SHAPES = {EDGE: ("src_pos", "dst_pos"), FEATURE: ("gene_pos", "features")}


@dataclass(frozen=True)
class Declared:
    """``width``: attributes of an edge, or features of a gene."""

    layer: str
    relation: str
    name: str
    kind: str
    width: int = 0
    enabled: bool = True

    def __post_init__(self):
        if self.kind not in SHAPES:
            raise ValueError(f"source {self.name!r} must declare one of {sorted(SHAPES)}, not {self.kind!r}")

    @property
    def key(self) -> str:
        return E.edge_type_key(self.layer, self.relation, self.name)


class PriorSource(ABC):
    """A source with a declaration; ``build`` reads its data and places them on the axis (gene_id, gene_pos)."""

    declared: Declared

    @abstractmethod
    def build(self, index: DataFrame) -> DataFrame:
        """Edges or node features, as declared."""


def kind_of(built: DataFrame) -> str | None:
    """The kind whose columns a table has, None for neither."""
    return next((kind for kind, columns in SHAPES.items() if set(columns) <= set(built.columns)), None)


def violations(declared: Declared, built: DataFrame, index: DataFrame) -> DataFrame:
    """rule, n: a kind other than declared (n = rows), else positions, attribute counts and feature rows that break the contract."""
    n_rows = F.count("*").alias("n")
    if kind_of(built) != declared.kind:
        return built.agg(n_rows).select(F.lit(f"built {kind_of(built) or 'neither kind'}, declared {declared.kind}").alias("rule"), "n")
    values = "attr" if declared.kind == EDGE else "features"
    if declared.kind == EDGE:
        # the axis is a few rows for each gene at most; its length is one scalar
        n_genes = index.agg(F.count("*")).scalar()
        rules = E.edge_violations(built, n_genes)
    else:
        rules = E.feature_violations(built, index)
    if values in built.columns:
        wrong = F.count_if(F.coalesce(F.size(values), F.lit(-1)) != declared.width).alias("n")
    else:
        wrong = (n_rows if declared.width else F.lit(0).cast("bigint")).alias("n")
    return rules.unionByName(built.agg(wrong).filter("n > 0").select(F.lit(f"{values}: not {declared.width} values").alias("rule"), "n"))


def _enabled(sources: Sequence[PriorSource]) -> list[PriorSource]:
    """The enabled sources; two of them under one key are an error, so that none is lost."""
    used = [s for s in sources if s.declared.enabled]
    keys = [s.declared.key for s in used]
    doubled = sorted({k for k in keys if keys.count(k) > 1})
    if not used or doubled:
        raise ValueError(f"duplicate sources: {doubled}" if doubled else "no source is enabled")
    return used


def check(sources: Sequence[PriorSource], index: DataFrame) -> DataFrame:
    """source, rule, n for every enabled source; empty when all keep what they declare."""
    parts = [violations(s.declared, s.build(index), index).select(F.lit(s.declared.key).alias("source"), "rule", "n") for s in _enabled(sources)]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class PriorGraph:
    """``edges``: edge_type, src_pos, dst_pos, attr. ``features``: gene_pos, features. None where no source is of that kind."""

    edges: DataFrame | None
    features: DataFrame | None


def assemble(sources: Sequence[PriorSource], index: DataFrame) -> PriorGraph:
    """All enabled sources as one graph: edges keyed by their type, feature blocks side by side in the order given.

    What breaks its declaration is an error that lists every source at fault.
    """
    used = _enabled(sources)
    found = sorted((r.source, r.rule, r.n) for r in check(used, index).collect())
    if found:
        raise ValueError(f"sources break their declaration: {found}")
    edges = [
        built.select(F.lit(s.declared.key).alias("edge_type"), "src_pos", "dst_pos", (F.col("attr") if s.declared.width else F.array().cast("array<double>")).alias("attr"))
        for s in used if s.declared.kind == EDGE for built in [s.build(index)]
    ]
    blocks = [(s.build(index), s.declared.width) for s in used if s.declared.kind == FEATURE]
    return PriorGraph(reduce(DataFrame.unionByName, edges) if edges else None, E.concat_features(index, blocks) if blocks else None)
