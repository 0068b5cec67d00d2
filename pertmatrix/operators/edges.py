"""Prior graph tables: edges aligned to the gene axis, and node features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def align_edges(edges: DataFrame, index: DataFrame, *, src: str = "src", dst: str = "dst", drop_self_loops: bool = False) -> DataFrame:
    """Edges with src_pos and dst_pos. An edge stays only if both ends are known; its attributes stay with it."""
    ends = index.select("gene_id", "gene_pos")
    out = (
        edges.join(ends.select(F.col("gene_id").alias(src), F.col("gene_pos").alias("src_pos")), src)
        .join(ends.select(F.col("gene_id").alias(dst), F.col("gene_pos").alias("dst_pos")), dst)
    )
    return out.filter("src_pos != dst_pos") if drop_self_loops else out


def edge_violations(edges: DataFrame, n_genes: int) -> DataFrame:
    """rule, n over aligned edges: positions missing, not whole, or outside [0, n_genes)."""
    kinds = dict(edges.dtypes)
    whole = all(kinds[c] in ("int", "bigint", "smallint", "tinyint") for c in ("src_pos", "dst_pos"))
    low = F.least("src_pos", "dst_pos") < 0
    high = F.greatest("src_pos", "dst_pos") >= n_genes
    row = edges.agg(
        F.count_if(F.col("src_pos").isNull() | F.col("dst_pos").isNull()).alias("missing position"),
        F.count_if(low | high).alias("position out of range"),
        (F.lit(0) if whole else F.count("*")).cast("bigint").alias("position not an integer"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in row.columns])
    return row.select(F.inline(pairs)).filter("n > 0")


def feature_violations(features: DataFrame, index: DataFrame) -> DataFrame:
    """rule, n: genes without exactly one feature row, and rows whose gene is unknown."""
    per_gene = features.groupBy("gene_pos").agg(F.count("*").alias("k"))
    known = index.select("gene_pos").join(per_gene, "gene_pos", "left").agg(F.count_if(F.coalesce("k", F.lit(0)) != 1).alias("n"))
    extra = per_gene.join(index.select("gene_pos"), "gene_pos", "left_anti").agg(F.count("*").alias("n"))
    return known.select(F.lit("gene without exactly one row").alias("rule"), "n").unionByName(
        extra.select(F.lit("row for an unknown gene").alias("rule"), "n")
    ).filter("n > 0")


def edge_type_key(layer: str, relation: str, name: str) -> str:
    return f"{layer}:{relation}:{name}"


def union_typed(sources: Sequence[tuple[Mapping[str, str], DataFrame]]) -> DataFrame:
    """edge_type, src_pos, dst_pos from (spec with layer, relation, name; aligned edges) pairs.

    Two sources with the same key are refused, so that none is lost.
    """
    keys = [edge_type_key(s["layer"], s["relation"], s["name"]) for s, _ in sources]
    doubled = sorted({k for k in keys if keys.count(k) > 1})
    if doubled:
        raise ValueError(f"duplicate edge type: {doubled}")
    out = None
    for key, (_, edges) in zip(keys, sources):
        part = edges.select(F.lit(key).alias("edge_type"), "src_pos", "dst_pos")
        out = part if out is None else out.unionByName(part)
    return out


def filter_confidence(edges: DataFrame, levels: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    return edges.filter(F.col("confidence").isin(*levels))


def filter_score(edges: DataFrame, threshold: float = 700) -> DataFrame:
    return edges.filter(F.col("score") >= threshold)


def filter_region(edges: DataFrame, region: str = "3utr") -> DataFrame:
    return edges.filter(F.col("region") == region)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once."""
    pairs = edges.select("src_pos", "dst_pos")
    back = pairs.select(F.col("dst_pos").alias("src_pos"), F.col("src_pos").alias("dst_pos"))
    return pairs.unionByName(back).distinct()


def aggregate_score(edges: DataFrame) -> DataFrame:
    """dst_pos, score_sum, score_max, n_edges over all regulators of a target."""
    return edges.groupBy("dst_pos").agg(
        F.sum("score").alias("score_sum"), F.max("score").alias("score_max"), F.count("*").alias("n_edges")
    )


def pool_chunks(chunks: DataFrame, key: str, values: str) -> DataFrame:
    """key, dim, value: mean over the chunk vectors of a key, position by position (partial sums first)."""
    return (
        chunks.select(key, F.posexplode(values).alias("dim", "v"))
        .groupBy(key, F.col("dim").cast("bigint").alias("dim"))
        .agg(F.avg(F.col("v").cast("double")).alias("value"))
    )


def concat_features(index: DataFrame, blocks: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """gene_pos, features: blocks (gene_pos, features array; width) side by side; absent genes get zeros.

    An array of another width than its block declares raises an error.
    """
    out = index.select("gene_pos")
    parts = []
    for i, (block, width) in enumerate(blocks):
        name = f"_f{i}"
        out = out.join(block.select("gene_pos", F.col("features").alias(name)), "gene_pos", "left")
        wrong = F.raise_error(F.concat(F.lit(f"block {i} declares {width} features, found "), F.size(name).cast("string")))
        parts.append(F.when(F.col(name).isNull(), F.array_repeat(F.lit(0.0), width)).when(F.size(name) == width, F.col(name)).otherwise(wrong))
    return out.select("gene_pos", F.concat(*parts).alias("features"))
