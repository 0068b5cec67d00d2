import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from pertmatrix.matrix import CountMatrix  # noqa: E402
from pertmatrix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_matrix(spark):
    """A CountMatrix from a dense array, labels and optional contexts; cell ids are row numbers."""

    def build(X, labels, genes=None, contexts=None):
        X = np.asarray(X, dtype=float)
        genes = genes or [f"g{j}" for j in range(X.shape[1])]
        contexts = contexts or ["A"] * len(labels)
        cells = spark.createDataFrame(
            [(i, i, str(a), c, "b") for i, (a, c) in enumerate(zip(labels, contexts))],
            "cell_id bigint, cell_ord bigint, target_gene string, context string, batch string",
        )
        axis = spark.createDataFrame([(j, g, f"ENSG{j:011d}") for j, g in enumerate(genes)], "gene_pos bigint, gene string, ensembl_id string")
        triples = [(int(i), genes[j], float(X[i, j])) for i, j in zip(*np.nonzero(X))]
        return CountMatrix(cells, axis, spark.createDataFrame(triples, "cell_id bigint, gene string, value double"))

    return build


def table(df, *keys):
    """{key tuple: row} of a small frame."""
    rows = df.collect()
    out = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
    assert len(out) == len(rows)
    return out
