"""Registered queries against DuckDB. One per family by default; ALL_QUERIES=1 runs every one (six minutes)."""

import os
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry_points
from pertmatrix.plans import ORACLES, QUERIES

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SAMPLE = (
    "scan_sparse_rows scan_gene_axis scan_leaderboard_pages sink_subset sink_prediction filter_libsize_quantiles split_train_holdout "
    "sample_cap_per_label sample_with_replacement shift_fraction join_remap_axis join_file_manifest_diff pb_control_once pb_median pb_bootstrap "
    "backbone_features transfer_delta detect_counts_state allocate_even apply_delta_cells validate_block_values manifest_gate de_bh_fdr "
    "metric_sig_jaccard score_overall score_cell_overall model_ladder_report node_features_concat stream_control_once "
    "verify_file_ranges provenance_versions metric_pds_l1 stream_pb_merge profile_matrix profile_dataset "
    "model_ladder_cells priors_check priors_graph harmonize_tables scan_matrix_tables"
).split()
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(str(SF))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert oracle.compare(spark, con, str(SF), entry_points.queries()[name], entry_points.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
