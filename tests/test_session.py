from types import SimpleNamespace

import pytest

from pertmatrix.session import scratch_path


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_scratch_is_below_the_shared_folder():
    one, two = (scratch_path(fake("spark://h:1", "hdfs://n/shared/"), "x") for _ in range(2))
    assert one.startswith("hdfs://n/shared/pertmatrix/x-") and one != two


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(fake("yarn"), "x")


def test_local_sessions_get_one_folder_per_process():
    roots = {scratch_path(fake("local[2]"), "x").rsplit("/", 2)[0] for _ in range(2)}
    assert len(roots) == 1
