from types import SimpleNamespace

import pytest

from inkstone.llm import common


def session(master, folder=None):
    kept = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=kept.get, set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(session("local-cluster[3,2,3000]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(session("yarn"))
    assert common.scratch_dir(session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x/inkstone"
    own = session("local[8]")
    assert common.scratch_dir(own) == common.scratch_dir(own)


def test_names_that_no_column_has():
    assert common.unused("key", ["a", "KEY", "key_"]) == "key__" and common.unused("key", []) == "key"
