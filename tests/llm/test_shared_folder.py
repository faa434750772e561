"""Off a local session, an unset shared folder is an error; no machine-local folder takes its place."""

from types import SimpleNamespace

import pytest

from crestline.llm import common


@pytest.mark.parametrize("master, folder, want", [("local[4]", None, None), ("local", "s3://b/c", "s3://b/c"), ("yarn", "hdfs:///c", "hdfs:///c"), ("local-cluster[2,1,900]", "file:///c", "file:///c")])
def test_the_folder_that_is_set(master, folder, want):
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert common.shared_folder(spark) == want
    if folder:
        assert common.scratch(spark, "t").startswith(folder + "/t-")


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,900]"])
def test_a_cluster_must_have_one(master):
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(spark, "t")
